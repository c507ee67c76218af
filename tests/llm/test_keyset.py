from opslens.llm import keyset


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_no_row_with_a_key_is_stopped(spark, monkeypatch):
    table = spark.range(20_000).selectExpr("id", "concat('k', id) AS name", "id % 7 AS more")
    keys = table.filter("id % 40 = 3").select("id", "name")
    for most in (keyset.MOST, 64 * keyset.PAGE, keyset.PAGE):
        monkeypatch.setattr(keyset, "MOST", most)
        some, none = keyset.divided(table, keys, ["name", "id"])
        assert some.columns == table.columns == none.columns
        assert rows(some.unionByName(none)) == rows(table)
        assert some.filter("id % 40 = 3").count() == 500 and none.filter("id % 40 = 3").count() == 0
        if most > keyset.PAGE:
            assert some.count() < 1_000


def test_no_keys_and_null_keys(spark):
    table = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "id long, name string")
    some, none = keyset.divided(table, table.limit(0), ["id"])
    assert some.count() == 0 and none.count() == 3
    some, none = keyset.divided(table, table.filter("id IS NULL"), ["id"])
    assert rows(some) == [(None, "b")] and none.count() == 2
