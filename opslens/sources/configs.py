"""Configuration documents: reading, environment variables, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslens.functions.strictjson import strict_json
from opslens.operators.documents import mask_sensitive, unflatten


def detect_format(path: Column, text: Column) -> Column:
    """By suffix; otherwise JSON if the text parses, else YAML; no text means a prefix."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return (
        F.when(text.isNull(), "env")
        .when(suffix.isin(".yaml", ".yml"), "yaml")
        .when(suffix == ".json", "json")
        .when(strict_json(text).isNotNull(), "json")
        .otherwise("yaml")
    )


def parse_config_docs(texts: DataFrame) -> DataFrame:
    """Rows ``(path, text)`` with ``format``, ``doc`` and ``error``. A text that cannot be read
    gives an empty document and an error instead of stopping the load."""
    text = F.col("text")
    fmt = detect_format(F.col("path"), text)
    ok = F.try_variant_get(strict_json(text), "$", "map<string,variant>").isNotNull()
    blank = F.trim(text) == ""
    return texts.select(
        *[c for c in texts.columns if c != "text"],
        fmt.alias("format"),
        F.when(ok, text).otherwise("{}").alias("doc"),
        F.when(~ok & ~((fmt == "yaml") & blank), F.concat(F.lit("Failed to load "), F.col("path"))).alias("error"),
    )


def read_config_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``."""
    files = spark.read.text(path, wholetext=True)
    return parse_config_docs(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def env_to_leaves(env: DataFrame, prefix: str, keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    """Environment rows ``(name, value)`` with the prefix as document leaves.

    ``PREFIX_A__B`` becomes ``a.b``; a value that is JSON keeps its type, else it is a string.
    """
    start = prefix.upper() if prefix.upper().endswith("_") else prefix.upper() + "_"
    mine = env.where(F.col("name").startswith(start))
    path = F.replace(F.lower(F.substr("name", F.lit(len(start) + 1))), F.lit("__"), F.lit("."))
    parsed = strict_json("value")
    return mine.select(
        *keys,
        path.alias("path"),
        F.when(parsed.isNull(), F.col("value")).when(F.is_variant_null(parsed), None).otherwise(parsed.cast("string")).alias("value"),
        F.when(parsed.isNull(), "string").otherwise(variant_kind(parsed)).alias("value_type"),
    )


def variant_kind(v: Column) -> Column:
    """Short type name of a variant value."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "dict")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "float")
        .otherwise("string")
    )


def write_config(leaves: DataFrame, path: str, mask: bool = False, fmt: str = "text", keys: tuple[str, ...] = ("scope",)) -> None:
    """Documents by key, replacing what is there.

    ``text`` writes one folder per key, for people and for few keys; ``json`` one line per document, an object with
    the keys and the document as ``doc``; ``parquet`` the keys and the document's text as columns.
    """
    docs = unflatten(mask_sensitive(leaves) if mask else leaves, keys)
    if fmt == "text":
        docs.write.mode("overwrite").partitionBy(*keys).text(path)
    elif fmt == "json":
        # the document's text goes in unchanged, so numbers stay as written
        head = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        line = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"doc":'), F.col("doc"), F.lit("}"))
        docs.select(line.alias("value")).write.mode("overwrite").text(path)
    elif fmt == "parquet":
        docs.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no such format: {fmt}")


def read_written_config(spark: SparkSession, path: str, fmt: str, keys: str = "scope string") -> DataFrame:
    """Documents that ``write_config`` wrote as ``json`` or ``parquet``: the keys, typed as in ``keys``, and ``doc``."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    lines = spark.read.text(path)
    names = F.from_json("value", keys).alias("_k")
    # quotes inside a key's text are escaped, so the first such mark is the separator
    doc = F.expr("substr(value, locate(',\"doc\":', value) + 7, length(value) - locate(',\"doc\":', value) - 7)")
    return lines.select(names, doc.alias("doc")).select("_k.*", "doc")
