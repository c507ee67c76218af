"""Nested documents as leaf tables: flatten, merge, expand, mask, validate, compare.

A leaf row has the document's key columns, ``path`` (dot separated), ``value`` (plain text of
a scalar, JSON text of a list, null) and ``value_type`` (string, int, float, bool, list, null,
dict for an empty object).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from opslens.functions.fixed import SENSITIVE_WORDS, URL_PATTERN
from opslens.functions.jsontree import document_leaves, leaf_arrays, mask_tree, nest
from opslens.plans.ordered import number_chunk, previous

LEAF = ["path", "value", "value_type"]
KIND_SQL = (
    "CASE WHEN {k} = 'VOID' THEN 'null' WHEN startswith({k}, 'OBJECT') THEN 'dict' WHEN startswith({k}, 'ARRAY') THEN 'list' "
    "WHEN {k} = 'BOOLEAN' THEN 'bool' WHEN {k} = 'BIGINT' THEN 'int' WHEN startswith({k}, 'DECIMAL') OR {k} = 'DOUBLE' THEN 'float' ELSE 'string' END"
)


# ---------------------------------------------------------------- shape


def flatten(docs: DataFrame, doc: str = "doc", keep_empty: bool = False) -> DataFrame:
    """Leaves of JSON documents of any depth; all other columns are kept.

    One parser reads all documents, an Arrow batch at a time: numbers come out as ``json.dumps`` writes them,
    whole numbers exactly; of a repeated key the last value counts. Text that is not exactly one JSON object gives no rows.
    """
    keep = [c for c in docs.columns if c != doc]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, leaves = [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                found = document_leaves(text, keep_empty)
                at += [i] * len(found)
                leaves += found
            kept = pa.RecordBatch.from_arrays(batch.columns[1:], names=keep).take(pa.array(at, pa.int64())) if keep else None
            columns = [*(kept.columns if keep else []), *leaf_arrays(leaves)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *LEAF])

    rows = docs.select(F.col(f"`{doc}`"), *[F.col(f"`{c}`") for c in keep])
    kinds = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.StringType()) for c in LEAF]])
    return rows.mapInArrow(walk, kinds)


def json_text(value: str = "value", kind: str = "value_type") -> Column:
    """JSON text of a leaf value."""
    quoted = F.expr(f"substring(to_json(named_struct('v', {value})), 6, length(to_json(named_struct('v', {value}))) - 6)")
    return F.when(F.col(kind) == "null", "null").when(F.col(kind) == "string", quoted).otherwise(F.col(value))


def unflatten(leaves: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """One JSON document per key from its leaves; a group is one document."""

    @F.pandas_udf("string")
    def build(groups: pd.Series) -> pd.Series:
        return groups.map(lambda rows: nest([(r["path"], r["json"]) for r in rows]))

    rows = leaves.select(*keys, F.struct("path", json_text().alias("json")).alias("_l"))
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_l")).alias("_ls"))
    return grouped.select(*keys, build("_ls").alias("doc"))


def _escaped(text: str) -> str:
    """Text as it stands inside a quoted SQL string."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def get_path(docs: DataFrame, path: str, default: str | None = None, doc: str = "doc", out: str = "value") -> DataFrame:
    """Adds the text at ``path``; the default only where the path is absent, a stored null stays null."""
    node = "try_parse_json(`%s`)" % doc
    found = "true"
    for part in map(_escaped, path.split(".")):
        here = f"try_variant_get({node}, '$', 'map<string,variant>')"
        found = f"({found} AND coalesce(map_contains_key({here}, '{part}'), false))"
        node = f"try_element_at({here}, '{part}')"
    given = "NULL" if default is None else f"'{_escaped(default)}'"
    return docs.withColumn(out, F.expr(f"CASE WHEN {found} THEN string({node}) ELSE {given} END"))


def get_section(docs: DataFrame, name: str, doc: str = "doc", out: str = "section") -> DataFrame:
    """Adds the JSON text of a section; ``{}`` where the value is not an object."""
    node = f"try_element_at(try_variant_get(try_parse_json(`{doc}`), '$', 'map<string,variant>'), '{_escaped(name)}')"
    whole = f"CASE WHEN try_variant_get({node}, '$', 'map<string,variant>') IS NOT NULL THEN to_json({node}) END"
    return docs.withColumn(out, F.coalesce(F.expr(whole), F.lit("{}")))


def lookup_paths(leaves: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Bulk lookup: ``wanted`` has ``keys, path, default_value``."""
    found = leaves.select(*keys, "path", "value", F.lit(True).alias("_found"))
    joined = wanted.join(found, [*keys, "path"], "left")
    return joined.withColumn("value", F.when(F.col("_found"), F.col("value")).otherwise(F.col("default_value"))).drop("_found")


def set_path(leaves: DataFrame, changes: DataFrame) -> DataFrame:
    """Leaves with newer writes added as rows of higher order; merge to resolve.

    ``changes`` has the columns of ``leaves``.
    """
    return leaves.unionByName(changes)


def register_explode_leaves(spark: SparkSession, name: str = "explode_leaves") -> None:
    """Leaves for SQL. Tables take the function over whole Arrow batches, ``<name>_array``, which gives a document's leaves
    as an array: ``SELECT t.*, l.* FROM t LATERAL VIEW inline(explode_leaves_array(t.doc)) l``. The table function
    ``LATERAL explode_leaves(t.doc)`` gives the same but is called row by row, several times slower."""

    @F.udtf(returnType="path string, value string, value_type string")
    class ExplodeLeaves:
        def eval(self, doc: str):
            yield from document_leaves(doc, False)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in LEAF])))
    def leaves(docs: pa.Array) -> pa.Array:
        found = [document_leaves(text, False) for text in docs.to_pylist()]
        items = pa.StructArray.from_arrays(leaf_arrays([leaf for doc in found for leaf in doc]), names=LEAF)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), items)

    spark.udtf.register(name, ExplodeLeaves)
    spark.udf.register(f"{name}_array", leaves)


# ---------------------------------------------------------------- merge and defaults


def merge_by_priority(leaves: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Layered documents merged from low to high ``priority``, later loads winning ties.

    Objects merge; any other value replaces the whole subtree below its path, and an object
    replaces a value. Empty objects are nodes like others when the leaves were flattened with them; an object
    that loses all it held stays as an empty one.

    Every path first keeps its latest value and the latest object seen at or around it, combined
    on the map side. One sweep in path order then carries the latest value above: a value lives if it is newer than
    the object at its path and than all values above it, an object if it is newer than all values at and
    above it.
    """
    keys = list(keys)
    # nulls of the order count as the lowest
    rank = F.struct("priority", "loaded_seq")
    is_object = F.col("value_type") == "dict"
    latest = leaves.groupBy(*keys, "path", is_object.alias("_is_object")).agg(F.max_by(F.struct(rank.alias("_rank"), "value", "value_type"), rank).alias("_n"))
    # what is seen at a path counts as an object for all paths above it
    parts = F.split("path", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    own = F.col("_path") == F.col("path")
    nodes = latest.select(*keys, "path", "_is_object", "_n", F.explode(above).alias("_path"))
    nodes = nodes.groupBy(*keys, F.col("_path").alias("_path")).agg(
        F.first(F.when(own & ~F.col("_is_object"), F.col("_n")), True).alias("_value"),
        F.max(F.when(~own | F.col("_is_object"), F.col("_n._rank"))).alias("_object"),
    )
    nodes = nodes.withColumns({"path": F.col("_path"), "_parts": F.split("_path", "[.]")})
    nodes = nodes.select(
        *keys,
        F.size("_parts").alias("_depth"),
        "path",
        "_parts",
        F.col("_value.value").alias("value"),
        F.col("_value.value_type").alias("value_type"),
        *[F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("_value._rank", "_v"), ("_object", "_o")) for c in ("priority", "loaded_seq")],
        F.col("_value").isNotNull().alias("_has_value"),
        F.col("_object").isNotNull().alias("_has_object"),
    )
    # a few rows per document are left: its distinct paths
    placed = nodes.repartition(*keys).sortWithinPartitions(*keys, "_parts").drop("_parts")
    order = [leaves.schema[c] for c in ("priority", "loaded_seq")]
    schema = T.StructType([*[leaves.schema[k] for k in keys], *[T.StructField(c, T.StringType()) for c in LEAF], *order])
    return placed.mapInArrow(lambda it: _sweep(it, keys), schema)


def _sweep(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Living nodes of documents that come in path order; holds one chain of objects at a time."""

    def level(priority, seq):
        return (priority is not None, priority or 0, seq is not None, seq or 0)

    none = ()  # below every rank
    document = None
    # per depth: path, latest value at or above, whether it is a living object without living nodes yet, its order
    chain: list[list] = []
    schema = None

    def close(depth: int) -> list[tuple]:
        done = []
        while len(chain) > depth:
            path, _, bare, order = chain.pop()
            if bare:
                done.append((*document, path, "{}", "dict", *order))
        return done

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        if schema is None:
            field = batch.schema.field
            named = [("priority", "_v_priority"), ("loaded_seq", "_v_loaded_seq")]
            schema = pa.schema([*[field(k) for k in keys], *[pa.field(c, pa.string()) for c in LEAF], *[pa.field(n, field(c).type) for n, c in named]])
        out = []
        columns = [batch.column(c).to_pylist() for c in ("_depth", *LEAF, "_v_priority", "_v_loaded_seq", "_o_priority", "_o_loaded_seq", "_has_value", "_has_object")]
        owners = zip(*[batch.column(k).to_pylist() for k in keys]) if keys else [()] * len(batch)
        for own, (depth, path, value, kind, vp, vs, op, os_, has_value, has_object) in zip(owners, zip(*columns)):
            if own != document:
                out += close(0)
                document = own
            out += close(depth - 1)
            above = chain[-1][1] if chain else none
            value_rank = level(vp, vs) if has_value else none
            object_rank = level(op, os_) if has_object else none
            lives = has_value and value_rank > object_rank and value_rank > above
            stands = has_object and object_rank >= value_rank and object_rank > above
            if lives or stands:
                for entry in chain:
                    entry[2] = False
            if lives:
                out.append((*own, path, value, kind, vp, vs))
            chain.append([path, max(above, value_rank), stands, (op, os_)])
        yield packed(out)
    if schema is not None:
        yield packed(close(0))


@dataclass(frozen=True)
class FieldRule:
    """Rule of one field, by path."""

    path: str
    type: str
    required: bool = True
    default: object = None
    min_value: float | None = None
    max_value: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    allowed_values: tuple | None = None
    regex_pattern: str | None = None
    item_type: str | None = None
    item_rules: tuple["FieldRule", ...] = ()

    @property
    def parent(self) -> str:
        return self.path.rpartition(".")[0]


def _document_map(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per document with ``doc``: path -> (value, value_type), and its object paths."""
    entry = F.struct("path", F.struct("value", "value_type").alias("leaf"))
    docs = leaves.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("doc"))
    around = F.flatten(F.transform(F.map_keys("doc"), _prefixes_of))
    empty = F.map_keys(F.map_filter("doc", lambda _, leaf: leaf["value_type"] == "dict"))
    return docs.withColumn("objects", F.array_distinct(F.concat(around, empty)))


def _prefixes_of(p: Column) -> Column:
    parts = F.split(p, "[.]")
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ".")
    )


def apply_defaults(leaves: DataFrame, rules: Sequence[FieldRule], keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Adds default values of absent fields; nested ones only where the object is present."""
    keys = list(keys)
    with_default = [r for r in rules if r.default is not None]
    if not with_default:
        return leaves.select(*keys, *LEAF)
    docs = _document_map(leaves, keys)
    added = []
    for r in with_default:
        absent = ~F.map_contains_key("doc", r.path) & ~F.array_contains("objects", r.path)
        nested = F.array_contains("objects", r.parent) if r.parent else F.lit(True)
        kind = {str: "string", bool: "bool", int: "int", float: "float"}.get(type(r.default), "list")
        text = r.default if isinstance(r.default, str) else json.dumps(r.default)
        row = F.struct(F.lit(r.path).alias("path"), F.lit(text).alias("value"), F.lit(kind).alias("value_type"))
        added.append(F.when(absent & nested, row))
    docs = docs.withColumn("_new", F.filter(F.array(*added), lambda x: x.isNotNull()))
    # an empty object that got a default is none any more
    filled = lambda e: (e.value["value_type"] == "dict") & F.exists("_new", lambda n: F.startswith(n["path"], F.concat(e.key, F.lit("."))))
    old = F.transform(
        F.filter(F.map_entries("doc"), lambda e: ~filled(e)),
        lambda e: F.struct(e.key.alias("path"), e.value["value"].alias("value"), e.value["value_type"].alias("value_type")),
    )
    return docs.select(*keys, F.inline(F.concat(old, F.col("_new"))))


# ---------------------------------------------------------------- values


def expand_vars(leaves: DataFrame, env: DataFrame | dict[str, str], keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Replaces ``${V}``, ``${V:-default}`` and ``${V:?message}`` in text, in one pass.

    ``env`` is a dictionary, or rows ``(keys, name, value)``. An unset ``${V}`` stays as it is;
    an unset required one gives ``error``. Text inside lists is expanded too.
    """
    keys = list(keys)
    if isinstance(env, dict):
        pairs = [F.lit(x) for kv in env.items() for x in kv]
        df = leaves.withColumn("_env", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))
    else:
        entry = F.struct("name", "value")
        maps = env.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_env"))
        df = leaves.join(maps, keys, "left").withColumn("_env", F.coalesce("_env", F.create_map().cast("map<string,string>")))
    pattern = r"\$\{([^}]+)\}"
    text = F.when(F.col("value_type").isin("string", "list"), F.col("value"))
    in_list = F.col("value_type") == "list"

    def escaped(v: Column) -> Column:
        return F.when(in_list, F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))).otherwise(v)

    def parts(e: Column) -> tuple[Column, Column, Column, Column]:
        dash, ask = F.instr(e, ":-"), F.instr(e, ":?")
        cut = F.when(dash > 0, dash).when(ask > 0, ask)
        name = F.trim(F.when(cut.isNotNull(), F.substring(e, F.lit(1), cut - 1)).otherwise(e))
        rest = F.when(cut.isNotNull(), F.substring(e, cut + 2, F.length(e)))
        return name, rest, dash, ask

    def value_of(e: Column) -> Column:
        name, rest, dash, _ask = parts(e)
        found = escaped(F.try_element_at("_env", name))
        return F.coalesce(found, F.when(dash > 0, rest), F.concat(F.lit("$"), F.lit("{"), e, F.lit("}")))

    def error_of(e: Column) -> Column:
        name, rest, dash, ask = parts(e)
        missing = (dash == 0) & (ask > 0) & F.try_element_at("_env", name).isNull()
        return F.when(missing, F.concat(F.lit("Environment variable "), name, F.lit(" not set: "), rest))

    df = df.withColumns({"_es": F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), "_ps": F.split(text, pattern, -1)})
    filled = F.zip_with("_ps", F.transform("_es", value_of), lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    errors = F.filter(F.transform("_es", error_of), lambda x: x.isNotNull())
    has = F.coalesce(F.size("_es") > 0, F.lit(False))
    out = df.withColumn("value", F.when(has, F.array_join(filled, "")).otherwise(F.col("value")))
    return out.withColumn("error", F.when(has, F.try_element_at(errors, F.lit(1)))).drop("_es", "_ps", "_env")


def mask_sensitive(leaves: DataFrame, words: Sequence[str] = tuple(SENSITIVE_WORDS), mask: str = "***") -> DataFrame:
    """Scalars under a sensitive last key become the mask; objects inside lists are masked too."""
    pattern = "(?i)" + "|".join(words)
    secret = F.element_at(F.split("path", "[.]"), -1).rlike(pattern) & F.col("value_type").isin("string", "int", "float", "bool")
    plain = leaves.withColumns(
        {"value": F.when(secret, mask).otherwise(F.col("value")), "value_type": F.when(secret, "string").otherwise(F.col("value_type"))}
    )
    compiled = re.compile(pattern)

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["value"] = [
                json.dumps(mask_tree(json.loads(v), compiled, mask), separators=(",", ":"), ensure_ascii=False) for v in frame["value"]
            ]
            yield frame

    nested = (F.col("value_type") == "list") & F.contains("value", F.lit("{"))
    lists = plain.where(nested).mapInPandas(inside, plain.schema)
    return plain.where(~F.coalesce(nested, F.lit(False))).unionByName(lists)


# ---------------------------------------------------------------- validation

PYTHON_NAMES = {"string": "str", "int": "int", "float": "float", "bool": "bool", "list": "list", "dict": "dict"}


def _rule_errors(rule: FieldRule, value: Column, kind: Column, label: Column) -> list[Column]:
    """Error texts of one value; null entries mean no error."""

    def say(condition: Column, *parts) -> Column:
        texts = [label, F.lit(": ")] + [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
        return F.when(condition, F.concat(*texts))

    got = kind
    for short, name in PYTHON_NAMES.items():
        got = F.when(kind == short, name).otherwise(got)

    def wrong(expected: str, *kinds: str) -> tuple[Column, Column]:
        good = kind.isin(*kinds)
        return good, say(~good, f"Expected {expected}, got ", got)

    def bounds(good: Column, size: Column, shown: Column, noun: str, low, high) -> list[Column]:
        out = []
        if low is not None:
            out.append(say(good & (size < low), f"{noun} ", shown, f" is less than minimum {low}"))
        if high is not None:
            out.append(say(good & (size > high), f"{noun} ", shown, f" exceeds maximum {high}"))
        return out

    t = rule.type
    if t in ("string", "regex", "path", "url"):
        good, first = wrong("string", "string")
        length = F.length(value)
        out = [first, *bounds(good, length, length.cast("string"), "String length", rule.min_length, rule.max_length)]
        if rule.regex_pattern:
            out.append(say(good & ~value.rlike(f"^(?:{rule.regex_pattern})"), f"String does not match pattern: {rule.regex_pattern}"))
        if t == "url":
            fine = ~F.exists(F.array(*out), lambda e: e.isNotNull()) & good
            out.append(say(fine & ~value.rlike(URL_PATTERN), "Invalid URL format"))
        return out
    if t in ("int", "port"):
        good, first = wrong("integer", "int")
        number = value.try_cast("double")
        out = [first, *bounds(good, number, value, "Value", rule.min_value, rule.max_value)]
        if t == "port":
            fine = ~F.exists(F.array(*out), lambda e: e.isNotNull()) & good
            out.append(say(fine & ~number.between(1, 65535), "Port number must be between 1 and 65535"))
        return out
    if t == "float":
        good, first = wrong("float", "int", "float")
        number = value.try_cast("double")
        return [first, *bounds(good, number, number.cast("string"), "Value", rule.min_value, rule.max_value)]
    if t == "bool":
        return [wrong("boolean", "bool")[1]]
    if t == "dict":
        return [wrong("dict", "dict")[1]]
    if t == "enum":
        if not rule.allowed_values:
            return []
        allowed = [str(v) for v in rule.allowed_values]
        return [say(~value.isin(allowed), "Value '", value, f"' not in allowed values: {list(rule.allowed_values)}")]
    if t == "list":
        good, first = wrong("list", "list")
        size = F.size(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"))
        return [first, *bounds(good, size, size.cast("string"), "List length", rule.min_length, rule.max_length)]
    raise ValueError(f"unknown type {t}")


def validate_fields(
    leaves: DataFrame, rules: Sequence[FieldRule], keys: Sequence[str] = ("scope",), cross: dict[str, Column] | None = None
) -> DataFrame:
    """Error rows ``(keys, path, message)`` of documents against field rules.

    ``cross`` maps a message to a condition over ``doc``: path -> (value, value_type).
    """
    keys = list(keys)
    docs = _document_map(leaves, keys)
    checks = []
    for r in rules:
        leaf = F.try_element_at("doc", F.lit(r.path))
        kind = F.when(F.array_contains("objects", r.path), "dict").otherwise(F.coalesce(leaf["value_type"], F.lit("null")))
        asked = (F.array_contains("objects", r.parent) | (F.try_element_at("doc", F.lit(r.parent))["value_type"] == "dict")) if r.parent else F.lit(True)
        asked = F.coalesce(asked, F.lit(False))
        given = asked & (kind != "null")
        errors = [F.when(given, e) for e in _rule_errors(r, leaf["value"], kind, F.lit(r.path))]
        if r.required and r.default is None:
            errors.append(F.when(asked & (kind == "null"), F.concat(F.lit(r.path), F.lit(": Required field is missing"))))
        checks += [F.when(e.isNotNull(), F.struct(F.lit(r.path).alias("path"), e.alias("message"))) for e in errors]
    for message, condition in (cross or {}).items():
        checks.append(F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit("").alias("path"), F.lit(message).alias("message"))))
    found = docs.select(*keys, F.inline(F.filter(F.array(*checks), lambda e: e.isNotNull())))
    for r in rules:
        if r.type == "list" and (r.item_type or r.item_rules):
            found = found.unionByName(_item_errors(leaves, r, keys))
    return found


def require_valid(errors: DataFrame, shown: int = 20) -> None:
    """Raise if there is any error row; the message names a few of them."""
    some = errors.select("message").limit(shown).collect()
    if some:
        raise ValueError("Configuration validation failed:\n" + "\n".join(f"  - {row.message}" for row in some))


def _item_errors(leaves: DataFrame, rule: FieldRule, keys: Sequence[str]) -> DataFrame:
    """Errors of the items of a list field."""
    lists = leaves.where((F.col("path") == rule.path) & (F.col("value_type") == "list"))
    items = lists.select(*keys, F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("_i", "_v"))
    typed = items.withColumn("_k", F.schema_of_variant("_v")).selectExpr(
        *keys, "_i", "_v", "CASE WHEN _k <> 'VOID' THEN string(_v) END AS _t", KIND_SQL.format(k="_k") + " AS _kind"
    )
    if rule.item_rules:
        objects = typed.where(F.col("_kind") == "dict").select(*keys, "_i", F.to_json("_v").alias("doc"))
        errors = validate_fields(flatten(objects), rule.item_rules, [*keys, "_i"])
        at = F.concat(F.lit(f"{rule.path}["), F.col("_i").cast("string"), F.lit("]."))
        return errors.select(*keys, F.concat(at, "path").alias("path"), F.concat(at, "message").alias("message"))
    label = F.concat(F.lit(f"{rule.path}."), F.col("_i").cast("string"))
    one = FieldRule(rule.path, rule.item_type, allowed_values=rule.allowed_values)
    missing = F.when(F.col("_kind") == "null", F.concat(label, F.lit(": Required field is missing")))
    errors = [missing] + [F.when(F.col("_kind") != "null", e) for e in _rule_errors(one, F.col("_t"), F.col("_kind"), label)]
    rows = typed.select(*keys, label.alias("path"), F.explode(F.filter(F.array(*errors), lambda e: e.isNotNull())).alias("message"))
    return rows


def unknown_fields(leaves: DataFrame, rules: Sequence[FieldRule], keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Fields of a document, or of a nested object that has rules, which no rule names."""
    known, parents = {r.path for r in rules}, {r.parent for r in rules}
    known |= {p for p in parents if p}
    own = F.concat(_prefixes_of(F.col("path")), F.array("path"))
    strange = F.filter(own, lambda p: ~p.isin(*known))
    # a name of its own: an alias that repeats a column would be picked up inside the lambdas
    found = leaves.withColumn("_first", F.try_element_at(strange, F.lit(1))).where(F.col("_first").isNotNull())
    parts = F.split("_first", "[.]")
    holder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")
    return found.where(holder.isin(*parents)).select(*keys, F.col("_first").alias("path")).distinct()


def missing_required(leaves: DataFrame, required: Sequence[str], keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Required paths that are absent or null, per document."""
    docs = _document_map(leaves, keys)
    wanted = F.array(*[F.lit(p) for p in required])

    def gone(p: Column) -> Column:
        kind = F.coalesce(F.try_element_at("doc", p)["value_type"], F.lit("null"))
        return (kind == "null") & ~F.array_contains("objects", p)

    return docs.select(*keys, F.explode(F.filter(wanted, gone)).alias("path"))


# ---------------------------------------------------------------- changes


def change_log(versions: DataFrame, keys: Sequence[str] = ("scope", "path"), width: int = 1_000_000) -> DataFrame:
    """Old and new value of every write, with ``changed`` false where they are equal."""
    stepped = previous(versions, keys, ["seq"], ["value"], number_chunk("seq", width), "_prev")
    out = stepped.withColumns({"old_value": F.col("_prev.value"), "new_value": F.col("value")}).drop("_prev", "value")
    return out.withColumn("changed", ~F.col("old_value").eqNullSafe(F.col("new_value")))


def diff_docs(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Paths whose value differs, or that only one side has."""
    keys = list(keys)
    a = old.select(*keys, "path", F.struct("value", "value_type").alias("_old"))
    b = new.select(*keys, "path", F.struct("value", "value_type").alias("_new"))
    both = a.join(b, [*keys, "path"], "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "path", F.col("_old.value").alias("old_value"), F.col("_new.value").alias("new_value"), change.alias("change"))


def config_source_info(leaves: DataFrame) -> DataFrame:
    """Per source: priority, last load and number of top-level keys."""
    top = F.element_at(F.split("path", "[.]"), 1)
    return leaves.groupBy("source").agg(
        F.max("priority").alias("priority"), F.max("loaded_seq").alias("loaded_seq"), F.count_distinct(top).alias("keys")
    )
