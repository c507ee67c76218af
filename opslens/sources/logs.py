"""Structured JSON log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EXCEPTION_SCHEMA = "struct<type:string,message:string,traceback:array<string>>"
KNOWN_FIELDS = [
    "timestamp",
    "level",
    "logger",
    "message",
    "module",
    "function",
    "line",
    "thread_id",
    "thread_name",
    "exception",
    "context",
]


def parse_structured_logs(lines: DataFrame) -> DataFrame:
    """Parse text rows (``value``) into log records; unknown fields go to ``extra``.

    Works on batch and streaming frames. A line that is not JSON keeps its text in
    ``_corrupt_record``. ``extra`` and ``context`` are text, their values as JSON types them are in
    ``extra_values`` and ``context_values``.
    """
    # the line is parsed once; nested values are parsed only where they are present
    fields = lines.select("value", F.from_json("value", "map<string,string>").alias("_m"), F.from_json("value", "map<string,variant>").alias("_v"))
    known = ", ".join(f"'{k}'" for k in KNOWN_FIELDS)
    return fields.selectExpr(
        *[f"_m['{k}'] AS {k}" for k in KNOWN_FIELDS[:6]],
        "try_cast(_m['line'] AS bigint) AS line",
        "try_cast(_m['thread_id'] AS bigint) AS thread_id",
        "_m['thread_name'] AS thread_name",
        f"from_json(_m['exception'], '{EXCEPTION_SCHEMA}') AS exception",
        "from_json(_m['context'], 'map<string,string>') AS context",
        "CASE WHEN _m IS NULL THEN value END AS _corrupt_record",
        f"map_filter(_m, (k, v) -> k NOT IN ({known})) AS extra",
        "try_to_timestamp(_m['timestamp']) AS ts",
        f"map_filter(_v, (k, v) -> k NOT IN ({known})) AS extra_values",
        "try_variant_get(_v['context'], '$', 'map<string,variant>') AS context_values",
    )


def read_structured_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_structured_logs(spark.read.text(path))


def stream_structured_logs(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return parse_structured_logs(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def format_structured_logs(records: DataFrame) -> DataFrame:
    """Log records as JSON lines with the extras at the top level, and their date.

    Where the typed values of extras and context are there, they are written, so numbers, booleans and
    objects come back as they were; text otherwise.
    """
    typed = {c: f"{c}_values" if f"{c}_values" in records.columns else c for c in ("extra", "context")}
    base = F.to_json(F.struct(*[F.col(typed.get(c, c)).alias(c) for c in KNOWN_FIELDS if typed.get(c, c) in records.columns]))
    extra = typed["extra"]
    if extra in records.columns:
        more = F.to_json(extra)
        # a record without fields of its own is its extras alone
        own = F.expr("CASE WHEN _base = '{}' THEN '{' ELSE concat(substring(_base, 1, length(_base) - 1), ',') END")
        joined = F.concat(own, F.expr("substring(_more, 2)"))
        line = F.when(F.coalesce(F.size(extra), F.lit(0)) > 0, joined).otherwise(F.col("_base"))
        out = records.withColumns({"_base": base, "_more": more}).withColumn("value", line)
    else:
        out = records.withColumn("value", base)
    return out.select("value", F.substring("timestamp", 1, 10).alias("date"))


def write_structured_logs(records: DataFrame, path: str) -> None:
    """One text folder per date."""
    format_structured_logs(records).write.mode("append").partitionBy("date").text(path)
