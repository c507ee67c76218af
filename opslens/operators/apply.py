"""Task bodies applied to tables: column expressions first, pandas where needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions.strictjson import strict_json
from opslens.session import scratch_path



def apply_by_type(
    tasks: DataFrame,
    registry: dict[str, Column],
    functions: dict[str, Callable[[pd.DataFrame], pd.Series]] | None = None,
) -> DataFrame:
    """Runs the body registered for each task type and gives result rows.

    ``registry`` maps types to expressions; ``functions`` maps further types to functions over a
    pandas batch that return one value per row. A row whose body fails, or whose type nobody
    handles, becomes ``success=false`` with the error; the others are not affected.
    """
    functions = functions or {}
    value = F.lit(None).cast("double")
    for name, body in registry.items():
        value = F.when(F.col("task_type") == name, body.cast("double")).otherwise(value)
    known = F.coalesce(F.col("task_type").isin(*registry), F.lit(False)) if registry else F.lit(False)
    nobody = F.concat(F.lit("No worker pool for task type: "), F.coalesce("task_type", F.lit("none")))
    by_function = F.coalesce(F.col("task_type").isin(*functions), F.lit(False)) if functions else F.lit(False)
    out = tasks.where(~by_function).select(
        "task_id",
        (known & value.isNotNull()).alias("success"),
        F.when(known, value).alias("result"),
        F.when(~known, nobody).when(value.isNull(), F.lit("no result")).alias("error"),
    )
    if functions:
        # only the rows that need Python go there
        mine = tasks.where(by_function)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for name, part in frame.groupby("task_type", sort=False):
                    yield _run_batch(part, functions[name])

        kind = tasks.schema["task_id"].dataType.simpleString()
        out = out.unionByName(mine.mapInPandas(run, f"task_id {kind}, success boolean, result double, error string"))
    return out


def _run_batch(part: pd.DataFrame, body: Callable[[pd.DataFrame], pd.Series]) -> pd.DataFrame:
    """The whole batch at once; a batch that fails is halved until the rows at fault stand alone."""
    ids = part["task_id"].to_numpy()
    try:
        values = pd.Series(body(part)).astype(float).to_numpy()
        return pd.DataFrame({"task_id": ids, "success": True, "result": values, "error": None})
    except Exception as error:
        if len(part) == 1:
            return pd.DataFrame({"task_id": ids, "success": False, "result": None, "error": str(error)})
        half = len(part) // 2
        return pd.concat([_run_batch(p, body) for p in (part.iloc[:half], part.iloc[half:])], ignore_index=True)


def run_with_retry(
    tasks: DataFrame,
    registry: dict[str, Column],
    functions: dict[str, Callable[[pd.DataFrame], pd.Series]] | None = None,
    max_retries: int = 3,
) -> DataFrame:
    """Attempts of every task by the bodies of ``apply_by_type``: those that failed run again, the others do not.

    Bodies see the number of the attempt as column ``attempt``. Every attempt is written before the next one starts, so
    a lost executor repeats none that is done; the input shrinks to the failed tasks. Columns: ``task_id,
    attempt, success, result, outcome, error``. ``task_id`` is unique and not null. Runs its jobs at once.
    """
    spark = tasks.sparkSession
    path = scratch_path(spark, "attempts")
    left = tasks
    for attempt in range(1, max_retries + 2):
        part = f"{path}/attempt={attempt}"
        apply_by_type(left.withColumn("attempt", F.lit(attempt)), registry, functions).write.parquet(part)
        failed = spark.read.parquet(part).where(~F.col("success")).select("task_id")
        if attempt > max_retries or failed.isEmpty():
            break
        left = tasks.join(failed, "task_id", "left_semi")
    tried = spark.read.option("basePath", path).parquet(path)
    outcome = F.when(F.col("success"), "completed").when(F.col("attempt") > max_retries, "failed").otherwise("retried")
    return tried.select("task_id", "attempt", "success", "result", outcome.alias("outcome"), "error")


def apply_with_retry(tasks: DataFrame, body: Callable[[Column], Column], error: Callable[[Column], Column], max_retries: int = 3) -> DataFrame:
    """Attempts of every task: a failed one is tried again with one step lower priority.

    ``body`` and ``error`` give the result and the error text (null = success) of the attempt
    number. All attempts are one array expression per row, so there is no loop of jobs.
    """
    numbers = F.sequence(F.lit(1), F.lit(max_retries + 1))
    tried = F.transform(numbers, lambda n: F.struct(n.alias("attempt"), body(n).cast("double").alias("result"), error(n).alias("error")))
    rows = tasks.select("task_id", "priority5", tried.alias("_all"))
    good = F.filter(F.transform("_all", lambda a: F.when(a.error.isNull(), a.attempt)), lambda n: n.isNotNull())
    last = F.coalesce(F.array_min(good), F.lit(max_retries + 1))
    used = rows.withColumn("_last", last).select("task_id", "priority5", "_last", F.inline("_all")).where(F.col("attempt") <= F.col("_last"))
    ok = F.col("error").isNull()
    return used.select(
        "task_id",
        "attempt",
        F.least(F.col("priority5") + F.col("attempt") - 1, F.lit(4)).cast("int").alias("priority5"),
        ok.alias("success"),
        F.when(ok, F.col("result")).alias("result"),
        F.when(ok, "completed").when(F.col("attempt") == max_retries + 1, "failed").otherwise("retried").alias("outcome"),
        "error",
    )


def eval_arithmetic(payloads: DataFrame, op: str = "operation", a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``result`` and ``error``; division by zero gives null, an unknown operation an error."""
    x, y, what = F.col(a).cast("double"), F.col(b).cast("double"), F.col(op)
    known = what.isin("add", "subtract", "multiply", "divide")
    result = (
        F.when(what == "add", x + y).when(what == "subtract", x - y).when(what == "multiply", x * y).when(what == "divide", F.try_divide(x, y))
    )
    unknown = F.concat(F.lit("Unknown operation: "), F.coalesce(what, F.lit("none")))
    return payloads.withColumns({"result": result, "error": F.when(~F.coalesce(known, F.lit(False)), unknown)})


CODECS = ("json", "base64", "framed")


def decode_messages(messages: DataFrame, codec: str, column: str = "data", prefix: str = "<MSG>", suffix: str = "</MSG>") -> DataFrame:
    """Adds ``value`` (text) or ``error``; a message that cannot be decoded does not stop the rest."""
    data = F.col(column)
    if codec == "json":
        value, message = F.to_json(strict_json(data)), "Cannot decode JSON data"
    elif codec == "base64":
        value, message = F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string")), "Cannot decode Base64 data"
    elif codec == "framed":
        framed = data.startswith(prefix) & data.endswith(suffix)
        inner = F.substring(data, F.lit(len(prefix) + 1), F.length(data) - len(prefix) - len(suffix))
        value, message = F.when(framed, inner), "Invalid message format"
    else:
        raise ValueError(f"unknown codec {codec}")
    return messages.withColumns({"value": value, "error": F.when(value.isNull(), F.lit(message))})


def encode_messages(messages: DataFrame, codec: str, column: str = "data", prefix: str = "<MSG>", suffix: str = "</MSG>") -> DataFrame:
    data = F.col(column)
    if codec == "json":
        encoded = F.expr(f"substring(to_json(named_struct('v', `{column}`)), 6, length(to_json(named_struct('v', `{column}`))) - 6)")
    elif codec == "base64":
        encoded = F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit(""))
    elif codec == "framed":
        encoded = F.concat(F.lit(prefix), data, F.lit(suffix))
    else:
        raise ValueError(f"unknown codec {codec}")
    return messages.withColumn("encoded", encoded)


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and dead letters."""
    return decoded.where(F.col("error").isNull()), decoded.where(F.col("error").isNotNull())
