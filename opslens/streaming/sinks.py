"""Delivery of streaming rows to handlers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.operators.alerts import notify


LEDGER = "batch_id long, handler string, error string"


def deliver(
    stream: DataFrame,
    handlers: dict[str, Callable[[DataFrame, int], None]],
    checkpoint: str,
    on_error: Callable[[str, int, str], None] | None = None,
    trigger: dict | None = None,
):
    """Start a query that hands every micro-batch to each handler.

    A failing handler is reported and does not stop the others. A batch is computed once for all
    handlers. What each handler did with each batch is noted in a ledger next to the checkpoint; if
    Spark repeats the last batch after a restart, handlers that had finished it are passed over and those
    that failed get it again. Only a handler that ended without its note being written sees a batch
    twice, with the same batch id: one that writes by that id still delivers each row once.
    """
    spark = stream.sparkSession
    entries = read_ledger(spark, checkpoint)
    # only the last batch of an earlier run can come again: one row per handler
    last = entries.agg(F.max("batch_id").alias("batch_id")).where("batch_id IS NOT NULL")
    finished = {(r.batch_id, r.handler) for r in entries.where("error IS NULL").join(last, "batch_id", "left_semi").collect()}

    def each(batch: DataFrame, batch_id: int) -> None:
        todo = {name: handler for name, handler in handlers.items() if (batch_id, name) not in finished}
        if len(todo) > 1:
            batch.persist()
        try:
            for name, handler in todo.items():
                error = notify(batch, {name: lambda df, h=handler: h(df, batch_id)}).get(name)
                _note(spark, checkpoint, batch_id, name, error)
                if error is not None and on_error is not None:
                    on_error(name, batch_id, error)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _note(spark: SparkSession, checkpoint: str, batch_id: int, handler: str, error: str | None) -> None:
    row = spark.range(1, numPartitions=1).select(
        F.lit(batch_id).cast("long").alias("batch_id"), F.lit(handler).alias("handler"), F.lit(error).cast("string").alias("error")
    )
    row.write.mode("append").parquet(f"{checkpoint.rstrip('/')}_ledger")


def read_ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What handlers did: ``(batch_id, handler, error)``, a null error for success; no rows before the first batch."""
    path = f"{checkpoint.rstrip('/')}_ledger"
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that writes each batch to its own folder, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
