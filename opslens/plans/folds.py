"""Order-dependent folds over keys of any size.

A fold whose step depends on the state so far cannot be a window frame. If the effect of a
chunk of rows can be written down without knowing the state before it, the fold still runs
in parallel inside one key:

1. the rows of each (key, chunk) are folded into a short summary,
2. the summaries of a key, one short row per chunk, are chained in order,
3. the rows of each (key, chunk) are replayed from the state they start with.

Steps 1 and 3 read sorted partitions as a stream of Arrow batches and hold one summary or
state at a time, never a whole group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string


class Fold:
    """What a chunked fold computes. Summaries and states travel as text."""

    # columns of the row handed to ``absorb`` and ``step``
    columns: tuple[str, ...] = ()
    # names and Spark types that ``step`` adds to each row
    outputs: str = ""

    def empty(self):
        """Summary of no rows."""
        raise NotImplementedError

    def absorb(self, summary, row: tuple):
        """Summary after one more row."""
        raise NotImplementedError

    def dump(self, summary) -> str:
        raise NotImplementedError

    def first_state(self) -> str:
        """State before the first row of a key."""
        raise NotImplementedError

    def advance(self, state: str, summary: str) -> str:
        """State after a chunk with this summary."""
        raise NotImplementedError

    def load(self, state: str):
        raise NotImplementedError

    def step(self, state, row: tuple):
        """New state and the tuple of output values of this row."""
        raise NotImplementedError


def _values(batch: pa.RecordBatch, names: Sequence[str]) -> Iterable[tuple]:
    """Rows of the named columns; empty tuples if there are none."""
    if not names:
        return (() for _ in range(batch.num_rows))
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _with_text(df: DataFrame, names: Sequence[str]) -> StructType:
    return StructType([*[df.schema[n] for n in names], StructField("_text", StringType())])


def _summaries(base: DataFrame, part: list[str], order: list[str], fold: Fold) -> DataFrame:
    """Summary text of each (key, chunk)."""
    schema = _with_text(base, part)
    arrow = to_arrow_schema(schema)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, summary = None, None
        for batch in batches:
            done = []
            for key, row in zip(_values(batch, part), _values(batch, fold.columns)):
                if key != group:
                    if group is not None:
                        done.append((*group, fold.dump(summary)))
                    group, summary = key, fold.empty()
                summary = fold.absorb(summary, row)
            if done:
                yield _batch(done, arrow)
        if group is not None:
            yield _batch([(*group, fold.dump(summary))], arrow)

    narrow = base.select(*dict.fromkeys([*part, *order, *fold.columns]))
    return narrow.repartition(*part).sortWithinPartitions(*part, *order).mapInArrow(summarise, schema)


def _chained(summaries: DataFrame, keys: list[str], fold: Fold, after: bool) -> DataFrame:
    """State text before each chunk, or with ``after`` the state after the last one per key."""
    names = keys if after else keys + ["_chunk"]
    schema = _with_text(summaries, names)
    arrow = to_arrow_schema(schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            done = []
            for *key, number, text in _values(batch, [*keys, "_chunk", "_text"]):
                if key != group:
                    if after and group is not None:
                        done.append((*group, state))
                    group, state = key, fold.first_state()
                if not after:
                    done.append((*key, number, state))
                state = fold.advance(state, text)
            yield _batch(done, arrow)
        if after and group is not None:
            yield _batch([(*group, state)], arrow)

    by_key = summaries.repartition(*keys) if keys else summaries.repartition(1)
    return by_key.sortWithinPartitions(*keys, "_chunk").mapInArrow(chain, schema)


def folded_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, fold: Fold) -> DataFrame:
    """Final state text (``state``) of every key."""
    keys, order = list(keys), list(order)
    base = df.withColumn("_chunk", chunk.cast("bigint"))
    states = _chained(_summaries(base, keys + ["_chunk"], order, fold), keys, fold, after=True)
    return states.withColumnRenamed("_text", "state")


def chunked_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, fold: Fold) -> DataFrame:
    """The rows of ``df`` with the outputs of ``fold`` added, folded per key in ``order``."""
    keys, order = list(keys), list(order)
    base = df.withColumn("_chunk", chunk.cast("bigint"))
    part = keys + ["_chunk"]
    added = _parse_datatype_string(fold.outputs)
    out_schema = StructType([*df.schema.fields, *added.fields])
    added_arrow, out_arrow = to_arrow_schema(added), to_arrow_schema(out_schema)
    kept = df.columns

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            mask, values = [], []
            for key, (mark, text), row in zip(_values(batch, part), _values(batch, ["_mark", "_text"]), _values(batch, fold.columns)):
                if key != group:
                    group, state = key, fold.load(fold.first_state())
                if mark == 0:
                    state = fold.load(text)
                else:
                    state, out = fold.step(state, row)
                    values.append(out)
                mask.append(mark == 1)
            rows = batch.filter(pa.array(mask, pa.bool_()))
            columns = list(zip(*values)) if values else [()] * len(added_arrow)
            arrays = [rows.column(rows.schema.get_field_index(n)).cast(f.type) for n, f in zip(kept, out_arrow)]
            arrays += [pa.array(list(c), f.type) for c, f in zip(columns, added_arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out_arrow)

    marked = base.withColumns({"_mark": F.lit(1), "_text": F.lit(None).cast("string")})
    states = _chained(_summaries(base, part, order, fold), keys, fold, after=False)
    marked = marked.unionByName(states.withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    return marked.repartition(*part).sortWithinPartitions(*part, "_mark", *order).mapInArrow(replay, out_schema)
