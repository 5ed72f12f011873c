"""Counts per key where a few keys hold most rows, by sorted ranges and stitched runs.

The rows are range-partitioned on (key, record, tie), whose quantiles Spark samples, so a
heavy key is spread over as many partitions as its share needs, and even copies of one
(key, record) pair are split by the tie.  Each partition is sorted (Spark's external sort)
and scanned once for runs, a run going on from batch to batch.  All runs of a partition but
its first and last are whole keys and final.  Only the first and last, at most two states a
partition, can go on in a neighbour: they carry their first and last record and are stitched
in order, a state that begins with the record its predecessor ended on counting one less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.sources.scratch import Scratch

#: Sub-order of equal pairs: copies of one pair can spread over so many ranges.
TIES = 4096
#: Rows of one input partition that have the same tie, as a power of two: equal neighbours cost next to nothing in a compressed shuffle.
SHARED = 10


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before (nulls are equal, NaNs too); the first is True."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(column.type):
            both = pc.and_(pc.is_nan(a), pc.is_nan(b))
            differs = differs & ~pc.fill_null(both, False).to_numpy(zero_copy_only=False)
        if column.null_count:
            differs = differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        out[1:] = differs
    return out


def _same(a: pa.Array, b: pa.Array) -> bool:
    """Are two values, each an array of one, equal as keys?"""
    return not _changes(pa.concat_arrays([a, b]))[1]


class _Run:
    """The run that is open where a batch ends."""

    def __init__(self, keys: list[pa.Array], rows: int, records: int, first: pa.Array, last: pa.Array):
        self.keys, self.rows, self.records, self.first, self.last = keys, rows, records, first, last

    def extend(self, other: _Run) -> None:
        self.rows += other.rows
        self.records += other.records - (self.last[0].is_valid and other.first[0].is_valid and _same(self.last, other.first))
        self.last = other.last


def _scan(keys: list[str], names: list[str]):
    def whole(columns: list, rows, records, edge: int | None, first: pa.Array, last: pa.Array) -> pa.RecordBatch:
        n = len(rows)
        at = pa.array([edge] * n, pa.int64())
        return pa.RecordBatch.from_arrays([*columns, at, pa.array(rows, pa.int64()), pa.array(records, pa.int64()), first, last], names=names)

    def state(run: _Run, edge: int | None) -> pa.RecordBatch:
        none = pa.nulls(1, run.first.type)
        return whole(run.keys, [run.rows], [run.records], edge, *((none, none) if edge is None else (run.first, run.last)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun, run = TaskContext.get().partitionId(), False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, record = [batch.column(k) for k in keys], batch.column("record")
            new_key = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                new_key |= _changes(c)
            new_record = (new_key | _changes(record)) & record.is_valid().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new_key)
            last = np.append(first[1:], batch.num_rows) - 1
            rows, records = last - first + 1, np.add.reduceat(new_record.astype(np.int64), first)

            def at(n: int) -> _Run:
                a, b = int(first[n]), int(last[n])
                return _Run([c.slice(a, 1) for c in columns], int(rows[n]), int(records[n]), record.slice(a, 1), record.slice(b, 1))

            head = at(0)
            if run is not None and all(map(_same, run.keys, head.keys)):
                run.extend(head)
            else:
                if run is not None:
                    yield state(run, None if begun else 2 * part)
                    begun = True
                run = head
            if len(first) == 1:
                continue
            yield state(run, None if begun else 2 * part)
            begun = True
            if len(first) > 2:
                inner = slice(1, -1)
                none = pa.nulls(len(first) - 2, record.type)
                yield whole([c.take(pa.array(first[inner])) for c in columns], rows[inner], records[inner], None, none, none)
            run = at(len(first) - 1)
        if run is not None:
            yield state(run, 2 * part + 1)

    return scan


def tie() -> Column:
    """A sub-order of rows, spread over partitions and over the blocks of rows of each."""
    row = F.monotonically_increasing_id()  # the partition above 33 bits of row number
    return F.pmod(F.shiftright(row, SHARED) + F.shiftright(row, 33) * 37, F.lit(TIES)).cast("smallint")


def run_states(df: DataFrame, keys: list[str], record: str) -> DataFrame:
    """(key0, key1..., at, rows, records, first, last): the runs of every range.

    ``at`` orders the first and last runs of the ranges and is null for all others, which are final.
    """
    fields = {f.name: f.dataType for f in df.schema}
    own = [f"key{n}" for n in range(len(keys))]
    pairs = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, own)], F.col(f"`{record}`").alias("record"), tie().alias("tie"))
    order = [*own, "record", "tie"]
    ranged = pairs.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    schema = T.StructType([T.StructField(n, fields[k]) for k, n in zip(keys, own)] + [T.StructField(n, T.LongType()) for n in ("at", "rows", "records")] + [T.StructField(n, fields[record]) for n in ("first", "last")])
    return ranged.mapInArrow(_scan(own, schema.names), schema)


def stitch(edges: DataFrame, own: list[str]) -> DataFrame:
    """(keys..., rows, records) of the runs at the ends of ranges, at most two a range."""
    before = F.lag("last").over(Window.partitionBy(*own).orderBy("at"))
    goes_on = F.coalesce((F.col("first") == before).cast("bigint"), F.lit(0))
    return edges.withColumn("goes_on", goes_on).groupBy(*own).agg(F.sum("rows").alias("rows"), F.sum(F.col("records") - F.col("goes_on")).alias("records"))


def count_runs(df: DataFrame, keys: list[str], record: str) -> DataFrame:
    """(keys..., rows, records): rows and distinct non-null records of every key.

    Null keys form a key of their own, null records count as rows only, as in SQL.  No rows
    give no rows; further columns of ``df`` are not read, whatever their names.  The runs are
    written once (see ``Scratch``); those at the ends of ranges alone are shuffled again.
    """
    own = [f"key{n}" for n in range(len(keys))]
    states = run_states(df, keys, record)
    written = Scratch(df.sparkSession, "runs").save(states, "states")
    counts = written.where("at is null").select(*own, "rows", "records").unionByName(stitch(written.where("at is not null"), own))
    return counts.select(*[F.col(n).alias(k) for k, n in zip(keys, own)], "rows", "records")


def graph_key_counts(relations: DataFrame) -> DataFrame:
    """(field, key_id, rows, subjects) of every predicate and every object of ``relations``.

    Both columns go through one exchange.  Null ids count under a null ``key_id``.
    """
    pairs = relations.select(F.expr("stack(2, cast(0 as tinyint), predicate, cast(1 as tinyint), object) as (field, key_id)"), "subject")
    counts = count_runs(pairs, ["field", "key_id"], "subject")
    return counts.select(F.when(F.col("field") == 0, "predicate").otherwise("object").alias("field"), "key_id", "rows", F.col("records").alias("subjects"))
