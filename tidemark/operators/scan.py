"""Prefix scans over an order that no task could hold: running totals, and the last known value.

Rows are dealt to ranges of their order, so many as their bytes ask for, and each range is scanned by its own task.  What a
range hands to the later ones is a row per group that lies in it (a total) or one row (a value); these rows are scanned in
turn and join the ranges again.  Neither the number of groups nor that of ranges is limited, no cut points travel with the
rows, and a group that holds everything is as many ranges as any other rows of that size.

The scanned rows are written to the shared folder before their totals are taken: both look at the same ranges even when
executors are lost, and the input is computed once for its sample and once for its rows (only once where it ends in a shuffle).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import TASK_BYTES, cut

RANGE_BYTES = 128 << 20   # of the tables that are read, for each range
UNKNOWN_BYTES = 1 << 60   # a size from here on is Spark's word for not known


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as far as they are known.

    For a frame whose lineage was cut Spark keeps the estimate of its plan, which for a join is the product of both sides.
    Its partitions tell more: they come from shuffles whose tasks are bounded by TASK_BYTES.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = []
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        is_cut = leaf.getClass().getSimpleName() == "LogicalRDD"
        sizes.append(leaf.rdd().getNumPartitions() * (int(TASK_BYTES[:-1]) << 20) if is_cut else int(leaf.stats().sizeInBytes()))
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


def range_count(df: DataFrame) -> int:
    """Ranges by bytes; at least as many as the session shuffles into."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // RANGE_BYTES))


def _ranged(df: DataFrame, order: Sequence[str], ranges: int | None) -> DataFrame:
    return df.repartitionByRange(ranges or range_count(df), *order).sortWithinPartitions(*order)


def _summed(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the range's number and the sum of ``column`` over its rows before."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reached = TaskContext.get().partitionId(), 0
        for batch in batches:
            w = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(w) + reached
            reached = int(run[-1]) if len(run) else reached
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(w), part, np.int64)), pa.array(run - w)],
                                             [*batch.schema.names, "__part", "__run"])
    return scan


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column | None = None,
                   ranges: int | None = None) -> DataFrame:
    """Adds ``before`` (whole-numbered weight of the rows earlier in the group's order) and ``total`` (that of the group);
    without a weight, rows are counted.  Rows with a null key go.  ``order`` tells the rows of a group apart."""
    rows = df.where(reduce(and_, (F.col(f"`{k}`").isNotNull() for k in keys), F.lit(True)))
    if weight is None:   # the place of a row in its range is its number; no row leaves the JVM
        ranged = _ranged(rows, [*keys, *order], ranges).withColumn("__id", F.monotonically_increasing_id())
        scanned = cut(ranged.withColumns({"__part": F.shiftright("__id", 33), "__run": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)),
                                          "__w": F.lit(1).cast("long")}).drop("__id"))
    else:
        ranged = _ranged(rows.withColumn("__w", weight.cast("long")), [*keys, *order], ranges)
        schema = T.StructType([*ranged.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__run", T.LongType())])
        scanned = cut(ranged.mapInArrow(_summed("__w"), schema))
    group = Window.partitionBy(*keys)   # a row per range that the group lies in
    earlier = F.sum("__in").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = scanned.groupBy(*keys, "__part").agg(F.min("__run").alias("__first"), F.sum("__w").alias("__in"))
    runs = runs.select(*keys, "__part", (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__off"), F.sum("__in").over(group).alias("total"))
    out = scanned.join(runs, [*keys, "__part"])
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__off") + F.col("__run")).alias("before"), "total")


def _filled(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the range's number, the row's place in it, and the last known ``column`` up to the row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            own = batch.column(column)
            n = len(own)
            both = pa.concat_arrays([pa.nulls(1, own.type) if last is None else last, own])
            known = np.where(both.is_valid().to_numpy(zero_copy_only=False), np.arange(n + 1), 0)
            filled = both.take(pa.array(np.maximum.accumulate(known)[1:]))
            last = filled.slice(n - 1) if n else last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n)), filled],
                                             [*batch.schema.names, "__part", "__at", "__last"])
            at += n
    return scan


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Adds ``out``: the latest ``value`` that is not null, of the row itself or an earlier one of its group."""
    known = F.when(F.col(value).isNotNull(), F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), F.col(value).alias("value")))
    ranged = _ranged(df.withColumn("__known", known), [*keys, *order], ranges)
    fields = [T.StructField("__part", T.LongType()), T.StructField("__at", T.LongType()), T.StructField("__last", ranged.schema["__known"].dataType)]
    scanned = cut(ranged.mapInArrow(_filled("__known"), T.StructType([*ranged.schema.fields, *fields])))
    # what a range leaves to the next ones: a row per range
    ends = scanned.where("__known IS NOT NULL").groupBy("__part").agg(F.max_by("__known", "__at").alias("__end"))
    ends = scanned.groupBy("__part").agg(F.lit(None).alias("__x")).select("__part").join(ends, "__part", "left")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("__part", F.last("__end", ignorenulls=True).over(earlier).alias("__carry"))
    joined = scanned.join(carry, "__part", "left").withColumn("__last", F.coalesce("__last", "__carry"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col("__last")[f"k{i}"].eqNullSafe(F.col(f"`{k}`"))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.when(same, F.col("__last")["value"]).alias(out))
