"""Vintage tables that are kept, and merged with what arrives (inventory F7-F11, A7).

The table is dealt to buckets of series.  A merge reads, rewrites and publishes the buckets of the series that arrived and
no others; readers see, of each bucket, its last commit, so a merge shows as a whole or not at all, and one whose key has a
commit is a no-op.  One writer at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.vintages import VINTAGE, merged
from tidemark.sources.tables import commits, publish

_ROWS = ", ".join(f"{n} {t}" for n, t in VINTAGE.items())


PART_ROWS = 1_000_000   # of a bucket for each task that merges it


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int").alias("bucket")


def _rows_of(df: DataFrame, buckets: int) -> Counter:
    """Rows by bucket, at most as many as there are buckets."""
    return Counter({r["bucket"]: r["count"] for r in df.groupBy(_bucket(buckets)).count().collect()})


def _current(spark: SparkSession, path: str) -> tuple[dict[int, str], int | None]:
    """The folder of each bucket's last commit, at most one row a bucket, and the number of buckets."""
    part = F.explode("sources").alias("part")
    last = commits(spark, path).select("committed", "folder", part).where(F.col("part").startswith("bucket=")).groupBy("part").agg(
        F.max_by("folder", F.struct("committed", "folder")).alias("folder")).collect()
    held, total = {}, None
    for r in last:
        number, total = (int(x) for x in r["part"].removeprefix("bucket=").split("/"))
        held[number] = r["folder"]
    return held, total


def _read(spark: SparkSession, held: dict[int, str], wanted: Iterable[int]) -> DataFrame:
    paths = [f"{held[b]}/bucket={b}" for b in sorted(wanted) if b in held]
    return spark.read.schema(_ROWS).parquet(*paths) if paths else spark.createDataFrame([], _ROWS)


def read_vintage_table(spark: SparkSession, path: str) -> DataFrame:
    """The merged table: series_id, date, realtime_start, realtime_end, value; empty where nothing was merged yet."""
    held, _ = _current(spark, path)
    return _read(spark, held, held)


def merge_vintages(arrived: DataFrame, path: str, key: str, buckets: int = 64) -> DataFrame:
    """Merges vintages (series_id, date, realtime_start, value) into the table at a path; the commit.

    The number of buckets is that of the table's first merge.  What ``operators.vintages.merged`` states holds of late,
    repeated and revised vintages.  An empty arrival is a commit without rows.  ``arrived`` is read twice (its buckets, its rows),
    and so are the buckets that it touches.
    """
    spark = arrived.sparkSession
    known = commits(spark, path).where(F.col("key") == key)
    if not known.isEmpty():
        return known.orderBy("committed", "folder").limit(1)
    held, total = _current(spark, path)
    total = total or buckets
    arrived = arrived.select(*(F.col(n).cast(t).alias(n) for n, t in VINTAGE.items() if n != "realtime_end"))
    sizes = _rows_of(arrived, total)
    touched = list(sizes)
    before = _read(spark, held, touched)
    sizes += _rows_of(before, total)
    # a bucket is dealt by observation to as many parts as its rows ask for, and one shuffle serves the merge and the writing
    parts = F.array(*(F.lit(-(-sizes[b] // PART_ROWS) or 1) for b in range(total)))
    part = F.pmod(F.xxhash64("series_id", "date"), F.get(parts, _bucket(total)))
    rows = merged(before, arrived, bucket=_bucket(total), part=part).drop("part")
    return publish(rows, path, key, [f"bucket={b}/{total}" for b in sorted(touched)], "merge_vintages", ["bucket"])
