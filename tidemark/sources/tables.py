"""Tables in, tables out (inventory A1-A4, A18, A19)."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import nan_to_null, require_columns
from tidemark.operators.features import build_features
from tidemark.operators.order import positions
from tidemark.specs import FeatureSpec, definition_hash


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A1. A Parquet table, chosen columns only; NaN becomes null and zoneless timestamps are read as UTC."""
    df = spark.read.parquet(path)
    if columns:
        require_columns(df, *columns)
        df = df.select(*columns)
    zoneless = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields
                if isinstance(f.dataType, T.TimestampNTZType)}
    return nan_to_null(df.withColumns(zoneless) if zoneless else df)


def list_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A2. Name, rows and columns of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows",
                                                               F.lit(len(df.columns)).cast("long").alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def table_preview(df: DataFrame, n: int, order_by: Sequence[str], width: int = 40) -> DataFrame:
    """A3. The first n rows in order, every cell as text of at most ``width`` characters."""
    first = df.orderBy(*order_by).limit(n)
    return first.select(*[F.coalesce(F.substring(F.col(c).cast("string"), 1, width), F.lit("")).alias(c)
                          for c in df.columns])


SPREAD = (0.1, 0.3, 0.5, 0.7, 0.9)


def spread_sample(df: DataFrame, time: str, tie: Sequence[str] = (), probs: Sequence[float] = SPREAD) -> DataFrame:
    """A4. The records at the given shares of the table's time order (positions from per-range counts, no global
    sort in one task)."""
    p = positions(df.where(F.col(time).isNotNull()), [], [time, *tie], "_pos")
    at = [F.floor((F.col("group_n") - 1) * F.lit(q)) for q in probs]
    return p.where(F.col("_pos").isin(*at)).drop("_pos", "group_n")


def content_hash(df: DataFrame):
    """An order-free fingerprint of the rows: the sum of their hashes, each modulo 2^61 - 1.

    Thirds of 21 bits are summed as whole numbers, which is faster than decimals and exact for 2^42 rows."""
    cells = [F.to_json(c) if isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(c)
             for c in df.columns]
    h = F.pmod(F.xxhash64(*cells), F.lit(2305843009213693951))
    low, middle, high = (F.sum(F.shiftright(h, 21 * i).bitwiseAND(F.lit((1 << 21) - 1))).cast("decimal(20,0)") for i in range(3))
    return ((high * F.lit(1 << 42) + middle * F.lit(1 << 21)) + low).cast("decimal(38,0)")


def manifest_of(df: DataFrame, path: str, sources: Sequence[str], producer: str, name: str = "") -> DataFrame:
    """A18. One row of provenance for a table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), content_hash(df).cast("string").alias("content_hash")).select(
        F.lit(path).alias("path"), F.lit(name).alias("definition"), F.lit(producer).alias("producer"),
        F.array(*[F.lit(s) for s in sources]).cast("array<string>").alias("sources"), "rows", "content_hash")


def write_with_manifest(df: DataFrame, path: str, sources: Sequence[str] = (), producer: str = "tidemark",
                        manifest: str | None = None, name: str = "", partition_by: Sequence[str] = ()) -> DataFrame:
    """A18. Writes the table, appends its provenance to the manifest table, returns the manifest row.

    The fingerprint is taken from what was written, so it describes the files and not a second evaluation.
    """
    w = df.write.mode("error")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    row = manifest_of(df.sparkSession.read.parquet(path), path, sources, producer, name)
    if manifest:
        row.coalesce(1).write.mode("append").parquet(manifest)
    return row


_COMMITS = "key string, folder string, producer string, sources array<string>, rows long, content_hash string, committed timestamp"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """A18. What has been published at a path; nothing where nothing has."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path.rstrip('/')}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def _committed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The commit of a key; of several writers that were at it together, the first."""
    return commits(spark, path).where(F.col("key") == key).orderBy("committed", "folder").limit(1)


def publish(df: DataFrame, path: str, key: str, sources: Sequence[str] = (), producer: str = "tidemark",
            partition_by: Sequence[str] = ()) -> DataFrame:
    """A18. Publishes the rows under a key, and returns the commit: key, folder, producer, sources, rows, content_hash, committed.

    The tasks that write report their rows and hashes, so the count of a task that was lost is that of its repetition.
    The written files are read again; only if they hold what was reported is a commit appended, and only what has a
    commit is ever read.  A key that has one is left as it is, and nothing is computed.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if _committed(spark, path, key).isEmpty():
        folder, told = f"{path}/data-{uuid.uuid4().hex}", Observation()
        w = df.observe(told, F.count(F.lit(1)).alias("rows"), content_hash(df).cast("string").alias("content_hash")).write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(folder)
        held = spark.read.schema(df.schema).parquet(folder).select(*df.columns)
        found = held.agg(F.count(F.lit(1)).alias("rows"), content_hash(held).cast("string").alias("content_hash")).first()
        if found.asDict() != dict(told.get):
            raise OSError(f"{folder} holds {found.asDict()}, but {dict(told.get)} was written; nothing is published")
        row = [(key, folder, producer, list(sources), found["rows"], found["content_hash"], dt.datetime.now(dt.timezone.utc))]
        spark.createDataFrame(row, _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return _committed(spark, path, key)


def read_published(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A18. The rows published under a key."""
    commit = _committed(spark, path, key).first()
    if commit is None:
        raise ValueError(f"{path} has no commit {key!r}")
    return spark.read.parquet(commit["folder"])


def text_digest(*cells) -> Column:
    """An order-free digest of rows that any engine can compute: the sum of the first 60 bits of the MD5 of their cells as text."""
    text = F.concat_ws("|", *cells)
    return F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def freeze_features(panel: DataFrame, specs: Sequence[FeatureSpec], names: Sequence[str], folder: str,
                    bounded: bool = False) -> tuple[str, DataFrame]:
    """A19. Builds the named features and publishes them under the hash of their definition; (hash, commit).  Features
    that are frozen are not built again."""
    h = definition_hash([*specs, *names])
    return h, publish(build_features(panel, specs, names, bounded), folder, h, [], "freeze_features")
