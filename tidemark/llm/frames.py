"""Small shared parts: text rules, column names that cannot clash, sizes that follow the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, and the pattern of a run of them.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of characters that are no blanks."""
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK_RUN))


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's own measure of how far work is spread; sizes that must follow the data follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


#: What a side of a join may weigh to be broadcast, in bytes; its size is measured first.
BROADCAST_BYTES = 32 << 20


def broadcast_checked(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its counted rows of ``row_bytes`` stay below BROADCAST_BYTES; otherwise as it is, for a
    shuffled join.  df should be materialised, for it is counted here."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
