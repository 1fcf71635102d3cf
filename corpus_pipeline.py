"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), where docs is what the stage before has left,
and returns a frame, which is written as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents; every decision takes effect:

1. ``quality``: documents that the quality rules reject go.
2. ``lines``: repeated lines lose all but their first document's; a document that loses all its lines stays, empty.  n_chars follows.
3. ``near_duplicates``: one document of each group of near duplicates stays, the one with the smallest doc_id.
4. ``mixing``: documents in training order, as often as the mix takes them.
5. ``packing``: training sequences; a row per piece of a document, with its token ids.  Documents are packed in ranges of
   the order in which mixing wrote them, which the numbers of its files and of the rows in them tell.

Nulls, empty texts, empty tables, repeated rows and extra columns have the results that each operator states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linededup, mixing, ngramjoin, packing, quality

#: The rows depend on hashes, on an estimate and on a tokenizer, which SQL cannot express; tests look at the stages one by one.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs)
    out = out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(*(f"`{c}`" for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.drop_near_duplicates(docs)


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


def training_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    place = docs.metadataColumn("_metadata")
    number = lambda of: F.regexp_extract(place["file_name"], of, 1).try_cast("long")
    return packing.packed(docs, order=(number(r"^part-(\d+)"), number(r"-c(\d+)\."), place["file_name"], place["row_index"]))


STAGES = [("quality", good_documents), ("lines", without_repeated_lines), ("near_duplicates", one_of_each_group),
          ("mixing", in_training_order), ("packing", training_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between stages is written to the folder of spark.checkpoint.dir."""
    from tidemark.session import shared_folder

    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
