"""The queries of the operators, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (chat, disclosure, divergence, linededup, merkle, mixing, ngramjoin, ngramlm, novelty, packing, quality,
                          transport, urlfilter)
from tidemark.llm.frames import documents

Query = Callable[[SparkSession, str], DataFrame]


def _of(table: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": _of("documents", ngramjoin.linked_documents),
        "op2_chat_format": lambda spark, sf_dir: chat.chat_report(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        "op3_transport_stream": _of("documents", transport.media_report),
        "op4_line_dedup": _of("documents", linededup.line_report),
        "op5_url_filter": _of("pages", urlfilter.judged),
        "op6_packing": _of("documents", packing.pieces),
        "op7_lm_score": _of("documents", ngramlm.scored),
        "op8_quality_outliers": _of("documents", quality.document_quality),
        "op9_pii_disclosure": _of("documents", disclosure.disclosure_report),
        "op10_curriculum": _of("documents", mixing.mixture),
        "op11_merkle_manifest": _of("documents", merkle.manifest_report),
        "op12_secret_novelty": _of("documents", novelty.secret_report),
        "op13_source_divergence": _of("documents", divergence.audit),
    }


def oracles() -> dict[str, str]:
    return {"op4_line_dedup": linededup.ORACLE, "op5_url_filter": urlfilter.ORACLE, "op11_merkle_manifest": merkle.ORACLE,
            "op13_source_divergence": divergence.ORACLE}
