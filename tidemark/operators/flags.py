"""C22. Material facts of the exploration results as rows (id, fact, remedy)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import top_rows


def _facts(df: DataFrame, when: Column, name: Column, fact: Column, remedy: Column | None = None) -> DataFrame:
    return df.where(when).select(name.alias("id"), fact.alias("fact"),
                                 (F.lit(None) if remedy is None else remedy).cast("string").alias("remedy"))


def _pct(x: Column, digits: int = 0) -> Column:
    return F.round(100 * x, digits).cast("int" if digits == 0 else f"decimal(12,{digits})").cast("string")


def coverage_flags(dips: DataFrame, n: int | None = None) -> DataFrame:
    """The dips; ``n`` keeps the first ones only."""
    first = dips if n is None else top_rows(dips.withColumn("_one", F.lit(0)), ["_one"], [F.asc("period")], n)
    return _facts(first, F.lit(True), F.concat(F.lit("coverage_dip_"), F.date_format("period", "yyyy-MM")),
                  F.concat(F.lit("coverage in the period starting "), F.col("period").cast("string"), F.lit(" is "),
                           _pct(1 - F.col("value") / F.col("typical")), F.lit("% below its typical level")))


def missing_flags(fields: DataFrame, over_time: DataFrame | None = None, panel: DataFrame | None = None) -> DataFrame:
    parts = [_facts(fields, F.col("zero_share") >= 0.2, F.concat(F.lit("zeros_"), F.col("field")),
                    F.concat("field", F.lit(" is zero in "), _pct(F.col("zero_share")), F.lit("% of rows")))]
    if over_time is not None:
        spike = F.col("zero_max") >= F.greatest(F.lit(0.05), 3 * F.coalesce("zero_median", F.lit(0.0)))
        parts.append(_facts(over_time, spike, F.concat(F.lit("zero_spike_"), F.col("field")), F.concat(
            "field", F.lit(" is zero in "), _pct(F.col("zero_max")), F.lit("% of rows in the period starting "),
            F.col("zero_max_at").cast("string"))))
    if panel is not None:
        parts.append(_facts(panel, F.col("absent_inside_span_share") >= 0.02, F.lit("absent_rows"), F.concat(
            F.lit("entities have no row on "), _pct(F.col("absent_inside_span_share"), 1),
            F.lit("% of dates inside their own history"))))
    return reduce(DataFrame.unionByName, parts)


def distribution_flags(dist: DataFrame) -> DataFrame:
    return _facts(dist, F.col("mass_at_max"), F.lit("mass_at_max"),
                  F.concat(_pct(F.col("share_at_max"), 1), F.lit("% of values equal the maximum")))


def part_flags(over: DataFrame) -> DataFrame:
    remedy = F.concat(F.lit("flag_rows or drop_rows where "), "remedy_column", F.lit(" "), "remedy_op", F.lit(" "),
                      "remedy_value")
    return _facts(over, F.col("n_rows_over") > 0, F.lit("part_exceeds_whole"), F.concat(
        "remedy_column", F.lit(" exceeds "), "remedy_value", F.lit(" in "), F.col("n_rows_over").cast("string"),
        F.lit(" rows")), remedy)


def key_flags(check: DataFrame, redundant: DataFrame | None = None) -> DataFrame:
    dup = _facts(check, ~F.col("key_is_unique"), F.lit("duplicate_keys"), F.concat(
        F.col("rows_with_duplicated_key").cast("string"), F.lit(" rows share a key ("),
        F.col("exact_duplicate_rows").cast("string"), F.lit(" exact duplicates)")),
        F.when(F.col("exact_duplicate_rows") > 0, "drop_duplicates"))
    if redundant is None:
        return dup
    return dup.unionByName(_facts(redundant, F.col("redundant"), F.lit("redundant_key"),
                                  F.concat("column", F.lit(" is not needed in the key"))))


def break_flags(zero: DataFrame, clusters: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Series that start late, and clusters of breaks; ``n`` keeps the first clusters only."""
    starts = _facts(zero, F.lit(True), F.concat(F.lit("starts_"), "series"), F.concat(
        "series", F.lit(" is zero until "), F.col("starts").cast("string"), F.lit(", then non-zero")))
    if clusters is None:
        return starts
    first = clusters if n is None else clusters.where(F.col("cluster") <= n)
    return starts.unionByName(_facts(
        first, F.lit(True), F.concat(F.lit("break_"), F.date_format("first_date", "yyyy-MM")),
        F.concat(F.lit("abrupt change around "), "months", F.lit(" in "), "statistics")))


def category_flags(mix: DataFrame, field: str, n: int | None = None) -> DataFrame:
    """Values that appear after the start; ``n`` keeps the first by name only."""
    new = mix.where(F.col("appears_after_start") & ~F.col("multi_valued"))
    first = new if n is None else new.orderBy("value").limit(n)
    return _facts(first, F.lit(True), F.concat(F.lit(f"new_{field}_"), "value"), F.concat(
        F.lit(f"{field} value "), "value", F.lit(" first appears "), F.col("first_seen").cast("string")))


def all_flags(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
