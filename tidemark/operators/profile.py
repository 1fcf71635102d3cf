"""Table, time, key and identifier profiles (inventory B)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import (count_if, identifier_class, is_numeric, is_temporal, require_columns, safe_div,
                                        share)
from tidemark.operators.calendar import to_exchange_time
from tidemark.operators.order import top_rows, weighted_quantiles
from tidemark.specs import AvailabilityRule

FEW_VALUES = 40   # a column with at most this many distinct values is listed by value


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for the known values of the columns: one shuffle serves every column."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (text.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def profile_table(df: DataFrame, max_top: int = 6) -> DataFrame:
    """B1. Per column: dtype, null rate, distinct count, uniqueness, min/max, top values or two examples."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs.append(F.count(c).alias(f"{c}__k"))
        if is_numeric(df, c) or is_temporal(df, c):
            aggs += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi")]
    def entry(c):
        num, time = is_numeric(df, c), is_temporal(df, c)
        def bound(kind, wanted, cast):
            return (F.col(f"{c}__{kind}") if wanted else F.lit(None)).cast(cast)
        return F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col("_n").alias("n_rows"), (F.col("_n") - F.col(f"{c}__k")).alias("n_null"),
                        bound("lo", num, "double").alias("min_number"), bound("hi", num, "double").alias("max_number"),
                        bound("lo", time, "date").alias("min_date"), bound("hi", time, "date").alias("max_date"))
    base = df.agg(*aggs).select(F.explode(F.array(*[entry(c) for c in cols])).alias("e")).select("e.*")
    counts = value_counts(df, cols)
    per = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    # a row per column of the table, sent to the counts: a join by column would gather a column's values in one task
    counts = counts.join(F.broadcast(per.select("column", (F.col("n_distinct") <= FEW_VALUES).alias("_few"))), "column")
    top = top_rows(counts.where("_few"), ["column"], [F.desc("n"), F.asc("value")], max_top)
    top = top.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))).alias("t"))
    top = top.select("column", F.concat_ws(", ", F.transform(
        "t", lambda x: F.concat(x["value"], F.lit("="), (-x["m"]).cast("string")))).alias("top"))
    ex = top_rows(counts.where(~F.col("_few")), ["column"], [F.asc("value")], 2)
    ex = ex.groupBy("column").agg(F.concat_ws(", ", F.sort_array(F.collect_list(F.substring("value", 1, 40))))
                                  .alias("examples"))
    out = base.join(per, "column", "left").join(top, "column", "left").join(ex, "column", "left")
    nd = F.coalesce("n_distinct", F.lit(0))
    return out.select("column", "dtype", "n_rows", safe_div(F.col("n_null"), F.col("n_rows")).alias("null_rate"),
                      nd.alias("n_distinct"), ((F.col("n_null") == 0) & (nd == F.col("n_rows"))).alias("is_unique"),
                      "min_number", "max_number", "min_date", "max_date", "top", "examples")


def identifier_patterns(df: DataFrame, field: str, weight: str | None = None,
                        max_classes: int | None = None) -> DataFrame:
    """B2/B3. Share of distinct identifiers, rows and weight in each written form, with six examples; ``max_classes`` keeps
    the forms of most identifiers only."""
    require_columns(df, field, weight)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ids = (df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("id"))
           .agg(F.count(F.lit(1)).alias("rows"), F.sum(w).alias("weight"))
           .withColumn("class", identifier_class(F.col("id"))))
    per = ids.groupBy("class").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("rows").alias("n_rows"),
                                   F.sum("weight").alias("weight"))
    # totals of a table with one row per class
    total = per.groupBy(F.lit(0).alias("_one")).agg(F.sum("n_distinct").alias("_d"), F.sum("n_rows").alias("_r"),
                                                    F.sum("weight").alias("_w"))
    shares = per.withColumn("_one", F.lit(0)).join(F.broadcast(total), "_one").select(
        "class", "n_distinct", safe_div(F.col("n_distinct"), F.col("_d")).alias("share_of_distinct"),
        safe_div(F.col("n_rows"), F.col("_r")).alias("share_of_rows"),
        safe_div(F.col("weight"), F.col("_w")).alias("share_of_weight"))
    if max_classes is not None:
        shares = shares.orderBy(F.desc("n_distinct"), F.asc("class")).limit(max_classes)
    ex = top_rows(ids, ["class"], [F.asc("id")], 6).groupBy("class").agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("id"))).alias("examples"))
    out = shares.join(ex, "class", "left").withColumn("above_1pct", F.col("share_of_distinct") >= 0.01)
    return out if weight else out.drop("share_of_weight")


def parse_time(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text that does not parse is null."""
    if is_temporal(df, name):
        return F.col(name).cast("timestamp")
    return F.try_to_timestamp(F.regexp_replace(F.col(name).cast("string"), "Z$", ""))


def _time_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per (column, month, weekday, hour): everything a time profile needs, a few thousand rows."""
    long = df.select(*[parse_time(df, c).alias(c) for c in columns]).unpivot([], list(columns), "column", "t")
    t = F.col("t")
    return long.groupBy("column", F.date_format(t, "yyyy-MM").alias("month"), F.weekday(t).alias("weekday"),
                        F.hour(t).alias("hour")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("t").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"),
        count_if(t != F.date_trunc("day", t)).alias("timed"))


def profile_time(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B4. Per column: parse rate, first and last time, share of values with a time of day."""
    require_columns(df, *columns)
    return (_time_cells(df, columns).groupBy("column")
            .agg(F.sum("rows").alias("n_rows"), F.sum("n").alias("n_parsed"), F.min("lo").alias("min_time"),
                 F.max("hi").alias("max_time"), F.sum("timed").alias("timed"))
            .select("column", "n_rows", safe_div(F.col("n_parsed"), F.col("n_rows")).alias("parse_rate"),
                    "min_time", "max_time", safe_div(F.col("timed"), F.col("n_parsed")).alias("share_with_time_of_day")))


def time_histograms(df: DataFrame, columns: Sequence[str], months: int | None = None) -> DataFrame:
    """B4. (column, kind, bucket, n): weekday counts, months (``months`` keeps the last ones only), hours
    where most values carry a time."""
    cells = _time_cells(df, columns).where(F.col("n") > 0)
    def by(kind, c):
        return cells.groupBy("column", F.lit(kind).alias("kind"), c.cast("string").alias("bucket")).agg(
            F.sum("n").alias("n"))
    # Weekday names, Monday first.
    names = F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    week = by("weekday", F.element_at(names, F.col("weekday") + 1))
    month = by("month", F.col("month"))
    if months is not None:
        month = top_rows(month, ["column", "kind"], [F.desc("bucket")], months)
    timed = (cells.groupBy("column").agg(safe_div(F.sum("timed"), F.sum("n")).alias("s")).where(F.col("s") > 0.5)
             .select("column"))
    hour = by("hour", F.col("hour")).join(timed, "column", "left_semi")
    return week.unionByName(month).unionByName(hour)


LAG_PROBS = {"p1": .01, "p10": .1, "p25": .25, "p50": .5, "p75": .75, "p90": .9, "p99": .99}


def lag_distribution(a: DataFrame, a_col: str, b: DataFrame, b_col: str, key: str, a_zone: str | None = None,
                     b_zone: str | None = None, only: Sequence[DataFrame] = ()) -> DataFrame:
    """B5. Days from a to b over every pair of rows with the same key, one row of percentiles and shares.

    Both sides are counted per (key, day) first, so a key with many rows meets itself once per pair of days.  ``only``
    lists frames that hold the keys to keep.
    """
    def days(df, col, zone, out):
        require_columns(df, key, col)
        t = parse_time(df, col)
        day = F.to_date(F.from_utc_timestamp(t, zone) if zone else t)
        kept = df.select(F.col(key), day.alias(out)).where(F.col(key).isNotNull() & day.isNotNull())
        for keep in only:
            kept = kept.join(keep.select(key), key, "left_semi")
        return kept.groupBy(key, out).agg(F.count(F.lit(1)).alias(f"n_{out}"))
    pairs = days(a, a_col, a_zone, "a").join(days(b, b_col, b_zone, "b"), key)
    lags = (pairs.groupBy(F.datediff("b", "a").alias("lag")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("w")))
    # distinct lags are bounded by the calendar
    q = weighted_quantiles(lags, [], "lag", "w", LAG_PROBS, bounded=True)
    def part(cond):
        return F.sum(F.when(cond, F.col("w")).otherwise(0))
    total = lags.agg(F.sum("w").alias("_w"), part(F.col("lag") < 0).alias("neg"), part(F.col("lag") == 0).alias("zero"),
                     part(F.col("lag") > 2).alias("late"), F.min("lag").alias("min_lag"),
                     F.max("lag").alias("max_lag")).withColumn("_one", F.lit(0))
    out = q.withColumn("_one", F.lit(0)).join(total, "_one")
    return out.select(F.col("n").alias("n_pairs"), *LAG_PROBS,
                      safe_div(F.col("neg"), F.col("n")).alias("share_negative"),
                      safe_div(F.col("zero"), F.col("n")).alias("share_zero"),
                      safe_div(F.col("late"), F.col("n")).alias("share_gt_2"), "min_lag", "max_lag")


def opaque_code_columns(df: DataFrame, max_distinct: int = FEW_VALUES, max_median_length: int = 3,
                        max_numbered: float = 0.8) -> DataFrame:
    """B6. Text columns holding a few short codes whose meaning cannot be read off the values."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        raise ValueError("the table has no text column")
    counts = value_counts(df, text)
    # Truth words, and letter+digit codes (F1 or F3, F1).
    flag = F.lower("value").isin("0", "1", "true", "false")
    numbered = F.col("value").rlike(r"^[A-Za-z]{1,2}\d+(\s*,\s*[A-Za-z]{1,2}\d+)*$")
    per = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"),
                                       F.min(flag.cast("int")).alias("all_flags"), share(numbered).alias("numbered"))
    lengths = counts.select("column", F.length("value").alias("len"), "n")
    med = weighted_quantiles(lengths, ["column"], "len", "n", {"median_length": .5}, bounded=True)   # distinct lengths
    opaque = ((F.col("n_distinct") <= max_distinct) & (F.col("median_length") <= max_median_length) &
              (F.col("all_flags") == 0) & (F.col("numbered") < max_numbered))
    return per.join(med, "column").select("column", "n_distinct", "median_length", opaque.alias("opaque"))


def is_date_only(df: DataFrame, column: str) -> DataFrame:
    """B7. One row: every known value sits at midnight."""
    t = F.col(column).cast("timestamp")
    return df.agg(F.count(column).alias("n"), F.bool_and(t == F.date_trunc("day", t)).alias("date_only"))


def check_same_day_use(df: DataFrame, rule: AvailabilityRule, role: str) -> DataFrame:
    """B7. Whether a rule would use a date-only event or period at the open of the day it describes."""
    at_risk = (rule.tradable_at != "next_trading_day_open" and rule.extra_lag == 0
               and role in ("event_time", "reporting_period"))
    d = is_date_only(df, rule.source)
    return d.select(F.lit(rule.source).alias("source"), F.lit(rule.tradable_at).alias("tradable_at"), "date_only",
                    (F.lit(at_risk) & (F.col("n") > 0) & F.col("date_only")).alias("uses_same_day"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """B8. The rows of one key (the filter reaches the scan)."""
    require_columns(df, key)
    return df.where(F.col(key) == F.lit(value))


def timezone_consistency(df: DataFrame, ts: str, filing_date: str, form: str, forms: Sequence[str],
                         late_cutoff: int = 22 * 60, cutoff: int = 17 * 60 + 30) -> DataFrame:
    """B9. How well two readings of a timestamp (UTC, or exchange wall clock) fit the filing dates.

    One row per reading, form group and cutoff (minutes of the day); ``best`` marks the reading that fits the listed
    forms better under the late cutoff.
    """
    naive = parse_time(df, ts)
    member = F.col(form).isin(list(forms))
    readings = F.array(F.struct(F.lit("utc").alias("reading"), to_exchange_time(naive, "UTC").alias("t")),
                       F.struct(F.lit("face_value").alias("reading"), naive.alias("t")))
    groups = F.array(F.struct(F.lit("listed").alias("form_group"), F.lit(late_cutoff).alias("cutoff"),
                              member.alias("m")),
                     F.struct(F.lit("listed").alias("form_group"), F.lit(cutoff).alias("cutoff"), member.alias("m")),
                     F.struct(F.lit("other").alias("form_group"), F.lit(cutoff).alias("cutoff"),
                              (~member).alias("m")))
    d = (df.select(F.to_date(filing_date).alias("fd"), F.explode(readings).alias("r"), groups.alias("gs"))
         .select("fd", "r.reading", "r.t", F.explode("gs").alias("g"))
         .select("fd", "reading", "t", "g.form_group", "g.cutoff", "g.m").where("m"))
    mins = F.hour("t") * 60 + F.minute("t")
    day = F.to_date("t")
    same = (F.weekday("t") < 5) & (mins < F.col("cutoff"))
    agg = d.groupBy("reading", "form_group", "cutoff").agg(
        count_if(same).alias("n_pred_same_day"), count_if(same & (F.col("fd") == day)).alias("ok_same"),
        count_if(~same).alias("n_pred_next_day"), count_if(~same & (F.col("fd") > day)).alias("ok_next"),
        count_if(F.col("fd") < day).alias("n_impossible"),
        count_if((mins >= 22 * 60) | (mins < 6 * 60)).alias("n_night"))
    score = F.when((F.col("form_group") == "listed") & (F.col("cutoff") == late_cutoff),
                   safe_div(F.col("ok_same") + F.col("ok_next"), F.col("n_pred_same_day") + F.col("n_pred_next_day")))
    # two readings, three rows each
    best = agg.groupBy("reading").agg(F.max(score).alias("score"))
    top = best.groupBy(F.lit(0).alias("_one")).agg(F.max("score").alias("_top"))
    best = best.withColumn("_one", F.lit(0)).join(top, "_one").select(
        "reading", (F.col("score") == F.col("_top")).alias("best"))
    return agg.join(best, "reading").select(
        "reading", "form_group", "cutoff", "n_pred_same_day",
        safe_div(F.col("ok_same"), F.greatest("n_pred_same_day", F.lit(1))).alias("consistent_same_day"),
        "n_pred_next_day",
        safe_div(F.col("ok_next"), F.greatest("n_pred_next_day", F.lit(1))).alias("consistent_next_day"),
        "n_impossible", "n_night", "best")


def hour_histogram(df: DataFrame, ts: str, form: str, forms: Sequence[str]) -> DataFrame:
    """B9. Hours of the listed forms under both readings."""
    naive = parse_time(df, ts)
    listed = df.where(F.col(form).isin(list(forms)))
    utc = listed.select(F.lit("utc").alias("reading"), F.hour(to_exchange_time(naive, "UTC")).alias("hour"))
    face = listed.select(F.lit("face_value").alias("reading"), F.hour(naive).alias("hour"))
    return utc.unionByName(face).groupBy("reading", "hour").agg(F.count(F.lit(1)).alias("n"))
