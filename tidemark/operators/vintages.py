"""Releases, lags and revisions of bitemporal (vintage) tables (inventory F7-F11).

A vintage table has series_id, date (the period described), realtime_start, realtime_end and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import require_columns, safe_div, share
from tidemark.operators.order import quantiles

REVISED_BY = 1e-9
VINTAGE = {"series_id": "string", "date": "date", "realtime_start": "date", "realtime_end": "date", "value": "double"}


def _known(v: DataFrame, start: str | None = None) -> DataFrame:
    require_columns(v, "series_id", "date", "realtime_start", "value")
    v = v.where(F.col("value").isNotNull())
    return v.where(F.col("date") >= F.lit(start).cast("date")) if start else v


def releases(v: DataFrame, start: str | None = None) -> DataFrame:
    """F7. One row per observation: first publication, first and latest value, vintages, revised or not."""
    by = F.struct("realtime_start", "value")
    r = _known(v, start).groupBy("series_id", "date").agg(
        F.min("realtime_start").alias("release_date"), F.min_by("value", by).alias("first_value"),
        F.max_by("value", by).alias("latest_value"), F.count(F.lit(1)).alias("n_vintages"))
    return r.withColumn("revised", F.abs(F.col("latest_value") - F.col("first_value")) > REVISED_BY)


LAG_PROBS = {"lag_min": 0.0, "lag_p10": .1, "lag_median": .5, "lag_p90": .9, "lag_max": 1.0}


def release_lag(v: DataFrame, start: str | None = None) -> DataFrame:
    """F8. Days from each observation's date to its first publication, per series.  One observation per (series,
    date), so the calendar bounds a series."""
    r = releases(v, start).withColumn("lag", F.datediff("release_date", "date"))
    return quantiles(r, ["series_id"], "lag", LAG_PROBS, bounded=True).withColumnRenamed("n", "n_observations")


def release_weekdays(v: DataFrame, start: str | None = None) -> DataFrame:
    """F8. Weekday (0 = Monday) of first publication, per series."""
    return releases(v, start).groupBy("series_id", F.weekday("release_date").alias("weekday")).agg(
        F.count(F.lit(1)).alias("n"))


def revision_stats(v: DataFrame, start: str | None = None) -> DataFrame:
    """F9. Per series: share of observations revised, median size of the revisions, vintages per observation."""
    r = releases(v, start)
    pct = safe_div(100 * F.abs(F.col("latest_value") - F.col("first_value")), F.abs("first_value"))
    return r.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_observations"), share(F.col("revised")).alias("share_revised"),
        F.coalesce(F.percentile(F.when(F.col("revised"), pct), F.lit(0.5)), F.lit(0.0)).alias("median_abs_revision_pct"),
        F.percentile("n_vintages", F.lit(0.5)).alias("median_vintages"))


def vintage_lookup(v: DataFrame, series: str, date: str, n: int | None = None) -> DataFrame:
    """F10. The published values of one observation in order; ``n`` keeps the first of them."""
    one = _known(v).where((F.col("series_id") == series) & (F.col("date") == F.lit(date).cast("date")))
    out = one.select("series_id", "date", "realtime_start", "realtime_end", "value").orderBy("realtime_start", "value")
    return out if n is None else out.limit(n)


def largest_revision(v: DataFrame, series: str | None = None, since: str | None = None) -> DataFrame:
    """F11. The observation whose latest value is furthest from its first, with its whole history."""
    r = releases(v if series is None else v.where(F.col("series_id") == series), since)
    top = r.orderBy(F.desc(F.abs(F.col("latest_value") - F.col("first_value"))), F.asc("series_id"),
                    F.asc("date")).limit(1)
    return _known(v).join(F.broadcast(top.select("series_id", "date", "release_date")), ["series_id", "date"])


def end_of_period(date: Column, quarterly: Column) -> Column:
    """Last day of the month, or of the quarter."""
    quarter_end = F.date_add(F.to_date(F.add_months(F.date_trunc("quarter", date), 3)), -1)
    return F.when(quarterly, quarter_end).otherwise(F.last_day(date))


OPEN_END = "9999-12-31"


def with_realtime_end(v: DataFrame) -> DataFrame:
    """Adds realtime_end: the next vintage's start, open-ended for the last.  A vintage start is unique within its
    observation and a date, so the calendar bounds the window."""
    w = Window.partitionBy("series_id", "date").orderBy("realtime_start")
    return v.withColumn("realtime_end", F.coalesce(F.lead("realtime_start").over(w), F.lit(OPEN_END).cast("date")))


def merged(held: DataFrame, arrived: DataFrame, **places: Column) -> DataFrame:
    """The vintage table with what arrived: an arrived vintage closes the interval in which it starts, and its own ends where
    the next one starts, so that late vintages split intervals.

    An arrived vintage takes the place of a held one with the same start; of several arrived ones the largest value stays,
    null only where there is no other.  Null series, dates and starts are values like others, a null start the first.  The
    calendar bounds an observation's vintages; one shuffle by observation serves all of it.  ``places`` are expressions of
    series and date, which come out as columns: rows are then dealt by them.
    """
    names = [c for c in VINTAGE if c != "realtime_end"]
    rows = held.select(*names, F.lit(0).alias("_turn")).unionByName(arrived.select(*names, F.lit(1).alias("_turn")))
    if places:
        rows = rows.withColumns(places).repartition(*places)
    # a hash sorts faster than what it is of; of equal starts the last one stays, so the next row's start is where it ends
    keys = ["_slot", *places, "series_id", "date"]
    upto = Window.partitionBy(*keys).orderBy("realtime_start", "_turn", F.asc_nulls_first("value"))
    start = F.col("realtime_start")
    rows = rows.withColumn("_slot", F.xxhash64("series_id", "date")).withColumns(
        {"_next": F.lead(start).over(upto), "_more": F.lead(F.lit(True)).over(upto)})
    one = rows.where(F.col("_more").isNull() | ~F.col("_next").eqNullSafe(start))
    return one.withColumn("realtime_end", F.coalesce("_next", F.lit(OPEN_END).cast("date"))).select(*VINTAGE, *places)
