"""Trading calendar and availability rules (inventory E).

A calendar is a *date dimension*: one row per civil date from the day before the first session to the day after the
last, with the sessions around it.  It grows with the years covered, not with the rows, so it is broadcast, and every rule
is one equality join on the date.  Dates outside the span behave like its ends: an earlier one rolls to the first session,
a later one has none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_temporal, require_columns, share
from tidemark.operators.order import positions, top_rows
from tidemark.specs import AvailabilityRule

# The exchange's zone, and its open and close in minutes of the day.
EXCHANGE_ZONE = "America/New_York"
OPEN_MINUTE, CLOSE_MINUTE = 570, 960


def trading_days(df: DataFrame, date: str, holidays: Sequence[str] = (), weekdays_only: bool = False) -> DataFrame:
    """E1. The sessions: distinct dates of a price table, optionally without weekends and listed MM-dd holidays."""
    d = df.select(F.to_date(date).alias("session")).where(F.col("session").isNotNull()).distinct()
    if weekdays_only:
        d = d.where(F.weekday("session") < 5)
    return d.where(~F.date_format("session", "MM-dd").isin(list(holidays))) if holidays else d


def date_dimension(sessions: DataFrame) -> DataFrame:
    """E1. Every civil date of the sessions' span, and one day more at each end, with: is_session, the session on or after
    it, the one strictly after it, and ``idx``, the number of sessions before the date."""
    span = sessions.agg(F.date_sub(F.min("session"), 1).alias("lo"), F.date_add(F.max("session"), 1).alias("hi"))
    days = span.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    s = sessions.select(F.col("session").alias("day"), F.lit(True).alias("is_session")).distinct()
    d = days.join(s, "day", "left").withColumn("is_session", F.coalesce("is_session", F.lit(False)))
    # one partition of one row per day; growing frames only, so each window is one pass
    one = Window.partitionBy(F.lit(0))
    at = F.when(F.col("is_session"), F.col("day"))
    forward, backward = one.orderBy("day"), one.orderBy(F.desc("day"))
    upto, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    return d.select("day", "is_session",
                    F.last(at, ignorenulls=True).over(backward.rowsBetween(*upto)).alias("on_or_after"),
                    F.last(at, ignorenulls=True).over(backward.rowsBetween(*before)).alias("after"),
                    F.count(at).over(forward.rowsBetween(*before)).alias("idx"))


def _attach(df: DataFrame, day: Column, dim: DataFrame, cal: DataFrame) -> DataFrame:
    """dim's columns at each row's date; dates outside the calendar count as its nearest end."""
    lo, hi = (cal.select(f("day")).scalar() for f in (F.min, F.max))
    inside = F.when(day.isNotNull(), F.greatest(F.least(day, hi), lo))   # greatest and least skip nulls
    # by day number: the table of a date key takes a memory page of up to 64 MB on the driver and every executor, however few its rows
    dim = dim.withColumn("_day", F.unix_date("day")).drop("day")
    return df.withColumn("_day", F.unix_date(inside)).join(F.broadcast(dim), "_day", "left").drop("_day")


def _lookup(df: DataFrame, col: str, cal: DataFrame, source: str, out: str) -> DataFrame:
    require_columns(df, col)
    return _attach(df, F.to_date(col), cal.select("day", F.col(source).alias(out)), cal)


def roll_forward(df: DataFrame, col: str, cal: DataFrame, out: str = "session") -> DataFrame:
    """E2. The date itself when it is a session, else the next one; null past the calendar's end."""
    return _lookup(df, col, cal, "on_or_after", out)


def next_session(df: DataFrame, col: str, cal: DataFrame, out: str = "session") -> DataFrame:
    """E3. The first session strictly after the date."""
    return _lookup(df, col, cal, "after", out)


def session_index(df: DataFrame, col: str, cal: DataFrame, out: str = "idx") -> DataFrame:
    """Number of sessions before the date: differences count sessions."""
    return _lookup(df, col, cal, "idx", out)


def to_exchange_time(ts: Column, source_zone: str) -> Column:
    """E4. Wall clock of the exchange; text loses a (possibly false) trailing Z first."""
    return F.from_utc_timestamp(ts, EXCHANGE_ZONE) if source_zone == "UTC" else ts


def parse_exchange_time(text: Column, source_zone: str) -> Column:
    return to_exchange_time(F.try_to_timestamp(F.regexp_replace(text, "Z", "")), source_zone)


def _minutes(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def _shifted(cal: DataFrame, source: str, n: int, out: str) -> DataFrame:
    """(day, session n sessions after cal[source]), computed inside the dimension."""
    base = cal.select("day", F.col(source).alias("_s"))
    if n == 0:
        return base.select("day", F.col("_s").alias(out))
    by_idx = cal.where("is_session").select(F.col("day").alias("_to"), F.col("idx").alias("_to_idx"))
    start = cal.where("is_session").select(F.col("day").alias("_s"), (F.col("idx") + n).alias("_to_idx"))
    hop = start.join(by_idx, "_to_idx").select("_s", F.col("_to").alias(out))
    return base.join(hop, "_s", "left").select("day", out)


def first_open_after(df: DataFrame, ts: str, cal: DataFrame, out: str = "first_open", lag: int = 0) -> DataFrame:
    """E5. Session of the first 09:30 open strictly after an exchange-time timestamp (09:30 itself is too late)."""
    require_columns(df, ts)
    dim = (_shifted(cal, "after", lag, "_late").join(_shifted(cal, "on_or_after", lag, "_early"), "day")
           .join(cal.select("day", "is_session"), "day"))
    d = _attach(df, F.to_date(ts), dim, cal)
    early = F.col("is_session") & (_minutes(F.col(ts)) < OPEN_MINUTE)
    return d.withColumn(out, F.when(early, F.col("_early")).otherwise(F.col("_late"))).drop(
        "_early", "_late", "is_session")


def shift_sessions(df: DataFrame, col: str, n: int, cal: DataFrame, out: str = "session") -> DataFrame:
    """E6. n sessions after the session on or after the date."""
    require_columns(df, col)
    return _attach(df, F.to_date(col), _shifted(cal, "on_or_after", n, out), cal)


def apply_rule(df: DataFrame, rule: AvailabilityRule, cal: DataFrame, out: str = "first_tradable") -> DataFrame:
    """E7/E8. First session whose open may use each record.

    Timestamps are read in the rule's zone and a 09:30 open must lie strictly after them.  A date-only source has no
    time of day, so its next open is the open of the same date.
    """
    require_columns(df, rule.source)
    kind = df.schema[rule.source].dataType.simpleString()
    if kind == "date":
        source = "after" if rule.tradable_at == "next_trading_day_open" else "on_or_after"
        return _attach(df, F.col(rule.source), _shifted(cal, source, rule.extra_lag, out), cal)
    t = (to_exchange_time(F.col(rule.source).cast("timestamp"), rule.source_timezone) if is_temporal(df, rule.source)
         else parse_exchange_time(F.col(rule.source), rule.source_timezone))
    d = df.withColumn("_et", t)
    if rule.tradable_at == "next_open_after":
        return first_open_after(d, "_et", cal, out, rule.extra_lag).drop("_et")
    source = "after" if rule.tradable_at == "next_trading_day_open" else "on_or_after"
    return _attach(d, F.to_date("_et"), _shifted(cal, source, rule.extra_lag, out), cal).drop("_et")


apply_date_rule = apply_rule   # E8: the same call, on a date column


def filing_times(submissions: DataFrame, transactions: DataFrame, acceptance: DataFrame, key: str,
                 event_dates: Sequence[str]) -> DataFrame:
    """E9. Every candidate source time per key: the submission, its earliest event dates, its acceptance."""
    first = transactions.groupBy(key).agg(*[F.min(c).alias(c) for c in event_dates])
    return submissions.join(first, key, "left").join(acceptance, key, "left")


def session_stratum(df: DataFrame, ts: str, cal: DataFrame, out: str = "stratum", holidays: bool = True) -> DataFrame:
    """E10. When an exchange-time timestamp falls: non_trading_day, pre_open, intraday, after_close, and the closes
    before a gap no weekend explains."""
    d = _attach(df, F.to_date(ts), cal.select("day", "is_session", F.col("after").alias("_next")), cal)
    t = F.col(ts)
    gap = (F.datediff("_next", F.to_date(t)) > 1) & (F.weekday(t) != 4)
    label = F.when(F.col(ts).isNull(), None).when(~F.col("is_session"), "non_trading_day")
    label = label.when(_minutes(t) < OPEN_MINUTE, "pre_open").when(_minutes(t) < CLOSE_MINUTE, "intraday")
    if holidays:
        label = label.when(gap, "pre_holiday_after_close")
    return d.withColumn(out, label.otherwise("after_close")).drop("is_session", "_next")


def date_stratum(df: DataFrame, date: str, cal: DataFrame, out: str = "stratum") -> DataFrame:
    """E11. What follows a date: the next day, a weekend after a Friday, or a holiday."""
    d = _lookup(df, date, cal, "after", "_next")
    gap = F.datediff("_next", date)
    label = (F.when(gap == 1, "next_day").when((gap == 3) & (F.weekday(date) == 4), "friday")
             .otherwise("before_holiday"))
    return d.withColumn(out, label).drop("_next")


def stratified_sample(df: DataFrame, stratum: str, n: int, key: Sequence[str] | str, seed: int = 0) -> DataFrame:
    """E12. n rows, equally many per stratum (all of a small one), topped up from the rest; the order is a hash of the
    key, so the sample is the same on every run."""
    keys = [key] if isinstance(key, str) else list(key)
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    d = df.withColumn("_h", h)
    sizes = df.where(F.col(stratum).isNotNull()).groupBy(F.lit(0).alias("_one")).agg(
        F.count_distinct(stratum).alias("_k"))
    # no stratum takes more than n
    ranked = positions(d.where(F.col(stratum).isNotNull()), [stratum], ["_h", *keys], "_at").where(F.col("_at") < n)
    ranked = ranked.withColumns({"_r": F.col("_at") + 1, "_one": F.lit(0)}).drop("_at", "group_n").join(
        F.broadcast(sizes), "_one")
    ranked = ranked.withColumn("_extra", F.col("_r") > F.floor(F.lit(n) / F.col("_k")))
    return (ranked.orderBy(F.asc("_extra"), F.asc("_h"), *keys).limit(n).drop("_h", "_r", "_one", "_k", "_extra"))


def rule_agreement(df: DataFrame, rule: AvailabilityRule, gold: AvailabilityRule, cal: DataFrame,
                   by: str | None = None) -> DataFrame:
    """E13. Share of rows where two rules give the same session, by stratum and overall (stratum null).  Two unknown
    sessions do not agree."""
    d = apply_rule(apply_rule(df, rule, cal, "_a"), gold, cal, "_b")
    ok = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    if by is None:
        return d.agg(F.count(F.lit(1)).alias("n"), share(ok).alias("agreement"))
    return (d.rollup(by).agg(F.count(F.lit(1)).alias("n"), share(ok).alias("agreement"))
            .withColumnRenamed(by, "stratum"))


def preview_rule(df: DataFrame, rule: AvailabilityRule, cal: DataFrame, stratum: str, key: Sequence[str] | str,
                 n_per_stratum: int = 2, first: str | None = None, latest: str | None = None) -> DataFrame:
    """E14. A few rows per stratum with the session the rule gives, the session strictly after the source, and (for
    revised data) the value the rule lets a backtest use."""
    keys = [key] if isinstance(key, str) else list(key)
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary"))
    s = top_rows(df.withColumn("_h", h), [stratum], [F.asc("_h")], n_per_stratum).drop("_h")
    s = apply_rule(s, rule, cal)
    plain = replace(rule, tradable_at="next_trading_day_open", extra_lag=0)
    s = apply_rule(s, plain, cal, "next_trading_day")
    if first and latest:
        s = s.withColumn("value_used", F.col(latest if rule.value_vintage == "latest" else first))
    return s
