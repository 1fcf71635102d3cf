"""Point-in-time joins, views, snapshots and look-ahead measurement (inventory F1-F6, F12-F14)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import count_if, require_columns, safe_div
from tidemark.operators.calendar import apply_rule, session_index
from tidemark.operators.order import asof_join, quantiles, top_rows
from tidemark.operators.vintages import releases
from tidemark.session import cut
from tidemark.specs import AvailabilityRule, ViewRoles


def pit_join(left: DataFrame, right: DataFrame, key: Sequence[str] | str, availability_col: str | None, as_of_col: str,
             lag: timedelta | None = None, values: Sequence[str] | None = None, tie: Sequence[str] = (),
             prefix: str = "") -> DataFrame:
    """F1. Each left row with the latest right row available (plus lag) at its as-of time.

    Refuses to join on event time: the availability column is required, and a right row without availability fails
    the query when it runs.
    """
    if not availability_col:
        raise ValueError("pit_join needs availability_col (when the data became public); it will not join on event time")
    require_columns(right, availability_col)
    keys = [key] if isinstance(key, str) else list(key)
    values = list(values or [c for c in right.columns if c not in keys])
    avail = F.col(availability_col)
    if lag:
        whole_days = lag == timedelta(days=lag.days)
        if isinstance(right.schema[availability_col].dataType, T.DateType) and whole_days:
            avail = F.date_add(avail, lag.days)
        else:
            avail = avail.cast("timestamp") + F.make_dt_interval(F.lit(lag.days), F.lit(0), F.lit(0),
                                                                  F.lit(lag.seconds + lag.microseconds / 1e6))
    missing = F.raise_error(F.lit(f"{availability_col} has nulls; resolve availability for every row before joining"))
    kind = right.select(avail.alias("a")).schema["a"].dataType
    r = right.withColumn("_avail", F.when(F.col(availability_col).isNull(), missing.cast(kind)).otherwise(avail))
    return asof_join(left, r, keys, as_of_col, "_avail", values, tie, prefix=prefix)


def pit_view(df: DataFrame, roles: ViewRoles, rule: AvailabilityRule, cal: DataFrame) -> DataFrame:
    """F2. entity, source_time, decision_time, values, flags and their union; records never usable are dropped."""
    require_columns(df, roles.entity, roles.time, *roles.values, *roles.flags)
    any_flag = reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in roles.flags], F.lit(False))
    d = apply_rule(df, rule, cal, "decision_time").where(F.col("decision_time").isNotNull())
    return d.select(F.col(roles.entity).alias("entity"), F.col(roles.time).alias("source_time"), "decision_time",
                    *roles.values, *roles.flags, any_flag.alias("quality_flag"))


def asof_snapshot(view: DataFrame, dates: Sequence[str], cal: DataFrame, entities: DataFrame | None = None,
                  values: Sequence[str] | None = None) -> DataFrame:
    """F3. For each of the dates and entities the latest usable record, with its age in sessions."""
    ents = (entities if entities is not None else view).select("entity").where(F.col("entity").isNotNull()).distinct()
    asked = F.array(*[F.lit(d).cast("date") for d in sorted(set(dates))])
    left = ents.select("entity", F.explode(asked).alias("date"))
    values = list(values or [c for c in view.columns if c not in ("entity", "decision_time")])
    right = view.withColumn("decision_time", F.to_date("decision_time"))
    tie = [c for c in ("source_time",) if c in view.columns] + [v for v in values if v != "source_time"]
    snap = asof_join(left, right, "entity", "date", "decision_time", ["decision_time", *values], tie, how="inner")
    snap = session_index(session_index(snap, "date", cal, "_i"), "decision_time", cal, "_j")
    return snap.withColumn("feature_age", F.col("_i") - F.col("_j")).drop("_i", "_j")


# ---------------------------------------------------------------- look-ahead

EARLY_PROBS = {"early_median": .5, "early_p90": .9}


def _early_quantiles(d: DataFrame, sessions: str, keys: Sequence[str] = ()) -> DataFrame:
    """Session counts are bounded by the calendar."""
    d = d if keys else d.withColumn("_one", F.lit(0))
    return quantiles(d, list(keys) or ["_one"], sessions, EARLY_PROBS, bounded=True).drop("n")


def _report(stats: DataFrame, *parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    out = stats if keys else stats.withColumn("_one", F.lit(0))
    for p in parts:
        out = out.join(p, list(keys) or ["_one"], "left")
    return out.drop("_one").na.fill(0.0)


def lookahead_stats(events: DataFrame, reference: DataFrame, key: str, asof: str, cal: DataFrame,
                    first_tradable: str = "first_tradable") -> DataFrame:
    """F4. How many sessions before the first tradable one the events are used (one row).

    ``reference`` has one first tradable session per key.
    """
    require_columns(events, key, asof)
    require_columns(reference, key, first_tradable)
    ev = events.select(key, F.to_date(asof).alias("_asof")).join(
        reference.select(key, F.col(first_tradable).alias("_ref")), key, "left")
    ev = session_index(session_index(ev, "_ref", cal, "_ri"), "_asof", cal, "_ai")
    ok = F.col("_ref").isNotNull() & F.col("_asof").isNotNull()
    ev = ev.withColumn("_la", F.when(ok, F.col("_ri") - F.col("_ai")))
    la = F.col("_la")
    n = F.count("_la")
    stats = ev.agg(F.count(F.lit(1)).alias("n_events"), n.alias("n_matched"),
                   safe_div(count_if(la > 0), n).alias("share_before_tradable"),
                   safe_div(count_if(la == 0), n).alias("share_exactly_first_tradable"),
                   safe_div(count_if(la < 0), n).alias("share_later_than_needed"),
                   F.max(la).cast("double").alias("early_max"))
    return _report(stats, _early_quantiles(ev.where(la > 0), "_la"))


def _value_report(ev: DataFrame, matched: Column, early: Column, mismatch: Column, mismatch_name: str,
                  cal: DataFrame, *parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ev = ev.withColumns({"_m": matched, "_e": matched & early, "_v": matched & mismatch})
    ev = session_index(session_index(ev, "_ft", cal, "_fi"), "_asof", cal, "_ai")
    ev = ev.withColumn("_days", F.when(F.col("_e"), F.col("_fi") - F.col("_ai")))
    n = F.greatest(count_if(F.col("_m")), F.lit(1))
    stats = ev.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), count_if(F.col("_m")).alias("n_matched"),
        safe_div(count_if(F.col("_e") | F.col("_v")), n).alias("share_before_tradable"),
        safe_div(count_if(F.col("_e")), n).alias("share_used_before_release"),
        safe_div(count_if(F.col("_v")), n).alias(mismatch_name), F.max("_days").cast("double").alias("early_max"))
    return _report(stats, _early_quantiles(ev.where(F.col("_days").isNotNull()), "_days", keys), *parts, keys=keys)


def lookahead_stats_vintage(events: DataFrame, vintages: DataFrame, rule: AvailabilityRule, cal: DataFrame,
                            start: str | None = None, tolerance: float = 1e-9, keys: Sequence[str] = ()) -> DataFrame:
    """F5. Look-ahead of (series_id, date, asof_date, value) events against a table of vintages: used too early, or a
    value that was not the published one at the as-of date.  With ``keys``, columns of the events, one row for each key that has
    events: many flows meet the vintages in one job.

    The vintages of an observation do not overlap, so the one current at a date is the latest that began by then,
    unless it has ended: an as-of join instead of every event meeting every vintage.
    """
    require_columns(events, "series_id", "date", "asof_date", "value")
    key = ["series_id", "date"]
    v = vintages.where(F.col("value").isNotNull())
    rel = releases(v, start).withColumnRenamed("release_date", "realtime_start")
    source = "realtime_start" if rule.source.endswith("realtime_start") else "date"
    rel = apply_rule(rel, AvailabilityRule(source, rule.tradable_at, rule.source_timezone, rule.extra_lag), cal, "_ft")
    ev = events.select(*keys, *key, F.to_date("asof_date").alias("_asof"), "value").join(
        rel.select(*key, "_ft", "latest_value"), key, "left")
    if rule.value_vintage == "as_of_date":
        ev = asof_join(ev, v.select(*key, "realtime_start", "realtime_end", F.col("value").alias("allowed")), key,
                       "_asof", "realtime_start", ["allowed", "realtime_end"])
        ev = ev.withColumn("allowed", F.when(F.col("_asof") < F.col("realtime_end"), F.col("allowed")))
    else:
        ev = ev.withColumn("allowed", F.col("latest_value"))
    # the counts, the quantile's sketch and its values all read these rows
    ev = cut(ev.select(*keys, "_asof", "_ft", "value", "allowed"))
    matched = F.col("_ft").isNotNull()
    early = F.coalesce(F.col("_asof") < F.col("_ft"), F.lit(False))
    near = F.coalesce(F.abs(F.col("value") - F.col("allowed")) <= tolerance, F.lit(False))
    wrong = ~early & F.col("allowed").isNotNull() & ~near   # no covering vintage counts as no mismatch
    ks = list(keys) or ["_one"]
    off = ev.where(matched & wrong).withColumn("_one", F.lit(0)).select(
        *ks, safe_div(100 * F.abs(F.col("value") - F.col("allowed")), F.abs("allowed")).alias("pct"))
    med = quantiles(off, ks, "pct", {"median_abs_difference_pct": .5}).drop("n")
    return _value_report(ev, matched, early, wrong, "share_value_not_published", cal, med, keys=keys)


def lookahead_stats_signal(events: DataFrame, reference: DataFrame, rule: AvailabilityRule, cal: DataFrame,
                           entity: str = "symbol", tolerance: float = 1e-12) -> DataFrame:
    """F6. Look-ahead of (entity, date, asof_date, value) signals against the same signal computed from the past only;
    a value the past cannot produce counts as not public."""
    require_columns(events, entity, "date", "asof_date", "value")
    ref = reference.select(entity, "date", F.col("value").alias("allowed"), F.lit(True).alias("_hit"))
    ev = events.select(entity, "date", F.to_date("asof_date").alias("_asof"), "value").join(
        ref, [entity, "date"], "left")
    ev = apply_rule(ev.withColumn("date", F.to_date("date")),
                    AvailabilityRule("date", rule.tradable_at, rule.source_timezone, rule.extra_lag), cal, "_ft")
    matched = F.coalesce("_hit", F.lit(False))
    early = F.coalesce(F.col("_asof") < F.col("_ft"), F.lit(False))
    near = F.coalesce(F.abs(F.col("value") - F.col("allowed")) <= tolerance, F.lit(False))
    return _value_report(ev, matched, early, ~early & ~near, "share_value_not_public", cal)


def compare_lookahead(before: DataFrame, after: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """F14. Look-ahead of a flow's events before and after a change: both shares, same row count, clean after."""
    one = F.lit(0).alias("_one")
    b = measure(before).select(F.col("n_events").alias("events_before"),
                               F.col("share_before_tradable").alias("share_before"), one)
    a = measure(after).select(F.col("n_events").alias("events_after"),
                              F.col("share_before_tradable").alias("share_after"), one)
    return b.join(a, "_one").drop("_one").withColumns({
        "same_rows": F.col("events_before") == F.col("events_after"), "clean_after": F.col("share_after") == 0})


def common_early_events(variants: Mapping[str, DataFrame], reference: DataFrame, events: DataFrame, key: str,
                        stratum: str = "intraday", lag_days: tuple[int, int] = (2, 5), k: int = 1) -> DataFrame:
    """F12. The largest events of a stratum that every variant uses before they were tradable, and whose publication
    came ``lag_days`` after the event.

    ``variants``: name -> (key, asof_date); ``reference``: key, first_tradable, stratum; ``events``: key, event_date,
    published_date, value.
    """
    d = reference.where(F.col("stratum") == stratum).select(key, "first_tradable").join(
        events.select(key, "event_date", "published_date", "value"), key)
    lag = F.datediff("published_date", "event_date")
    d = d.where(lag.between(*lag_days))
    for name, v in variants.items():
        d = d.join(v.select(key, F.col("asof_date").alias(f"asof_{name}")), key)
        d = d.where(F.col(f"asof_{name}") < F.col("first_tradable"))
    return d.orderBy(F.desc("value"), F.asc(key)).limit(k)


def dated_link(pairs: DataFrame, daily: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """F13. (date, entity) pairs with the identifier the symbol had on that date.

    A symbol with a class ('T/B') matches the daily file's key; a plain one its ticker, preferring no class, then
    class A.  Pairs without a match fall back to the dated name ranges.  Remaining ties: common shares (codes 10 and
    11), then the lowest id.  Every join has the symbol as an equality key.
    """
    p = pairs.select("date", "entity").distinct()
    has_class = F.contains("entity", F.lit("/"))
    cls = F.coalesce("shrcls", F.lit(""))
    pref = F.when(F.col("shrcd").isin(10, 11), 0).otherwise(1) if "shrcd" in daily.columns else F.lit(1)
    d = daily.where(F.col("key").isNotNull()).select(
        "date", "key", "ticker", "id", pref.alias("pref"),
        F.when(cls == "", 0).when(cls == "A", 1).otherwise(2).alias("cls_pref"))
    classed = p.where(has_class).join(d.withColumnRenamed("key", "entity"), ["date", "entity"]).select(
        "date", "entity", "id", "pref", F.lit(0).alias("cls_pref"))
    plain = p.where(~has_class).join(d.withColumnRenamed("ticker", "entity"), ["date", "entity"]).select(
        "date", "entity", "id", "pref", "cls_pref")
    hits = classed.unionByName(plain)
    if names is not None:
        rest = p.join(hits.select("date", "entity"), ["date", "entity"], "left_anti")
        ranged = rest.join(names.withColumnRenamed("key", "entity"), "entity").where(
            (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end")))
        hits = hits.unionByName(ranged.select("date", "entity", "id", F.lit(1).alias("pref"),
                                              F.lit(0).alias("cls_pref")))
    best = top_rows(hits, ["date", "entity"], [F.asc("cls_pref"), F.asc("pref"), F.asc("id")], 1)
    return p.join(best.select("date", "entity", F.col("id").cast("string").alias("rid")), ["date", "entity"], "left")
