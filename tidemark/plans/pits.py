"""Queries of inventory F and G: point-in-time joins, look-ahead, vintages, signals and the panel."""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import panel as N
from tidemark.operators import pit, signals
from tidemark.operators import vintages as V
from tidemark.operators.calendar import apply_rule, session_stratum, to_exchange_time
from tidemark.plans.bindings import PANEL, Data
from tidemark.plans.calendars import _STRATA
from tidemark.plans.registry import d, n, query, r
from tidemark.session import shared_folder
from tidemark.sources.bitemporal import merge_vintages, read_vintage_table
from tidemark.specs import AvailabilityRule


@query("f1_pit_join", f"""WITH u AS (SELECT l_orderkey, after AS avail,
  arg_max(ROW(l_quantity, l_extendedprice), ROW(l_linenumber, l_partkey, l_extendedprice)) AS v
  FROM lineitem JOIN dim ON day = CAST(l_shipdate AS DATE) WHERE after IS NOT NULL GROUP BY 1, 2)
SELECT {n('o_orderkey', 'o_orderkey')}, {d('o_orderdate', 'asof')}, {d('avail', 'available')}, {r('v[1]', 'qty')}, {r('v[2]', 'price')}
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) o
ASOF LEFT JOIN u ON u.l_orderkey = o.o_orderkey AND o.o_orderdate >= u.avail""")
def _(x: Data):
    li = x.t("lineitem", "l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    right = apply_rule(li.withColumn("shipped", F.to_date("l_shipdate")),
                       AvailabilityRule("shipped", "next_trading_day_open"), x.cal, "available")
    right = right.where(F.col("available").isNotNull()).select(
        F.col("l_orderkey").alias("o_orderkey"), "available", F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), "l_linenumber", "l_partkey")
    left = x.t("orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.to_date("o_orderdate").alias("asof"))
    return pit.pit_join(left, right, "o_orderkey", "available", "asof", values=["available", "qty", "price"],
                        tie=["l_linenumber", "l_partkey", "price"])


@query("f1_pit_join_times", f"""WITH r0 AS (SELECT user_id, ts + INTERVAL 1 HOUR AS avail, arg_max(value, event_id) AS v
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT {n('event_id', 'event_id')}, {r('v', 'last_purchase')} FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN r0 ON e.user_id = r0.user_id AND e.ts >= r0.avail""")
def _(x: Data):
    e = x.t("events", "event_id", "ts", "user_id", "event_type", "value")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "event_id",
                                                      F.col("value").alias("last_purchase"))
    j = pit.pit_join(left, right, "user_id", "at", "ts", timedelta(hours=1), ["last_purchase"], ["event_id"])
    return j.select("event_id", "last_purchase")


@query("f2_pit_view", f"""SELECT entity, {d('source_time', 'source_time')}, {d('decision_time', 'decision_time')},
{r('qty', 'qty')}, {r('px', 'px', 2)}, {n('n', 'n')}, thin, quality_flag FROM view_""")
def _(x: Data):
    return x.view


_DATES = ("1996-03-15", "1998-07-01", "2000-12-29")


@query("f3_asof_snapshot", f"""WITH g AS (SELECT entity, date FROM (SELECT DISTINCT entity FROM view_),
  (VALUES {', '.join(f"(DATE '{x}')" for x in _DATES)}) v(date))
SELECT g.entity, {d('g.date', 'date')}, {d('v.decision_time', 'decision_time')}, {r('v.qty', 'qty')},
{n('a.idx - b.idx', 'feature_age')}
FROM g ASOF JOIN view_ v ON g.entity = v.entity AND g.date >= v.decision_time
JOIN dim a ON a.day = g.date JOIN dim b ON b.day = v.decision_time""")
def _(x: Data):
    s = pit.asof_snapshot(x.view, _DATES, x.cal, values=["source_time", "qty"])
    return s.select("entity", "date", "decision_time", "qty", "feature_age")


_EARLY = f"{r('coalesce(median(la) FILTER (la > 0), 0)', 'early_median')}, " \
         f"{r('coalesce(quantile_cont(la, 0.9) FILTER (la > 0), 0)', 'early_p90')}"


@query("f4_lookahead_stats", f"""WITH ref AS (SELECT l_orderkey AS key, after AS first_tradable FROM (
  SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY 1) JOIN dim ON day = last),
e AS (SELECT b.idx - a.idx AS la FROM orders LEFT JOIN ref ON key = o_orderkey
  LEFT JOIN dim a ON a.day = CAST(o_orderdate AS DATE) LEFT JOIN dim b ON b.day = first_tradable)
SELECT {n('count(*)', 'n_events')}, {n('count(la)', 'n_matched')},
{r('count(*) FILTER (la > 0) / count(la)', 'share_before_tradable')},
{r('count(*) FILTER (la = 0) / count(la)', 'share_exactly_first_tradable')},
{r('count(*) FILTER (la < 0) / count(la)', 'share_later_than_needed')}, {r('max(la)', 'early_max')}, {_EARLY} FROM e""")
def _(x: Data):
    li = x.t("lineitem", "l_orderkey", "l_shipdate")
    last = li.groupBy(F.col("l_orderkey").alias("key")).agg(F.to_date(F.max("l_shipdate")).alias("shipped"))
    ref = apply_rule(last, AvailabilityRule("shipped", "next_trading_day_open"), x.cal)
    naive = x.t("orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("key"),
                                                             F.to_date("o_orderdate").alias("asof_date"))
    return pit.lookahead_stats(naive, ref, "key", "asof_date", x.cal)


# ---------------------------------------------------------------- macro variants
GOLD_MACRO = AvailabilityRule("realtime_start", "same_date_open", value_vintage="as_of_date")
_MACRO_ASOF = {"clean": ("release_date", "first_value"), "latest": ("release_date", "latest_value"),
               "obsdate": ("date", "first_value"), "periodend": ("last_day(date)", "first_value")}


def _macro_sql(variant: str) -> str:
    when, value = _MACRO_ASOF[variant]
    return f"""(WITH ev AS (SELECT series_id, date, {value} AS value, a.on_or_after AS used_at, f.on_or_after AS ft
    FROM rel LEFT JOIN dim a ON a.day = CAST({when} AS DATE) LEFT JOIN dim f ON f.day = release_date),
  al AS (SELECT ev.*, vint.value AS allowed FROM ev LEFT JOIN vint ON ev.series_id = vint.series_id AND ev.date = vint.date
    AND vint.realtime_start <= ev.used_at AND ev.used_at < vint.realtime_end),
  z AS (SELECT *, ft IS NOT NULL AS m, ft IS NOT NULL AND coalesce(used_at < ft, FALSE) AS early,
    ft IS NOT NULL AND NOT coalesce(used_at < ft, FALSE) AND allowed IS NOT NULL AND
      NOT coalesce(abs(value - allowed) <= 1e-9, FALSE) AS wrong FROM al),
  y AS (SELECT z.*, CASE WHEN early THEN f.idx - a.idx END AS la FROM z LEFT JOIN dim f ON f.day = ft LEFT JOIN dim a ON a.day = used_at)
  SELECT '{variant}' AS variant, {n('count(*)', 'n_events')}, {n('count(*) FILTER (m)', 'n_matched')},
  {r('count(*) FILTER (early OR wrong) / count(*) FILTER (m)', 'share_before_tradable')},
  {r('count(*) FILTER (early) / count(*) FILTER (m)', 'share_used_before_release')},
  {r('count(*) FILTER (wrong) / count(*) FILTER (m)', 'share_value_not_published')},
  {r('coalesce(max(la), 0)', 'early_max')}, {r('coalesce(median(la), 0)', 'early_median')},
  {r('coalesce(quantile_cont(la, 0.9), 0)', 'early_p90')},
  {r('coalesce(median(100 * abs(value - allowed) / abs(allowed)) FILTER (wrong), 0)', 'median_abs_difference_pct')} FROM y)"""


def _macro(x: Data, variant: str):
    ev = signals.macro_features(x.vintage_table, x.cal, variant)
    s = pit.lookahead_stats_vintage(ev, x.vintage_table, GOLD_MACRO, x.cal)
    return s.select(F.lit(variant).alias("variant"), "*")


@query("f5_lookahead_vintage", f"SELECT * FROM {_macro_sql('latest')}")
def _(x: Data):
    return _macro(x, "latest")


@query("g4_macro_leaks", "\nUNION ALL ".join(f"SELECT * FROM {_macro_sql(v)}" for v in signals.MACRO_VARIANTS))
def _(x: Data):
    ev = signals.macro_variants(x.vintage_table, x.cal)
    s = pit.lookahead_stats_vintage(ev, x.vintage_table, GOLD_MACRO, x.cal, keys=["variant"])
    every = x.spark.createDataFrame([(v,) for v in signals.MACRO_VARIANTS], "variant string")
    return every.join(s, "variant", "left").na.fill(0)   # a variant without events keeps its row


# ---------------------------------------------------------------- daily pressure variants
_WINDOWS = {"universe_n": 100, "window": 3, "history": 4}
_SPAN = {"formation": ("2024-01-01", "2024-01-08"), "start": "2024-01-08", "end": "2024-01-30"}
_SIGNAL_START = "2024-01-16"
GOLD_PRESSURE = AvailabilityRule("date", "next_trading_day_open")


def _pressure_ctes(variant: str, tag: str) -> str:
    frame = "1 PRECEDING AND 1 FOLLOWING" if variant == "centered" else "2 PRECEDING AND CURRENT ROW"
    own = "avg(a) OVER (PARTITION BY symbol)" if variant == "fullmean" else "CASE WHEN count(a) OVER w >= 4 THEN avg(a) OVER w END"
    return f"""{tag}u AS (SELECT symbol FROM volumes WHERE date >= DATE '2024-01-01' AND date < DATE '2024-01-08'
  GROUP BY 1 ORDER BY quantile_cont(total_volume, 0.5) DESC, symbol LIMIT 100),
{tag}g AS (SELECT symbol, session AS date FROM {tag}u, event_sessions WHERE session BETWEEN DATE '2024-01-08' AND DATE '2024-01-30'),
{tag}r AS (SELECT g.symbol, g.date, last_value(CASE WHEN total_volume > 0 THEN short_volume / total_volume END IGNORE NULLS)
  OVER (PARTITION BY g.symbol ORDER BY g.date) AS ratio FROM {tag}g g LEFT JOIN volumes v ON g.symbol = v.symbol AND g.date = v.date),
{tag}a AS (SELECT *, CASE WHEN count(ratio) OVER w >= 3 THEN avg(ratio) OVER w END AS a FROM {tag}r
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {frame})),
{tag}s AS (SELECT symbol, date, a - {own} AS value FROM {tag}a
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _pressure_events(variant: str, tag: str) -> str:
    col = "on_or_after" if variant == "sameday" else "after"
    return f"""{tag}e AS (SELECT s.symbol, s.date, s.value, k.{col} AS asof_date FROM {tag}s s LEFT JOIN edim k ON k.day = s.date
  WHERE value IS NOT NULL AND s.date >= DATE '{_SIGNAL_START}')"""


def _pressure_sql(variant: str) -> str:
    t, f = f"{variant}_", f"{variant}ref_"
    return f"""(WITH {_pressure_ctes(variant, t)}, {_pressure_events(variant, t)}, {_pressure_ctes('clean', f)},
  z AS (SELECT e.*, k.after AS ft, f.symbol IS NOT NULL AS m, f.value AS allowed FROM {t}e e
    LEFT JOIN {f}s f ON e.symbol = f.symbol AND e.date = f.date LEFT JOIN edim k ON k.day = e.date),
  y AS (SELECT z.*, m AND coalesce(asof_date < ft, FALSE) AS early, m AND NOT coalesce(asof_date < ft, FALSE) AND
    NOT coalesce(abs(value - allowed) <= 1e-12, FALSE) AS wrong FROM z),
  x AS (SELECT y.*, CASE WHEN early THEN b.idx - a.idx END AS la FROM y LEFT JOIN edim b ON b.day = ft LEFT JOIN edim a ON a.day = asof_date)
  SELECT '{variant}' AS variant, {n('count(*)', 'n_events')}, {n('count(*) FILTER (m)', 'n_matched')},
  {r('count(*) FILTER (early OR wrong) / count(*) FILTER (m)', 'share_before_tradable')},
  {r('count(*) FILTER (early) / count(*) FILTER (m)', 'share_used_before_release')},
  {r('count(*) FILTER (wrong) / count(*) FILTER (m)', 'share_value_not_public')},
  {r('coalesce(max(la), 0)', 'early_max')}, {r('coalesce(median(la), 0)', 'early_median')},
  {r('coalesce(quantile_cont(la, 0.9), 0)', 'early_p90')} FROM x)"""


def _event_sessions(x: Data):
    return x.event_cal.where("is_session").select(F.col("day").alias("session"))


def _pressure(x: Data, variant: str):
    s = _event_sessions(x)
    ref = signals.pressure_reference(x.volumes, s, **_SPAN, **_WINDOWS)
    ev = signals.pressure_signal(x.volumes, s, x.event_cal, signal_start=_SIGNAL_START, variant=variant, **_SPAN, **_WINDOWS)
    return pit.lookahead_stats_signal(ev, ref, GOLD_PRESSURE, x.event_cal).select(F.lit(variant).alias("variant"), "*")


@query("f6_lookahead_signal", f"SELECT * FROM {_pressure_sql('centered')}")
def _(x: Data):
    return _pressure(x, "centered")


@query("g4_pressure_leaks", "\nUNION ALL ".join(f"SELECT * FROM {_pressure_sql(v)}" for v in signals.PRESSURE_VARIANTS))
def _(x: Data):
    return reduce(DataFrame.unionByName, [_pressure(x, v) for v in signals.PRESSURE_VARIANTS])


@query("g3_pressure_signal", f"""WITH {_pressure_ctes('clean', 'c_')}, {_pressure_events('clean', 'c_')}
SELECT symbol, {d('date', 'date')}, {d('asof_date', 'asof_date')}, {r('value', 'value')} FROM c_e""")
def _(x: Data):
    return signals.pressure_signal(x.volumes, _event_sessions(x), x.event_cal, signal_start=_SIGNAL_START, **_SPAN,
                                   **_WINDOWS)


# ---------------------------------------------------------------- vintages
@query("f7_releases", f"""SELECT series_id, {d('date', 'date')}, {d('release_date', 'release_date')}, {r('first_value', 'first_value')},
{r('latest_value', 'latest_value')}, {n('n_vintages', 'n_vintages')}, revised FROM rel""")
def _(x: Data):
    return V.releases(x.vintages)


@query("f8_release_lag", f"""SELECT series_id, {n('count(*)', 'n_observations')}, """ + ", ".join(
    r(f"quantile_cont(date_diff('day', date, release_date), {p})", name) for name, p in V.LAG_PROBS.items())
    + " FROM rel WHERE date >= DATE '1997-01-01' GROUP BY 1")
def _(x: Data):
    return V.release_lag(x.vintages, "1997-01-01")


@query("f8_release_weekdays", f"""SELECT series_id, {n('isodow(release_date) - 1', 'weekday')}, {n('count(*)', 'n')}
FROM rel GROUP BY series_id, isodow(release_date)""")
def _(x: Data):
    return V.release_weekdays(x.vintages)


@query("f9_revision_stats", f"""SELECT series_id, {n('count(*)', 'n_observations')}, {r('avg(revised::INT)', 'share_revised')},
{r('coalesce(median(100 * abs(latest_value - first_value) / abs(first_value)) FILTER (revised), 0)', 'median_abs_revision_pct')},
{r('median(n_vintages)', 'median_vintages')} FROM rel GROUP BY 1""")
def _(x: Data):
    return V.revision_stats(x.vintages)


@query("f10_vintage_lookup", f"""SELECT series_id, {d('date', 'date')}, {d('realtime_start', 'realtime_start')},
strftime(realtime_end, '%Y-%m-%d') AS realtime_end, {r('value', 'value')} FROM vint
WHERE series_id = 'S3' AND date = DATE '1998-04-01' ORDER BY realtime_start, value""")
def _(x: Data):
    return V.vintage_lookup(x.vintages, "S3", "1998-04-01")


@query("f11_largest_revision", f"""WITH t AS (SELECT * FROM rel WHERE date >= DATE '1998-01-01'
  ORDER BY abs(latest_value - first_value) DESC, series_id, date LIMIT 1)
SELECT series_id, {d('date', 'date')}, {d('realtime_start', 'realtime_start')}, {r('value', 'value')}, {d('t.release_date', 'release_date')}
FROM vint JOIN t USING (series_id, date)""")
def _(x: Data):
    return V.largest_revision(x.vintages, since="1998-01-01").select("series_id", "date", "realtime_start", "value",
                                                                    "release_date")


@query("f7_merged_vintages", f"""SELECT series_id, {d('date', 'date')}, {d('realtime_start', 'realtime_start')},
strftime(realtime_end, '%Y-%m-%d') AS realtime_end, {r('value', 'value')} FROM vint""")
def _(x: Data):
    """Three arrivals: even days, odd days, which split the intervals of the even ones, and corrections of one day's values.
    All prices arrive; a merge keeps the largest of a day."""
    path = f"{shared_folder(x.spark)}/vintages-{uuid.uuid4().hex}"
    day, value = F.dayofmonth("realtime_start"), F.col("value")
    def arrival(number, value):
        return F.struct(F.lit(number).alias("arrival"), value.alias("value"))
    lands = F.when(day == 14, F.array(arrival(0, value + 1), arrival(2, value))).otherwise(F.array(arrival(day % 2, value)))
    v = x.prices_published.where(day.isNotNull()).select("series_id", "date", "realtime_start", F.explode(lands).alias("a"))
    v = v.select("series_id", "date", "realtime_start", "a.value", "a.arrival")
    v.write.partitionBy("arrival").parquet(f"{path}/arrivals")   # as three deliveries lie, each is read alone
    landed = x.spark.read.schema(v.schema).parquet(f"{path}/arrivals")
    for number, key in enumerate(("even", "odd", "corrected")):
        merge_vintages(landed.where(F.col("arrival") == number), f"{path}/table", key)
    return read_vintage_table(x.spark, f"{path}/table")


# ---------------------------------------------------------------- insider purchases
_ROLES = "BUILDING|MACHINERY"
_BUYS = """buys AS (SELECT l_orderkey AS key, sum(l_quantity * l_extendedprice) AS value, count(*) AS n_trans,
  CAST(min(l_shipdate) AS DATE) AS trans_date FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey IN (
  SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
  GROUP BY 1),
ev0 AS (SELECT b.*, o_custkey AS issuer, CAST(o_orderdate AS DATE) AS filing_date, f.et, f.first_tradable
  FROM buys b JOIN orders ON o_orderkey = b.key JOIN first_open f ON f.key = b.key WHERE o_orderstatus IN ('F', 'O'))"""
_EVENT_ASOF = {"clean": "first_tradable", "transdate": "(SELECT on_or_after FROM dim WHERE day = trans_date)",
               "filingdate": "(SELECT on_or_after FROM dim WHERE day = filing_date)",
               "noclose": "CASE WHEN hour(et) >= 16 THEN (SELECT after FROM dim WHERE day = CAST(et AS DATE)) "
                          "ELSE (SELECT on_or_after FROM dim WHERE day = CAST(et AS DATE)) END"}


def _events(x: Data, variant: str = "clean"):
    return signals.event_table(x.trans, x.owners, x.filings, x.acceptance, x.cal, variant, codes=("R",), roles=_ROLES)


@query("g1_event_table", f"""WITH {_BUYS} SELECT {n('key', 'key')}, {n('issuer', 'issuer')}, {d('first_tradable', 'asof_date')},
{r('value', 'value', 2)}, {n('n_trans', 'n_trans')}, {d('trans_date', 'trans_date')}, {d('filing_date', 'filing_date')} FROM ev0""", digits=2)
def _(x: Data):
    return _events(x).drop("accepted_et")


@query("g4_event_leaks", f"WITH {_BUYS} " + "\nUNION ALL ".join(f"""SELECT '{v}' AS variant, {n('count(*)', 'n_events')},
{n('count(la)', 'n_matched')}, {r('count(*) FILTER (la > 0) / count(la)', 'share_before_tradable')},
{r('count(*) FILTER (la = 0) / count(la)', 'share_exactly_first_tradable')},
{r('count(*) FILTER (la < 0) / count(la)', 'share_later_than_needed')}, {r('max(la)', 'early_max')}, {_EARLY}
FROM (SELECT f.idx - a.idx AS la FROM (SELECT *, {sql} AS used_at FROM ev0) e LEFT JOIN dim f ON f.day = first_tradable
  LEFT JOIN dim a ON a.day = used_at)""" for v, sql in _EVENT_ASOF.items()))
def _(x: Data):
    ref = apply_rule(x.acceptance, AvailabilityRule("accepted", "next_open_after", "UTC"), x.cal)
    parts = [pit.lookahead_stats(_events(x, v), ref, "key", "asof_date", x.cal).select(F.lit(v).alias("variant"), "*")
             for v in signals.EVENT_VARIANTS]
    return reduce(DataFrame.unionByName, parts)


@query("f12_common_early_events", f"""WITH {_BUYS}, {_STRATA},
w AS (SELECT e.key, e.value, e.trans_date, s.eday, s.first_tradable, s.stratum,
  {', '.join(f'{sql.replace("first_tradable", "e.first_tradable")} AS {v}' for v, sql in _EVENT_ASOF.items() if v != 'clean')}
  FROM ev0 e JOIN stratum_ s ON s.key = e.key)
SELECT {n('key', 'key')}, {r('value', 'value', 2)}, {d('first_tradable', 'first_tradable')}, {d('transdate', 'asof_transdate')},
{d('filingdate', 'asof_filingdate')} FROM w WHERE stratum = 'intraday' AND date_diff('day', trans_date, eday) BETWEEN 2 AND 500
AND transdate < first_tradable AND filingdate < first_tradable ORDER BY value DESC, key LIMIT 5""", digits=2)
def _(x: Data):
    et = x.acceptance.withColumn("et", to_exchange_time(F.col("accepted"), "UTC"))
    ref = apply_rule(session_stratum(et, "et", x.cal), AvailabilityRule("accepted", "next_open_after", "UTC"), x.cal)
    clean = _events(x)
    ev = clean.select("key", F.col("trans_date").alias("event_date"), F.to_date("accepted_et").alias("published_date"),
                      "value")
    variants = {v: _events(x, v).select("key", "asof_date") for v in ("transdate", "filingdate")}
    c = pit.common_early_events(variants, ref, ev, "key", lag_days=(2, 500), k=5)
    return c.select("key", "value", "first_tradable", "asof_transdate", "asof_filingdate")


@query("g2_macro_features", f"""SELECT series_id, {d('date', 'date')}, {d('on_or_after', 'asof_date')}, {r('first_value', 'value')},
{d('release_date', 'release_date')}, strftime(CASE WHEN series_id IN ('S1', 'S2') THEN
  date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY ELSE last_day(date) END, '%Y-%m-%d') AS period_end
FROM rel LEFT JOIN dim ON day = release_date""")
def _(x: Data):
    return signals.macro_features(x.vintages, x.cal, quarterly=("S1", "S2"))


@query("f14_compare_lookahead", f"""WITH b AS {_macro_sql('obsdate')}, a AS {_macro_sql('clean')}
SELECT b.n_events AS events_before, b.share_before_tradable AS share_before, a.n_events AS events_after,
a.share_before_tradable AS share_after, b.n_events = a.n_events AS same_rows, a.share_before_tradable = 0 AS clean_after FROM a, b""")
def _(x: Data):
    def measure(ev):
        return pit.lookahead_stats_vintage(ev, x.vintage_table, GOLD_MACRO, x.cal)
    return pit.compare_lookahead(signals.macro_features(x.vintage_table, x.cal, "obsdate"),
                                 signals.macro_features(x.vintage_table, x.cal), measure)


# ---------------------------------------------------------------- dated identifiers
_LINK = """dl0 AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, replace(p_brand, '#', '') AS ticker,
  CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' END AS shrcls, l_suppkey AS id,
  CASE WHEN l_linestatus = 'O' THEN 10 ELSE 12 END AS shrcd FROM lineitem JOIN part ON l_partkey = p_partkey),
dly AS (SELECT *, ticker || coalesce('/' || shrcls, '') AS key FROM dl0),
nm AS (SELECT ticker AS key, min(id) AS id, make_date(year(date), 1, 1) AS start, make_date(year(date), 12, 31) AS fin
  FROM dl0 GROUP BY ticker, year(date)),
prs AS (SELECT DISTINCT date, ticker AS entity FROM dly UNION SELECT DISTINCT date, ticker || '/B' FROM dly
  UNION SELECT DISTINCT CAST(date + 1 AS DATE), ticker FROM dly UNION SELECT DISTINCT date, 'NOPE' FROM dly),
ht AS (SELECT p.date, p.entity, id, CASE WHEN shrcd IN (10, 11) THEN 0 ELSE 1 END AS pref, 0 AS cp FROM prs p
    JOIN dly ON p.date = dly.date AND p.entity = dly.key WHERE contains(p.entity, '/')
  UNION ALL SELECT p.date, p.entity, id, CASE WHEN shrcd IN (10, 11) THEN 0 ELSE 1 END,
    CASE WHEN shrcls IS NULL THEN 0 WHEN shrcls = 'A' THEN 1 ELSE 2 END FROM prs p
    JOIN dly ON p.date = dly.date AND p.entity = dly.ticker WHERE NOT contains(p.entity, '/')),
ha AS (SELECT * FROM ht UNION ALL SELECT p.date, p.entity, nm.id, 1, 0 FROM prs p JOIN nm ON p.entity = nm.key
  AND p.date BETWEEN nm.start AND nm.fin WHERE (p.date, p.entity) NOT IN (SELECT (date, entity) FROM ht)),
hb AS (SELECT * FROM ha QUALIFY row_number() OVER (PARTITION BY date, entity ORDER BY cp, pref, id) = 1)"""


@query("f13_dated_link", f"""WITH {_LINK} SELECT {d('p.date', 'date')}, p.entity, CAST(hb.id AS VARCHAR) AS rid
FROM prs p LEFT JOIN hb USING (date, entity)""")
def _(x: Data):
    li = x.t("lineitem", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus").join(
        x.t("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    cls = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B")
    daily = li.select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"),
                      F.replace("p_brand", F.lit("#"), F.lit("")).alias("ticker"), cls.alias("shrcls"),
                      F.col("l_suppkey").alias("id"),
                      F.when(F.col("l_linestatus") == "O", 10).otherwise(12).alias("shrcd")).distinct()
    daily = daily.withColumn("key", F.concat("ticker", F.coalesce(F.concat(F.lit("/"), "shrcls"), F.lit(""))))
    names = daily.groupBy(F.col("ticker").alias("key"), F.year("date").alias("y")).agg(F.min("id").alias("id")).select(
        "key", "id", F.make_date("y", F.lit(1), F.lit(1)).alias("start"),
        F.make_date("y", F.lit(12), F.lit(31)).alias("end"))
    pairs = daily.select("date", F.explode(F.array(
        F.struct("date", F.col("ticker").alias("entity")),
        F.struct("date", F.concat("ticker", F.lit("/B")).alias("entity")),
        F.struct(F.date_add("date", 1).alias("date"), F.col("ticker").alias("entity")),
        F.struct("date", F.lit("NOPE").alias("entity")))).alias("p")).select("p.date", "p.entity")
    return pit.dated_link(pairs, daily, names)


# ---------------------------------------------------------------- panel
@query("g5_universe", """SELECT entity FROM view_ WHERE decision_time BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'
GROUP BY entity ORDER BY quantile_cont(qty, 0.5) DESC, entity LIMIT 1000""")
def _(x: Data):
    return N.universe(x.view, PANEL)


@query("g6_liquidity_proxy", f"""SELECT entity, {d('decision_time', 'decision_time')}, {r('CASE WHEN count(qty) OVER w >= 3 THEN avg(qty) OVER w END', 'adv_proxy')}
FROM view_ WINDOW w AS (PARTITION BY entity ORDER BY decision_time, source_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(x: Data):
    return N.liquidity_proxy(x.view, "qty", 6, 3).select("entity", "decision_time", "adv_proxy")


@query("g7_latest_per_date", f"""WITH w AS (SELECT 'U' || user_id AS entity, event_id, after AS decision_time, ts FROM events
  JOIN edim ON day = CAST(ts AS DATE) WHERE after IS NOT NULL)
SELECT entity, {d('decision_time', 'decision_time')}, {n('event_id', 'event_id')} FROM w
QUALIFY row_number() OVER (PARTITION BY entity, decision_time ORDER BY ts DESC, event_id DESC) = 1""")
def _(x: Data):
    e = x.t("events", "event_id", "ts", "user_id").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity"), "event_id",
        F.col("ts").alias("source_time"), F.to_date("ts").alias("day"))
    e = apply_rule(e, AvailabilityRule("day", "next_trading_day_open"), x.event_cal, "decision_time")
    return N.latest_per_date(e.where(F.col("decision_time").isNotNull()), ("event_id",)).select(
        "entity", "decision_time", "event_id")


@query("g8_asof_value", f"""SELECT {d('date', 'date')}, entity, {r('size_float', 'size_float')} FROM sized""")
def _(x: Data):
    p = x.panel.join(x.symbols.select("entity", "cik"), "entity", "left")
    return N.asof_value(p, x.facts, "public_float", "size_float").select("date", "entity", "size_float")


@query("g9_build_panel", f"""SELECT {d('date', 'date')}, entity, {r('qty', 'qty')}, {r('px', 'px', 2)}, {n('n', 'n')}, quality_flag,
{r('adv_proxy', 'adv_proxy')}, sector, {r('size_float', 'size_float')}, {r('size_assets', 'size_assets')} FROM sized""")
def _(x: Data):
    return x.sized_panel


@query("g9_panel_meta", f"""SELECT {n('count(*)', 'n_rows')}, {n('count(DISTINCT date)', 'n_dates')},
{n('count(DISTINCT entity)', 'n_entities')}, '1996-01-01' AS start, '2001-12-31' AS "end", 1000::BIGINT AS universe_n FROM panel""")
def _(x: Data):
    return N.panel_meta(x.panel, PANEL).drop("hash")


@query("g10_describe_panel", f"""SELECT {n('count(*)', 'rows')}, {n('count(DISTINCT date)', 'dates')}, {n('count(DISTINCT entity)', 'entities')},
{d('min(date)', 'first_date')}, {d('max(date)', 'last_date')}, {r('count(adv_proxy) / count(*)', 'adv_proxy_coverage')},
{r('count(size_float) / count(*)', 'size_float_coverage')}, {r('count(size_assets) / count(*)', 'size_assets_coverage')},
{r("count(*) FILTER (sector <> 'Unknown') / count(*)", 'sector_coverage')} FROM sized""")
def _(x: Data):
    return N.describe_panel(x.sized_panel)


@query("g10_entities_per_sector", f"SELECT sector, {n('count(DISTINCT entity)', 'entities')} FROM panel GROUP BY 1")
def _(x: Data):
    return N.entities_per_sector(x.panel)
