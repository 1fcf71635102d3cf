"""Queries of inventory E: the calendar and availability rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calendar as K
from tidemark.operators.vintages import releases
from tidemark.plans.bindings import Data
from tidemark.plans.registry import d, n, query, r
from tidemark.specs import AvailabilityRule


def _orders(x: Data):
    return x.t("orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


_DAY = "CAST(o_orderdate AS DATE)"


@query("e1_trading_days", f"SELECT {d('session', 'session')}, idx FROM (SELECT session, CAST(idx AS BIGINT) AS idx FROM nth)")
def _(x: Data):
    return x.cal.where("is_session").select(F.col("day").alias("session"), "idx")


@query("e2_roll_forward", f"""SELECT {n('o_orderkey', 'o_orderkey')}, {d('on_or_after', 'session')}
FROM orders LEFT JOIN dim ON day = {_DAY}""")
def _(x: Data):
    return K.roll_forward(_orders(x), "day", x.cal).select("o_orderkey", "session")


@query("e3_next_session", f"""SELECT {n('o_orderkey', 'o_orderkey')}, {d('after', 'session')}
FROM orders LEFT JOIN dim ON day = {_DAY}""")
def _(x: Data):
    return K.next_session(_orders(x), "day", x.cal).select("o_orderkey", "session")


@query("e4_to_exchange_time", f"""SELECT {n('key', 'key')}, strftime(et, '%Y-%m-%d %H:%M:%S') AS et FROM accepted_""")
def _(x: Data):
    text = F.concat(F.date_format("accepted", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return x.acceptance.select("key", K.parse_exchange_time(text, "UTC").alias("et"))


@query("e5_first_open_after", f"SELECT {n('key', 'key')}, {d('first_tradable', 'first_open')} FROM first_open")
def _(x: Data):
    et = x.acceptance.withColumn("et", K.to_exchange_time(F.col("accepted"), "UTC"))
    return K.first_open_after(et, "et", x.cal).select("key", "first_open")


@query("e6_shift_sessions", f"""SELECT {n('o_orderkey', 'o_orderkey')}, {d('s.session', 'session')}
FROM orders LEFT JOIN dim ON dim.day = {_DAY} LEFT JOIN nth s ON s.idx = dim.idx + 3 AND dim.on_or_after IS NOT NULL""")
def _(x: Data):
    return K.shift_sessions(_orders(x), "day", 3, x.cal).select("o_orderkey", "session")


@query("e7_apply_rule", f"""SELECT {n('key', 'key')}, {d('s.session', 'first_tradable')} FROM first_open f
LEFT JOIN nth b ON b.session = f.first_tradable LEFT JOIN nth s ON s.idx = b.idx + 1""")
def _(x: Data):
    rule = AvailabilityRule("accepted", "next_open_after", "UTC", 1)
    return K.apply_rule(x.acceptance, rule, x.cal).select("key", "first_tradable")


_DATE_RULES = {"next_open_after": ("on_or_after", 0), "same_date_open": ("on_or_after", 2),
               "next_trading_day_open": ("after", 1)}


@query("e8_apply_date_rule", "\nUNION ALL ".join(
    f"""SELECT '{name}' AS rule, {n('o_orderkey', 'o_orderkey')}, {d('s.session', 'first_tradable')} FROM orders
LEFT JOIN dim ON dim.day = {_DAY} LEFT JOIN nth b ON b.session = dim.{col} LEFT JOIN nth s ON s.idx = b.idx + {lag}"""
    for name, (col, lag) in _DATE_RULES.items()))
def _(x: Data):
    out = None
    for name, (_, lag) in _DATE_RULES.items():
        part = K.apply_date_rule(_orders(x), AvailabilityRule("day", name, extra_lag=lag), x.cal).select(
            F.lit(name).alias("rule"), "o_orderkey", "first_tradable")
        out = part if out is None else out.unionByName(part)
    return out


@query("e9_filing_times", f"""SELECT {n('o_orderkey', 'key')}, {d('o_orderdate', 'filing_date')},
{d('min(l_shipdate)', 'trans_date')}, {d('min(l_shipdate) + INTERVAL 2 DAY', 'deemed_date')},
strftime(any_value(accepted), '%Y-%m-%d %H:%M:%S') AS accepted
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN accepted_ ON key = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def _(x: Data):
    trans = x.trans.select("key", "trans_date", F.date_add("trans_date", 2).alias("deemed_date"))
    return K.filing_times(x.filings.select("key", "filing_date"), trans, x.acceptance, "key", ["trans_date", "deemed_date"])


_STRATA = """st AS (SELECT f.*, hour(et) * 60 + minute(et) AS mins, CAST(et AS DATE) AS eday FROM first_open f),
stratum_ AS (SELECT key, eday, first_tradable, CASE WHEN NOT is_session THEN 'non_trading_day' WHEN mins < 570 THEN 'pre_open'
  WHEN mins < 960 THEN 'intraday' WHEN date_diff('day', eday, after) > 1 AND isodow(eday) <> 5
  THEN 'pre_holiday_after_close' ELSE 'after_close' END AS stratum FROM st)"""


def _stratified(x: Data):
    et = x.acceptance.withColumn("et", K.to_exchange_time(F.col("accepted"), "UTC"))
    return K.session_stratum(et, "et", x.cal)


@query("e10_session_stratum", f"WITH {_STRATA} SELECT {n('key', 'key')}, stratum FROM stratum_")
def _(x: Data):
    return _stratified(x).select("key", "stratum")


@query("e11_date_stratum", f"""SELECT {d('session', 'session')}, CASE WHEN after - session = 1 THEN 'next_day'
WHEN after - session = 3 AND isodow(session) = 5 THEN 'friday' ELSE 'before_holiday' END AS stratum
FROM nth JOIN dim ON session = day""")
def _(x: Data):
    return K.date_stratum(x.sessions, "session", x.cal)


@query("e12_stratified_sample", f"""WITH {_STRATA}, h AS (SELECT key, stratum, md5(key || '|0') AS h FROM stratum_),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS i FROM h)
SELECT {n('key', 'key')}, stratum FROM k
ORDER BY i > floor(500 / (SELECT count(DISTINCT stratum) FROM k)), h LIMIT 500""")
def _(x: Data):
    return K.stratified_sample(_stratified(x).select("key", "stratum"), "stratum", 500, "key")


@query("e13_rule_agreement", f"""WITH {_STRATA}, c AS (SELECT s.stratum, coalesce(s.first_tradable = f.after, FALSE) AS ok
  FROM stratum_ s JOIN first_open f USING (key))
SELECT stratum, {n('count(*)', 'n')}, {r('avg(ok::INT)', 'agreement')} FROM c GROUP BY ROLLUP (stratum)""")
def _(x: Data):
    gold = AvailabilityRule("accepted", "next_open_after", "UTC")
    tried = AvailabilityRule("accepted", "next_trading_day_open", "UTC")
    return K.rule_agreement(_stratified(x), tried, gold, x.cal, "stratum")


@query("e14_preview_rule", f"""WITH {_STRATA}, k AS (SELECT s.*, f.after,
  row_number() OVER (PARTITION BY s.stratum ORDER BY md5(CAST(s.key AS VARCHAR))) AS i FROM stratum_ s JOIN first_open f USING (key))
SELECT {n('key', 'key')}, stratum, {d('first_tradable', 'first_tradable')}, {d('after', 'next_trading_day')} FROM k WHERE i <= 2""")
def _(x: Data):
    rule = AvailabilityRule("accepted", "next_open_after", "UTC")
    return K.preview_rule(_stratified(x), rule, x.cal, "stratum", "key").select(
        "key", "stratum", "first_tradable", "next_trading_day")


@query("e14_preview_values", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY series_id
  ORDER BY md5(series_id || '|' || strftime(date, '%Y-%m-%d'))) AS i FROM rel)
SELECT series_id, {d('date', 'date')}, {d('on_or_after', 'first_tradable')}, {r('first_value', 'first_value')},
{r('latest_value', 'latest_value')}, {r('first_value', 'value_used')}
FROM k LEFT JOIN dim ON day = release_date WHERE i <= 1""")
def _(x: Data):
    rule = AvailabilityRule("release_date", "same_date_open", value_vintage="as_of_date")
    p = K.preview_rule(releases(x.vintages), rule, x.cal, "series_id", ["series_id", "date"], 1, "first_value",
                       "latest_value")
    return p.select("series_id", "date", "first_tradable", "first_value", "latest_value", "value_used")
