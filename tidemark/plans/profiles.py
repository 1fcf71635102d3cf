"""Queries of inventory B: profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import identifier_class
from tidemark.operators import profile as P
from tidemark.plans.bindings import Data
from tidemark.plans.registry import d, n, query, r
from tidemark.specs import AvailabilityRule

_ORDERS = {"o_orderkey": ("bigint", "num"), "o_custkey": ("bigint", "num"), "o_orderstatus": ("string", ""),
           "o_totalprice": ("double", "num"), "o_orderdate": ("timestamp", "time"), "o_orderpriority": ("string", "")}


def _profile_sql(table: str, cols: dict) -> str:
    parts = []
    for c, (dtype, kind) in cols.items():
        num, time = kind == "num", kind == "time"
        parts.append(f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, {n('count(*)', 'n_rows')},
  {r(f'(count(*) - count({c})) / count(*)', 'null_rate')}, {n(f'count(DISTINCT {c})', 'n_distinct')},
  count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique,
  {r(f'min({c})', 'min_number') if num else 'NULL::DOUBLE AS min_number'},
  {r(f'max({c})', 'max_number') if num else 'NULL::DOUBLE AS max_number'},
  {d(f'min({c})', 'min_date') if time else 'NULL AS min_date'}, {d(f'max({c})', 'max_date') if time else 'NULL AS max_date'},
  CASE WHEN count(DISTINCT {c}) <= 40 THEN (SELECT string_agg(v || '=' || k, ', ' ORDER BY k DESC, v) FROM (
    SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY 1
    ORDER BY k DESC, v LIMIT 6)) END AS top,
  CASE WHEN count(DISTINCT {c}) > 40 THEN (SELECT string_agg(substr(v, 1, 40), ', ' ORDER BY v) FROM (
    SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY v LIMIT 2)) END AS examples
  FROM {table}""")
    return "\nUNION ALL ".join(parts)


@query("b1_profile_table", _profile_sql("orders", _ORDERS))
def _(x: Data):
    return P.profile_table(x.t("orders"))


# identifiers in several written forms
_ID = """CASE p_size % 6 WHEN 0 THEN a WHEN 1 THEN a || b WHEN 2 THEN a || 'pA' WHEN 3 THEN a || '/' || lower(b)
  WHEN 4 THEN a || '-' || p_size ELSE CAST(p_partkey AS VARCHAR) END"""
_IDS = f"""ids AS (SELECT {_ID} AS id, p_retailprice FROM (SELECT *, upper(split_part(p_name, ' ', 1)) AS a,
  upper(split_part(p_name, ' ', 2)) AS b FROM part)),
cls AS (SELECT *, CASE WHEN regexp_full_match(id, '[A-Z]{{1,5}}') THEN 'letters only (1-5)'
  WHEN regexp_full_match(id, '[A-Z]{{6,}}') THEN 'letters only (6+)'
  WHEN regexp_full_match(id, '[A-Z]+[a-z][A-Z]?') THEN 'lower-case class letter (e.g. ABCpA)'
  WHEN contains(id, '/') THEN 'suffix after ''/'': ' || upper(substr(id, strpos(id, '/') + 1))
  WHEN contains(id, '.') THEN 'suffix after ''.'': ' || upper(substr(id, strpos(id, '.') + 1))
  WHEN contains(id, '-') THEN 'suffix after ''-'': ' || upper(substr(id, strpos(id, '-') + 1))
  WHEN regexp_matches(id, '[0-9]') THEN 'contains digits' ELSE 'other' END AS class FROM ids)"""


def _ids(x: Data):
    p = x.t("part")
    a = F.upper(F.element_at(F.split("p_name", " "), 1))
    b = F.upper(F.element_at(F.split("p_name", " "), 2))
    form = F.col("p_size") % 6
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    ident = (F.when(form == 0, a).when(form == 1, F.concat(a, b)).when(form == 2, F.concat(a, F.lit("pA")))
             .when(form == 3, F.concat(a, F.lit("/"), F.lower(b))).when(form == 4, F.concat(a, F.lit("-"), size))
             .otherwise(key))
    return p.select(ident.alias("id"), "p_retailprice")


@query("b2_identifier_class", f"WITH {_IDS} SELECT class, {n('count(*)', 'n')} FROM cls GROUP BY 1")
def _(x: Data):
    return _ids(x).groupBy(identifier_class(F.col("id")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("b3_identifier_patterns", f"""WITH {_IDS}, u AS (SELECT id, class, count(*) AS k, sum(p_retailprice) AS w
  FROM cls GROUP BY 1, 2),
g AS (SELECT class, count(*) AS nd, sum(k) AS k, sum(w) AS w FROM u GROUP BY 1)
SELECT class, {n('nd', 'n_distinct')}, {r('nd / (SELECT sum(nd) FROM g)', 'share_of_distinct')},
{r('k / (SELECT sum(k) FROM g)', 'share_of_rows')}, {r('w / (SELECT sum(w) FROM g)', 'share_of_weight')},
(SELECT string_agg(id, ', ' ORDER BY id) FROM (SELECT id FROM u WHERE u.class = g.class ORDER BY id LIMIT 6)) AS examples,
nd / (SELECT sum(nd) FROM g) >= 0.01 AS above_1pct FROM g""")
def _(x: Data):
    return P.identifier_patterns(_ids(x), "id", "p_retailprice")


def _times(x: Data):
    day = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return x.t("events", "event_id", "ts").withColumn("day", day)


_TIME_LONG = """l AS (SELECT 'ts' AS "column", ts AS t FROM events
  UNION ALL SELECT 'day', CASE WHEN event_id % 10 <> 0 THEN date_trunc('day', ts) END FROM events)"""


@query("b4_profile_time", f"""WITH {_TIME_LONG}
SELECT "column", {n('count(*)', 'n_rows')}, {r('count(t) / count(*)', 'parse_rate')},
strftime(min(t), '%Y-%m-%d %H:%M:%S') AS min_time, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS max_time,
{r("count(*) FILTER (t <> date_trunc('day', t)) / count(t)", 'share_with_time_of_day')} FROM l GROUP BY 1""")
def _(x: Data):
    return P.profile_time(_times(x), ["ts", "day"])


@query("b4_time_histograms", f"""WITH {_TIME_LONG}, k AS (SELECT * FROM l WHERE t IS NOT NULL)
SELECT "column", 'weekday' AS kind, dayname(t)[1:3] AS bucket, {n('count(*)', 'n')} FROM k GROUP BY 1, 3
UNION ALL SELECT "column", 'month', strftime(t, '%Y-%m') AS b, count(*) FROM k GROUP BY 1, 3
UNION ALL SELECT "column", 'hour', CAST(hour(t) AS VARCHAR), count(*) FROM k WHERE "column" = 'ts' GROUP BY 1, 3""")
def _(x: Data):
    return P.time_histograms(_times(x), ["ts", "day"])


def _lag_sql(lags: str) -> str:
    q = ", ".join(r(f"quantile_cont(lag, {p})", name) for name, p in P.LAG_PROBS.items())
    return f"""WITH g AS ({lags}) SELECT {n('count(*)', 'n_pairs')}, {q}, {r('avg((lag < 0)::INT)', 'share_negative')},
{r('avg((lag = 0)::INT)', 'share_zero')}, {r('avg((lag > 2)::INT)', 'share_gt_2')}, {n('min(lag)', 'min_lag')},
{n('max(lag)', 'max_lag')} FROM g"""


@query("b5_lag_distribution", _lag_sql("""SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderstatus = 'F'"""))
def _(x: Data):
    li = x.t("lineitem", "l_orderkey", "l_shipdate", "l_returnflag").withColumnRenamed("l_orderkey", "key")
    o = x.t("orders", "o_orderkey", "o_orderdate", "o_orderstatus").withColumnRenamed("o_orderkey", "key")
    return P.lag_distribution(o, "o_orderdate", li, "l_shipdate", "key",
                              only=[li.where("l_returnflag = 'R'"), o.where("o_orderstatus = 'F'")])


@query("b5_lag_in_zone", _lag_sql("""SELECT date_diff('day', CAST(et AS DATE), CAST(l_shipdate AS DATE)) AS lag
FROM accepted_ JOIN lineitem ON key = l_orderkey"""))
def _(x: Data):
    li = x.t("lineitem", "l_orderkey", "l_shipdate").withColumnRenamed("l_orderkey", "key")
    return P.lag_distribution(x.acceptance, "accepted", li, "l_shipdate", "key", a_zone="America/New_York")


@query("b6_opaque_code_columns", f"""WITH t AS (SELECT o_orderstatus, o_orderpriority,
  CAST(o_orderkey % 2 AS VARCHAR) AS flag, 'F' || CAST(o_custkey % 5 AS VARCHAR) AS note FROM orders),
l AS (UNPIVOT t ON o_orderstatus, o_orderpriority, flag, note INTO NAME "column" VALUE v),
g AS (SELECT "column", count(DISTINCT v) AS nd, quantile_cont(length(v), 0.5) AS len,
  bool_and(lower(v) IN ('0', '1', 'true', 'false')) AS flags FROM l GROUP BY 1),
nu AS (SELECT "column", avg(regexp_full_match(v, '[A-Za-z]{{1,2}}[0-9]+(\\s*,\\s*[A-Za-z]{{1,2}}[0-9]+)*')::INT) AS s
  FROM (SELECT DISTINCT "column", v FROM l) GROUP BY 1)
SELECT g."column", {n('nd', 'n_distinct')}, {r('len', 'median_length')},
nd <= 40 AND len <= 3 AND NOT flags AND s < 0.8 AS opaque FROM g JOIN nu ON g."column" = nu."column" """)
def _(x: Data):
    o = x.t("orders").select("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 2).cast("string").alias("flag"),
                             F.concat(F.lit("F"), (F.col("o_custkey") % 5).cast("string")).alias("note"))
    return P.opaque_code_columns(o)


@query("b7_is_date_only", f"""SELECT {n('count(o_orderdate)', 'n')}, bool_and(o_orderdate = date_trunc('day', o_orderdate))
AS date_only FROM orders""")
def _(x: Data):
    return P.is_date_only(x.t("orders", "o_orderdate"), "o_orderdate")


@query("b7_check_same_day_use", """SELECT 'o_orderdate' AS source, 'same_date_open' AS tradable_at,
bool_and(o_orderdate = date_trunc('day', o_orderdate)) AS date_only,
count(*) > 0 AND bool_and(o_orderdate = date_trunc('day', o_orderdate)) AS uses_same_day FROM orders""")
def _(x: Data):
    return P.check_same_day_use(x.t("orders", "o_orderdate"), AvailabilityRule("o_orderdate", "same_date_open"),
                                "event_time")


@query("b8_lookup", f"""SELECT {n('l_linenumber', 'l_linenumber')}, {n('l_partkey', 'l_partkey')}, {r('l_quantity', 'l_quantity')}
FROM lineitem WHERE l_orderkey = 42""")
def _(x: Data):
    return P.lookup(x.t("lineitem"), "l_orderkey", 42).select("l_linenumber", "l_partkey", "l_quantity")


@query("b9_timezone_consistency", f"""WITH f AS (SELECT ts, event_type, CAST(ts AS DATE)
  + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS fd FROM events),
rd AS (SELECT 'utc' AS reading, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t, * EXCLUDE ts FROM f
  UNION ALL SELECT 'face_value', ts, * EXCLUDE ts FROM f),
g AS (SELECT *, event_type IN ('purchase', 'signup') AS listed FROM rd),
c AS (SELECT g.*, k.form_group, k.cutoff, hour(t) * 60 + minute(t) AS mins, CAST(t AS DATE) AS day
  FROM g JOIN (VALUES ('listed', 1320), ('listed', 1050), ('other', 1050)) k(form_group, cutoff)
  ON (k.form_group = 'listed') = listed),
s AS (SELECT *, isodow(t) <= 5 AND mins < cutoff AS same FROM c),
a AS (SELECT reading, form_group, cutoff, count(*) FILTER (same) AS ns, count(*) FILTER (same AND fd = day) AS os,
  count(*) FILTER (NOT same) AS nn, count(*) FILTER (NOT same AND fd > day) AS onx, count(*) FILTER (fd < day) AS imp,
  count(*) FILTER (mins >= 1320 OR mins < 360) AS night FROM s GROUP BY 1, 2, 3),
b AS (SELECT reading, max((os + onx) / (ns + nn)) FILTER (form_group = 'listed' AND cutoff = 1320) AS score FROM a GROUP BY 1)
SELECT a.reading, form_group, {n('cutoff', 'cutoff')}, {n('ns', 'n_pred_same_day')},
{r('os / greatest(ns, 1)', 'consistent_same_day')}, {n('nn', 'n_pred_next_day')},
{r('onx / greatest(nn, 1)', 'consistent_next_day')}, {n('imp', 'n_impossible')}, {n('night', 'n_night')},
b.score = (SELECT max(score) FROM b) AS best FROM a JOIN b ON a.reading = b.reading""")
def _(x: Data):
    return P.timezone_consistency(_filed_events(x), "ts", "fd", "event_type", ["purchase", "signup"])


def _filed_events(x: Data):
    e = x.t("events", "event_id", "ts", "event_type")
    return e.withColumn("fd", F.date_add(F.to_date("ts"), F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)))


@query("b9_hour_histogram", f"""WITH f AS (SELECT 'utc' AS reading,
hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS h FROM events WHERE event_type IN ('purchase', 'signup')
UNION ALL SELECT 'face_value', hour(ts) FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT reading, {n('h', 'hour')}, {n('count(*)', 'n')} FROM f GROUP BY 1, h""")
def _(x: Data):
    return P.hour_histogram(_filed_events(x), "ts", "event_type", ["purchase", "signup"])
