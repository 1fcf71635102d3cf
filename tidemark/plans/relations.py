"""Shared relations of the check SQL: the same bindings, written for DuckDB."""

RELATIONS: dict[str, str] = {}

RELATIONS["sessions_"] = """
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders
  WHERE isodow(o_orderdate) <= 5 AND strftime(o_orderdate, '%m-%d') NOT IN ('01-01', '07-04', '12-25')"""
RELATIONS["event_sessions"] = """
  SELECT DISTINCT CAST(ts AS DATE) AS session FROM events
  WHERE isodow(ts) <= 5 AND strftime(ts, '%m-%d') NOT IN ('01-01', '07-04', '12-25')"""


def _dimension(sessions: str) -> str:
    return f"""
  SELECT day, s.session IS NOT NULL AS is_session,
         min(s.session) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS on_or_after,
         min(s.session) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
         count(s.session) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS idx
  FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS day) c
  LEFT JOIN {sessions} s ON s.session = c.day"""


RELATIONS["dim"] = _dimension("sessions_")
RELATIONS["edim"] = _dimension("event_sessions")
# the nth session, counted from 0
RELATIONS["nth"] = "SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx FROM sessions_"

RELATIONS["monthly"] = """
  SELECT 'S' || l_suppkey AS entity, l_suppkey AS cik, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS px, count(*) AS n, count(*) < 3 AS thin,
         round(sum(l_extendedprice), 2) / sum(l_quantity) AS prc,
         round(sum(l_extendedprice) FILTER (day(l_shipdate) <= 15), 2)
           / sum(l_quantity) FILTER (day(l_shipdate) <= 15) AS openprc,
         min(l_extendedprice / l_quantity) AS bid, max(l_extendedprice / l_quantity) AS ask
  FROM lineitem GROUP BY 1, 2, 3"""
RELATIONS["view_"] = """
  SELECT entity, month AS source_time, after AS decision_time, qty, px, n, thin, thin AS quality_flag
  FROM monthly JOIN dim ON month = day WHERE after IS NOT NULL"""
RELATIONS["symbols"] = """
  SELECT 'S' || s_suppkey AS entity, s_suppkey AS cik,
         CASE WHEN r_name = 'MIDDLE EAST' THEN 'Unknown' ELSE r_name END AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
RELATIONS["facts"] = """
  SELECT l_suppkey AS cik, CASE WHEN l_linenumber % 2 = 1 THEN 'public_float' ELSE 'assets' END AS item,
         CAST(l_shipdate AS DATE) - CAST(l_partkey % 90 AS INTEGER) AS "end", CAST(l_shipdate AS DATE) AS filed,
         l_extendedprice AS val
  FROM lineitem"""
RELATIONS["universe_"] = """
  SELECT entity FROM view_ WHERE decision_time BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'
  GROUP BY entity ORDER BY quantile_cont(qty, 0.5) DESC, entity LIMIT 1000"""
RELATIONS["panel"] = """
  SELECT decision_time AS date, entity, qty, px, n, quality_flag, adv_proxy, coalesce(sector, 'Unknown') AS sector, cik
  FROM (SELECT *, CASE WHEN count(qty) OVER w >= 3 THEN avg(qty) OVER w END AS adv_proxy
        FROM view_ WHERE entity IN (SELECT entity FROM universe_)
        WINDOW w AS (PARTITION BY entity ORDER BY decision_time, source_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
  LEFT JOIN symbols USING (entity)
  WHERE decision_time BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'
  QUALIFY row_number() OVER (PARTITION BY entity, decision_time ORDER BY source_time DESC) = 1"""


def _fact(item: str) -> str:
    return f"""SELECT cik, filed + 1 AS avail, arg_max(val, ROW("end", val)) AS val FROM facts
  WHERE item = '{item}' AND val > 0 GROUP BY 1, 2"""


RELATIONS["float_facts"] = _fact("public_float")
RELATIONS["asset_facts"] = _fact("assets")
RELATIONS["sized"] = """
  SELECT p.date, p.entity, p.qty, p.px, p.n, p.quality_flag, p.adv_proxy, p.sector, f.val AS size_float,
         a.val AS size_assets
  FROM panel p ASOF LEFT JOIN float_facts f ON p.cik = f.cik AND p.date >= f.avail
  ASOF LEFT JOIN asset_facts a ON p.cik = a.cik AND p.date >= a.avail"""

RELATIONS["rets0"] = """
  SELECT *, round(prc / lag(prc) OVER (PARTITION BY entity ORDER BY date) - 1, 9) AS ret,
         round(prc / openprc - 1, 9) AS r_oc, lag(prc * shrout) OVER (PARTITION BY entity ORDER BY date) AS cap
  FROM (SELECT after AS date, entity, prc, openprc, qty AS vol, 100.0 + n AS shrout, bid, ask
        FROM monthly JOIN dim ON month = day WHERE after IS NOT NULL)"""
RELATIONS["mkt_"] = """
  SELECT date, round(sum(ret * cap) / nullif(sum(cap) FILTER (ret IS NOT NULL), 0), 9) AS mkt FROM rets0 GROUP BY date"""
RELATIONS["rets"] = """
  SELECT date, entity, r_oc, ret, prc, vol, CAST(shrout AS DOUBLE) AS shrout, mkt, bid, ask
  FROM rets0 LEFT JOIN mkt_ USING (date)"""
RELATIONS["vint0"] = """
  SELECT 'S' || l_suppkey AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(l_shipdate AS DATE) AS realtime_start, max(l_extendedprice) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""
RELATIONS["vint"] = """
  SELECT *, coalesce(lead(realtime_start) OVER (PARTITION BY series_id, date ORDER BY realtime_start),
                     DATE '9999-12-31') AS realtime_end FROM vint0"""
RELATIONS["rel"] = """
  SELECT series_id, date, min(realtime_start) AS release_date, arg_min(value, realtime_start) AS first_value,
         arg_max(value, realtime_start) AS latest_value, count(*) AS n_vintages,
         abs(arg_max(value, realtime_start) - arg_min(value, realtime_start)) > 1e-9 AS revised
  FROM vint GROUP BY 1, 2"""
RELATIONS["accepted_"] = """
  SELECT o_orderkey AS key, o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS BIGINT)) AS accepted,
         ((o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS BIGINT))) AT TIME ZONE 'UTC')
           AT TIME ZONE 'America/New_York' AS et
  FROM orders"""
RELATIONS["first_open"] = """
  SELECT a.key, a.accepted, a.et, d.is_session, d.after, d.on_or_after,
         CASE WHEN d.is_session AND hour(a.et) * 60 + minute(a.et) < 570 THEN d.day ELSE d.after END AS first_tradable
  FROM accepted_ a LEFT JOIN dim d ON d.day = CAST(a.et AS DATE)"""
RELATIONS["volumes"] = """
  SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS date,
         round(sum(CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0.0 END), 2) AS short_volume,
         round(sum(value), 2) AS total_volume
  FROM events GROUP BY 1, 2"""
