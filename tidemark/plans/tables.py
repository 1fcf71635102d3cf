"""Queries of inventory A: tables, readers, prices, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.features import build_features
from tidemark.plans.bindings import SPECS, Data
from tidemark.plans.registry import d, n, query, r
from tidemark.session import shared_folder
from tidemark.sources import prices, readers, tables
from tidemark.specs import definition_hash


@query("a1_read_table", f"""SELECT l_returnflag, l_linestatus, {n('count(*)', 'n')}, {r('sum(l_quantity)', 'qty')}
FROM lineitem GROUP BY 1, 2""")
def _(x: Data):
    li = x.t("lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


@query("a2_list_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", {n('count(*)', 'n_rows')}, (SELECT {n('count(*)', 'c')} FROM (DESCRIBE {t})) "
    f"AS n_columns FROM {t}" for t in TABLES))
def _(x: Data):
    return tables.list_tables({t: x.t(t) for t in TABLES})


@query("a3_table_preview", """SELECT substr(CAST(c_custkey AS VARCHAR), 1, 40) AS c_custkey, substr(c_name, 1, 40)
AS c_name, substr(CAST(c_nationkey AS VARCHAR), 1, 40) AS c_nationkey, substr(CAST(c_acctbal AS VARCHAR), 1, 40)
AS c_acctbal, substr(c_mktsegment, 1, 40) AS c_mktsegment
FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)""")
def _(x: Data):
    return tables.table_preview(x.t("customer"), 5, ["c_custkey"])


@query("a4_spread_sample", f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i,
count(*) OVER () AS c FROM events)
SELECT {n('event_id', 'event_id')}, {n('user_id', 'user_id')}, event_type FROM p
WHERE i IN (floor((c - 1) * 0.1), floor((c - 1) * 0.3), floor((c - 1) * 0.5), floor((c - 1) * 0.7),
            floor((c - 1) * 0.9))""")
def _(x: Data):
    return tables.spread_sample(x.t("events", "ts", "event_id", "user_id", "event_type"), "ts", ["event_id"]).select(
        "event_id", "user_id", "event_type")


def _daily_lines(x: Data):
    """One text file per day out of the daily flows; files of odd days carry a wrong record count."""
    v = x.volumes.select(F.concat(F.lit("flows"), F.date_format("date", "yyyyMMdd"), F.lit(".txt")).alias("file_name"),
                         "date", "symbol", (F.col("short_volume") * 100).cast("long").alias("a"),
                         (F.col("total_volume") * 100).cast("long").alias("b"))
    rows = v.select("file_name", F.concat_ws("|", F.date_format("date", "yyyyMMdd"), "symbol", F.col("a").cast("string"),
                                             F.col("b").cast("string")).alias("value"))
    files = v.groupBy("file_name", "date").agg(F.count(F.lit(1)).alias("c"))
    head = files.select("file_name", F.lit("Date|Symbol|ShortVolume|TotalVolume").alias("value"))
    tail = files.select("file_name", (F.col("c") + F.dayofmonth("date") % 2).cast("string").alias("value"))
    return readers.parse_trailer_lines(rows.unionByName(head).unionByName(tail),
                                       ["Date", "Symbol", "ShortVolume", "TotalVolume"],
                                       integers=["ShortVolume", "TotalVolume"], dates=["Date"])


@query("a5_trailer_rows", f"""SELECT {d('date', 'Date')}, {n('count(*)', 'n')},
{n('sum(CAST(trunc(short_volume * 100) AS BIGINT))', 'short')}, {n('sum(CAST(trunc(total_volume * 100) AS BIGINT))', 'total')}
FROM volumes GROUP BY date""")
def _(x: Data):
    rows, _log = _daily_lines(x)
    return rows.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("ShortVolume").alias("short"),
                                    F.sum("TotalVolume").alias("total"))


@query("a5_trailer_log", f"""SELECT 'flows' || strftime(date, '%Y%m%d') || '.txt' AS file_name, {d('date', 'file_date')},
{n('count(*)', 'n_records')}, {n('count(*) + day(date) % 2', 'trailer_count')}, day(date) % 2 = 0 AS trailer_ok
FROM volumes GROUP BY date""")
def _(x: Data):
    return _daily_lines(x)[1]


@query("a6_read_tsv", f"""SELECT {n('o_orderkey', 'key')}, CASE WHEN o_orderkey % 7 <> 0 THEN
strftime(o_orderdate, '%Y-%m-%d') END AS filed, CASE WHEN o_orderkey % 5 <> 0 THEN {r('o_totalprice', 'x')[:-5]} END
AS amount FROM orders""")
def _(x: Data):
    o = x.t("orders")
    text = o.select(F.col("o_orderkey").alias("key"),
                    F.when(F.col("o_orderkey") % 7 == 0, "31-FOO-1996").otherwise(
                        F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))).alias("filed"),
                    F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(
                        F.col("o_totalprice").cast("string")).alias("amount"))
    path = f"{shared_folder(x.spark)}/tsv-{uuid.uuid4().hex}"
    text.write.csv(path, sep="\t", header=True)
    return readers.read_tsv(x.spark, path, ["filed"], ["amount"]).withColumn("key", F.col("key").cast("long"))


@query("a7_read_vintages", f"""SELECT series_id, {d('date', 'date')}, {d('realtime_start', 'realtime_start')},
strftime(realtime_end, '%Y-%m-%d') AS realtime_end, CASE WHEN day(realtime_start) <> 13 THEN {r('value', 'v')[:-5]} END
AS value FROM vint""")
def _(x: Data):
    v = x.vintages
    value = F.when(F.dayofmonth("realtime_start") == 13, ".").otherwise(F.col("value").cast("string"))
    o = v.select("series_id", F.struct(*[F.col(c).cast("string").alias(c) for c in (
        "date", "realtime_start", "realtime_end")], value.alias("value")).alias("o"))
    return readers.flatten_vintages(o)


@query("a8_filing_index", f"""SELECT CAST(o_orderkey AS VARCHAR) || s AS accession, CAST(o_custkey AS VARCHAR) AS cik,
CASE s WHEN '-a' THEN '4' ELSE '4/A' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS "filingDate"
FROM orders, (VALUES ('-a'), ('-b')) v(s) WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""")
def _(x: Data):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.col("o_orderkey").cast("string")
    block = F.struct(F.array(F.concat(key, F.lit("-a")), F.concat(key, F.lit("-b"))).alias("accessionNumber"),
                     F.array(day, day).alias("filingDate"), F.array(day, day).alias("acceptanceDateTime"),
                     F.array(F.lit("4"), F.lit("4/A")).alias("form"))
    o = x.t("orders").select(F.col("o_custkey").cast("string").alias("cik"), block.alias("recent"))
    return readers.flatten_filing_index(o, "1997-01-01", "1997-12-31").drop("acceptanceDateTime")


def _passes(x: Data):
    li = x.t("lineitem", "l_orderkey", "l_suppkey", "l_returnflag").withColumnsRenamed(
        {"l_orderkey": "key", "l_suppkey": "cik"})
    p1 = li.where(F.col("l_returnflag") == "R").select("key", "cik")
    p2 = li.where(F.col("l_returnflag") == "A").select("key", "cik")
    return readers.two_pass_match(x.t("orders", "o_orderkey").withColumnRenamed("o_orderkey", "key"), p1, p2, "key",
                                  ["cik"])


_TWO_PASS = """WITH p1 AS (SELECT l_orderkey AS key, min(l_suppkey) AS cik FROM lineitem WHERE l_returnflag = 'R'
  AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1),
p2 AS (SELECT l_orderkey AS key, min(l_suppkey) AS cik FROM lineitem WHERE l_returnflag = 'A'
  AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey NOT IN (SELECT key FROM p1) GROUP BY 1),
m AS (SELECT key, cik, 'issuer' AS scanned_via FROM p1 UNION ALL SELECT key, cik, 'owner' FROM p2)"""


@query("a9_two_pass_match", f"{_TWO_PASS} SELECT {n('key', 'key')}, {n('cik', 'cik')}, scanned_via FROM m")
def _(x: Data):
    return _passes(x)[0]


@query("a9_match_rate", f"""{_TWO_PASS} SELECT {n('count(*)', 'wanted')}, {n('count(m.key)', 'matched')},
{n('count(*) - count(m.key)', 'unmatched')}, {r('count(m.key) / count(*)', 'match_rate')}
FROM (SELECT DISTINCT o_orderkey AS key FROM orders) o LEFT JOIN m USING (key)""")
def _(x: Data):
    return _passes(x)[1]


@query("a10_flatten_facts", f"""SELECT {n('cik', 'cik')}, item, {d('e', 'end')}, {d('f', 'filed')}, '10-K' AS form,
{r('min(v)', 'val')} FROM (
  SELECT l_suppkey AS cik, 'public_float' AS item, CAST(l_shipdate AS DATE) AS e, CAST(l_shipdate AS DATE) + 30 AS f,
         l_extendedprice AS v FROM lineitem
  UNION ALL SELECT l_suppkey, 'assets', CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + 45, l_quantity FROM lineitem
  WHERE l_linenumber <> 3) GROUP BY cik, item, e, f""")
def _(x: Data):
    li = x.t("lineitem", "l_suppkey", "l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity")
    def fact(lag, v):
        return F.struct(F.to_date("l_shipdate").cast("string").alias("end"),
                        F.date_add(F.to_date("l_shipdate"), lag).cast("string").alias("filed"),
                        F.lit("10-K").alias("form"), v.alias("val"))
    def tag(ns, name, f):
        return F.struct(F.struct(F.struct(F.array(f).alias("USD")).alias("units")).alias(name)).alias(ns)
    assets = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    text = F.to_json(F.struct(tag("dei", "EntityPublicFloat", fact(30, F.col("l_extendedprice"))),
                              tag("us-gaap", "Assets", fact(45, assets))))
    return readers.flatten_facts(li.select(F.col("l_suppkey").alias("cik"), text.alias("facts")))


def _sic(partkey: str) -> str:
    spans = " ".join("WHEN " + " OR ".join(f"code BETWEEN {lo} AND {hi}" for lo, hi in s) + f" THEN '{label}'"
                     for label, s in readers.SECTOR_RANGES)
    return f"CASE WHEN code IS NULL THEN 'Unknown' {spans} ELSE 'Other' END"


@query("a11_range_label", f"""SELECT {_sic('')} AS sector, {n('count(*)', 'n')} FROM (
SELECT CASE WHEN p_size <> 1 THEN 100 + p_partkey * 37 % 9000 END AS code FROM part) GROUP BY 1""")
def _(x: Data):
    code = F.when(F.col("p_size") == 1, "n/a").otherwise((100 + F.col("p_partkey") * 37 % 9000).cast("string"))
    return x.t("part").groupBy(readers.range_label(code).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@query("a12_map_symbols", f"""WITH s AS (SELECT DISTINCT replace(p_brand, '#', '/') AS symbol FROM part),
t AS (SELECT 'Brand-' || n_nationkey AS sec_ticker, n_nationkey AS cik, n_name AS name FROM nation)
SELECT replace(symbol, '/', '-') AS sec_ticker, symbol, {n('t.cik', 'cik')}, name, code AS sic,
{_sic('')} AS sector
FROM s JOIN t ON replace(symbol, '/', '-') = sec_ticker
LEFT JOIN (SELECT n_nationkey AS cik, 1000 + n_nationkey * 311 AS code FROM nation WHERE n_regionkey <> 2) a
ON t.cik = a.cik""")
def _(x: Data):
    symbols = x.t("part", "p_brand").select(F.replace("p_brand", F.lit("#"), F.lit("/")).alias("symbol"))
    nat = x.t("nation")
    tick = nat.select(F.concat(F.lit("Brand-"), F.col("n_nationkey").cast("string")).alias("sec_ticker"),
                      F.col("n_nationkey").alias("cik"), F.col("n_name").alias("name"))
    attrs = nat.where(F.col("n_regionkey") != 2).select(F.col("n_nationkey").alias("cik"),
                                                       (1000 + F.col("n_nationkey") * 311).alias("sic"))
    return readers.map_symbols(symbols, tick, attrs)


def _legacy(x: Data):
    """Line items as a legacy daily file: negative prices are midpoints, some returns are codes."""
    li = x.t("lineitem", "l_suppkey", "l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
             "l_discount", "l_returnflag", "l_linestatus")
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1.0).otherwise(1.0)
    return li.select(
        F.col("l_suppkey").cast("string").alias("PERMNO"), F.date_format("l_shipdate", "yyyyMMdd").alias("date"),
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("TICKER"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("SHRCLS"),
        (F.col("l_extendedprice") * sign).cast("string").alias("PRC"),
        F.when(F.col("l_quantity") > 5, F.col("l_extendedprice") - F.col("l_quantity")).otherwise(0.0).cast("string")
        .alias("OPENPRC"),
        F.when(F.col("l_linestatus") == "O", F.col("l_discount").cast("string")).otherwise("C").alias("RET"),
        F.col("l_quantity").cast("string").alias("VOL"), F.col("l_partkey").cast("string").alias("SHROUT"))


def _delist(x: Data):
    """A last return of each supplier that shipped an order in its final month."""
    li = x.t("lineitem", "l_suppkey", "l_shipdate", "l_discount")
    last = li.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("t"))
    return last.select(F.col("l_suppkey").cast("string").alias("permno"), F.date_format("t", "yyyyMMdd").alias("dlstdt"),
                       F.lit("-0.5").alias("dlret"))


# the same dedupe order as the loader: every other column, nulls last
RELATION_DAILY = """d0 AS (SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, 'T' || l_suppkey AS ticker,
  nullif(l_returnflag, 'N') AS shrcls, l_extendedprice AS prc,
  CASE WHEN l_quantity > 5 THEN l_extendedprice - l_quantity ELSE 0 END AS openprc,
  CASE WHEN l_linestatus = 'O' THEN l_discount END AS ret0, l_quantity AS vol, CAST(l_partkey AS DOUBLE) AS shrout
  FROM lineitem),
dl AS (SELECT l_suppkey AS permno, max(CAST(l_shipdate AS DATE)) AS date FROM lineitem GROUP BY 1),
d1 AS (SELECT d0.*, CASE WHEN dl.permno IS NULL THEN ret0 WHEN ret0 IS NULL THEN -0.5 ELSE (1 + ret0) * 0.5 - 1 END
  AS ret, prc / nullif(CASE WHEN openprc > 0 THEN openprc END, 0) - 1 AS r_oc,
  CASE WHEN shrcls IS NULL THEN ticker ELSE ticker || '/' || shrcls END AS key
  FROM d0 LEFT JOIN dl ON d0.permno = dl.permno AND d0.date = dl.date),
daily AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY permno, date
  ORDER BY ticker NULLS LAST, shrcls NULLS LAST, prc NULLS LAST, openprc NULLS LAST, ret NULLS LAST, vol NULLS LAST,
  shrout NULLS LAST) = 1)"""


@query("a13_load_daily", f"""WITH {RELATION_DAILY}
SELECT {n('permno', 'permno')}, {d('date', 'date')}, ticker, shrcls, key, {r('prc', 'prc')}, {r('openprc', 'openprc')},
{r('ret', 'ret')}, {r('vol', 'vol')}, {r('shrout', 'shrout')}, {r('r_oc', 'r_oc')} FROM daily""")
def _(x: Data):
    return prices.load_daily(_legacy(x), _delist(x))


@query("a14_delisting", f"""WITH {RELATION_DAILY}
SELECT {n('daily.permno', 'permno')}, {d('daily.date', 'date')}, {r('ret', 'ret')} FROM daily JOIN dl
ON daily.permno = dl.permno AND daily.date = dl.date""")
def _(x: Data):
    d_ = prices.load_daily(_legacy(x), _delist(x))
    last = x.t("lineitem", "l_suppkey", "l_shipdate").groupBy(F.col("l_suppkey").alias("permno")).agg(
        F.to_date(F.max("l_shipdate")).alias("date"))
    return d_.join(last, ["permno", "date"], "left_semi").select("permno", "date", "ret")


@query("a15_market_return", f"SELECT {d('date', 'date')}, {r('max(mkt)', 'mkt', 9)} FROM rets GROUP BY date", digits=9)
def _(x: Data):
    return x.returns.groupBy("date").agg(F.max("mkt").alias("mkt"))


@query("a16_ingest_summary", f"""WITH {RELATION_DAILY}
SELECT {n('count(*)', 'rows')}, {n('count(DISTINCT permno)', 'entities')}, {d('min(date)', 'first_date')},
{d('max(date)', 'last_date')}, {r('avg((r_oc IS NULL)::INT)', 'share_missing_open')},
{r('avg((ret IS NULL)::INT)', 'share_missing_ret')} FROM daily""")
def _(x: Data):
    return prices.ingest_summary(prices.load_daily(_legacy(x), _delist(x)))


@query("a17_crosscheck_returns", f"""WITH b AS (SELECT entity, date,
  round(prc * (1 + 0.001 * (vol % 3)), 6) / lag(round(prc * (1 + 0.001 * (vol % 3)), 6)) OVER (PARTITION BY entity
    ORDER BY date) - 1 AS ret_b, prc / openprc - 1 AS oc_b
  FROM rets0),
m AS (SELECT a.entity, a.ret, a.r_oc, b.ret_b, b.oc_b FROM rets a JOIN b USING (entity, date)
  WHERE a.ret IS NOT NULL AND a.r_oc IS NOT NULL AND ret_b IS NOT NULL AND oc_b IS NOT NULL)
SELECT entity, {n('count(*)', 'days')}, {r('corr(ret, ret_b)', 'corr_ret')}, {r('corr(r_oc, oc_b)', 'corr_open_to_close')},
{r('max(abs(ret - ret_b))', 'max_abs_diff_ret')} FROM m GROUP BY entity HAVING count(*) > 20""")
def _(x: Data):
    a = x.returns
    close = F.round(F.col("prc") * (1 + F.lit(0.001) * (F.col("vol") % 3)), 6)
    b = a.select("entity", "date", close.alias("adj_close"), (F.col("prc") / (1 + F.col("r_oc"))).alias("open"),
                 F.col("prc").alias("close"))
    return prices.crosscheck_returns(a, b, "entity")


_CELLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("a18_manifest", f"""SELECT {n('count(*)', 'rows')}, {n('count(*)', 'told')}, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(_CELLS)},
  CAST(round(o_totalprice * 100) AS BIGINT), CAST(epoch(o_orderdate) AS BIGINT))), 1, 15) AS BIGINT)) AS VARCHAR) AS digest, TRUE AS unchanged FROM orders""")
def _(x: Data):
    o, path = x.t("orders"), f"{shared_folder(x.spark)}/published-{uuid.uuid4().hex}"
    first = tables.publish(o, path, "orders", ["orders"], "check").first()
    again = tables.publish(o.limit(1), path, "orders", ["orders"], "check").first()   # the key has its commit
    held = tables.read_published(x.spark, path, "orders")
    cells = [*_CELLS, F.round(F.col("o_totalprice") * 100).cast("long"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))]
    return held.agg(F.count(F.lit(1)).alias("rows"), F.lit(first["rows"]).alias("told"), tables.text_digest(*cells).alias("digest"),
                    F.lit(first == again).alias("unchanged"))


_FROZEN = ("unit_price", "qty_load")


@query("a19_frozen_features", f"""SELECT '{definition_hash([*SPECS, *_FROZEN])}' AS definition, {d('date', 'date')}, entity,
{r('px / nullif(qty, 0)', 'unit_price')}, {r('qty / nullif(adv_proxy, 0)', 'qty_load')} FROM panel""")
def _(x: Data):
    path = f"{shared_folder(x.spark)}/frozen-{uuid.uuid4().hex}"
    h, _ = tables.freeze_features(x.panel, SPECS, _FROZEN, path, bounded=True)
    return tables.read_published(x.spark, path, h).select(F.lit(h).alias("definition"), "*")
