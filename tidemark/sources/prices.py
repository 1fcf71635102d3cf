"""Daily stock files in two layouts, market return, checks (inventory A13-A17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, pearson, pearson_sums, require_columns, safe_div, share
from tidemark.operators.order import top_rows

# Column names of the two layouts.
LEGACY = {"PERMNO": "permno", "date": "date", "DATE": "date", "TICKER": "ticker", "SHRCLS": "shrcls", "SHRCD": "shrcd",
          "EXCHCD": "exchcd", "PRC": "prc", "OPENPRC": "openprc", "RET": "ret", "VOL": "vol", "SHROUT": "shrout",
          "BID": "bid", "ASK": "ask", "BIDLO": "low", "ASKHI": "high"}
CURRENT = {"PERMNO": "permno", "DlyCalDt": "date", "Ticker": "ticker", "ShareClass": "shrcls",
           "ShareType": "sharetype", "SecurityType": "securitytype", "PrimaryExch": "exchcd", "DlyPrc": "prc",
           "DlyOpen": "openprc", "DlyRet": "ret", "DlyVol": "vol", "ShrOut": "shrout", "DlyBid": "bid",
           "DlyAsk": "ask", "DlyHigh": "high", "DlyLow": "low"}
NUMBERS = ("prc", "openprc", "ret", "vol", "shrout", "bid", "ask", "high", "low")


def layout(columns) -> str:
    """Which file a header belongs to: daily_current, daily_legacy, names, delist, index, factors."""
    c, upper = set(columns), {x.upper() for x in columns}
    if {"PERMNO", "DlyCalDt"} <= c:
        return "daily_current"
    if {"PERMNO", "PRC", "RET"} <= c and c & {"date", "DATE"}:
        return "daily_legacy"
    for name, need in (("names", {"NAMEDT", "NAMEENDDT"}), ("delist", {"DLSTDT", "DLRET"}), ("index", {"VWRETD"}),
                       ("factors", {"MKTRF", "RF"})):
        if need <= upper:
            return name
    raise ValueError(f"no known layout has the columns {sorted(c)}")


def read_price_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with every column as text: codes such as C in a return are handled by load_daily."""
    return spark.read.csv(path, header=True, inferSchema=False)


def _number(c: Column) -> Column:
    return finite(c.cast("string").try_cast("double"))


def parse_date(c: Column) -> Column:
    """yyyyMMdd or ISO."""
    s = c.cast("string")
    return F.coalesce(F.to_date(F.try_to_timestamp(s, F.lit("yyyyMMdd"))), s.try_cast("date"))


def symbol_key(ticker: Column, shrcls: Column | None) -> Column:
    """TICKER, or TICKER/CLASS."""
    t = F.upper(F.trim(ticker))
    if shrcls is None:
        return t
    cls = F.coalesce(F.upper(F.trim(shrcls)), F.lit(""))
    return F.when(cls == "", t).otherwise(F.concat(t, F.lit("/"), cls))


def load_daily(df: DataFrame, delist: DataFrame | None = None) -> DataFrame:
    """A13/A14. The daily file in one layout: numbers coerced, price positive, open-to-close return, symbol key, one row
    per (permno, date); legacy delisting returns are compounded into the return."""
    kind = layout(df.columns)
    if not kind.startswith("daily"):
        raise ValueError(f"not a daily stock file but {kind}")
    names = {k: v for k, v in (CURRENT if kind == "daily_current" else LEGACY).items() if k in df.columns}
    d = df.select(*[F.col(k).alias(v) for k, v in names.items()])
    present = set(d.columns)
    always = ("prc", "openprc", "ret", "vol", "shrout")
    d = d.withColumns({c: _number(F.col(c)) if c in present else F.lit(None).cast("double")
                       for c in NUMBERS if c in present or c in always})
    d = d.withColumns({"date": parse_date(F.col("date")), "permno": F.col("permno").cast("string").try_cast("long")})
    if delist is not None and kind == "daily_legacy":
        up = delist.select(*[F.col(c).alias(c.upper()) for c in delist.columns])
        dl = up.select(F.col("PERMNO").cast("string").try_cast("long").alias("permno"),
                       parse_date(F.col("DLSTDT")).alias("date"), _number(F.col("DLRET")).alias("dlret"))
        d = d.join(dl.where(F.col("dlret").isNotNull()), ["permno", "date"], "left")
        both = (1 + F.col("ret")) * (1 + F.col("dlret")) - 1
        d = d.withColumn("ret", F.when(F.col("dlret").isNull(), F.col("ret")).otherwise(
            F.coalesce(both, "dlret"))).drop("dlret")
    d = d.withColumn("prc", F.abs("prc")).withColumn(
        "r_oc", safe_div(F.col("prc"), F.when(F.col("openprc") > 0, F.col("openprc"))) - 1)
    if "ticker" in present:
        cls = F.col("shrcls") if "shrcls" in present else None
        d = d.withColumn("key", symbol_key(F.col("ticker"), cls)).withColumn("ticker", F.upper(F.trim("ticker")))
        d = d.withColumn("shrcls", F.upper(F.trim("shrcls")) if cls is not None else F.lit(None).cast("string"))
    rest = [c for c in d.columns if c not in ("permno", "date")]
    return top_rows(d, ["permno", "date"], [F.asc_nulls_last(c) for c in rest], 1)


def load_names(df: DataFrame) -> DataFrame:
    """Dated name ranges: id, key, start, end."""
    up = df.select(*[F.col(c).alias(c.upper()) for c in df.columns])
    cls = F.col("SHRCLS") if "SHRCLS" in up.columns else None
    return up.select(F.col("PERMNO").cast("string").try_cast("long").alias("id"),
                     symbol_key(F.col("TICKER"), cls).alias("key"), parse_date(F.col("NAMEDT")).alias("start"),
                     parse_date(F.col("NAMEENDDT")).alias("end")).where(F.col("key").isNotNull()).distinct()


def load_index(df: DataFrame) -> DataFrame:
    """(date, mkt) of an index file."""
    low = df.select(*[F.col(c).alias(c.lower()) for c in df.columns])
    return low.select(parse_date(F.col("date")).alias("date"), _number(F.col("vwretd")).alias("mkt"))


def market_return(df: DataFrame, index: DataFrame | None = None, id_col: str = "permno") -> DataFrame:
    """A15. Adds mkt: the given index, else the return weighted by the previous session's capitalisation, by date.

    One row per (id, date), so the calendar bounds the window."""
    if index is None:
        require_columns(df, id_col, "date", "ret", "prc", "shrout")
        w = Window.partitionBy(id_col).orderBy("date")
        cap = F.lag(F.col("prc") * F.col("shrout")).over(w)
        c = df.select("date", "ret", cap.alias("_cap"))
        index = c.groupBy("date").agg(
            safe_div(F.sum(F.col("ret") * F.col("_cap")),
                     F.sum(F.when(F.col("ret").isNotNull(), F.col("_cap")))).alias("mkt"))
    return df.join(index.select("date", "mkt"), "date", "left")


def ingest_summary(df: DataFrame, id_col: str = "permno") -> DataFrame:
    """A16. Rows, entities, date range and missing shares."""
    ids = df.select(id_col).distinct().agg(F.count(id_col).alias("entities")).withColumn("_one", F.lit(0))
    s = df.agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
               share(F.col("r_oc").isNull()).alias("share_missing_open"),
               share(F.col("ret").isNull()).alias("share_missing_ret")).withColumn("_one", F.lit(0))
    return s.join(ids, "_one").drop("_one")


def crosscheck_returns(a: DataFrame, b: DataFrame, key: str = "key", least_days: int = 20) -> DataFrame:
    """A17. Per symbol: how well file a's returns agree with adjusted closes and open/close prices of source b.

    a: key, date, ret, r_oc; b: key, date, adj_close, open, close (one row per key and date).
    """
    w = Window.partitionBy(key).orderBy("date")
    other = b.select(key, "date", (safe_div(F.col("adj_close"), F.lag("adj_close").over(w)) - 1).alias("ret_b"),
                     (safe_div(F.col("close"), F.col("open")) - 1).alias("oc_b"))
    m = a.select(key, "date", "ret", "r_oc").join(other, [key, "date"])
    m = m.where(F.col("ret").isNotNull() & F.col("r_oc").isNotNull() & F.col("ret_b").isNotNull() &
                F.col("oc_b").isNotNull())
    g = m.groupBy(key).agg(F.count(F.lit(1)).alias("days"), *pearson_sums(F.col("ret"), F.col("ret_b"), "r_"),
                           *pearson_sums(F.col("r_oc"), F.col("oc_b"), "o_"),
                           F.max(F.abs(F.col("ret") - F.col("ret_b"))).alias("max_abs_diff_ret"))
    return g.where(F.col("days") > least_days).select(key, "days", pearson("r_").alias("corr_ret"),
                                                      pearson("o_").alias("corr_open_to_close"), "max_abs_diff_ret")
