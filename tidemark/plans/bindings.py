
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_div
from tidemark.operators import docs
from tidemark.operators.calendar import date_dimension, next_session, trading_days
from tidemark.operators.features import build_features
from tidemark.operators.panel import build_panel
from tidemark.operators.pit import pit_view
from tidemark.operators.returns import forward_returns
from tidemark.operators.segments import segment_frame
from tidemark.operators.vintages import with_realtime_end
from tidemark.session import cut
from tidemark.sources.prices import market_return
from tidemark.sources.tables import read_table
from tidemark.specs import HORIZONS, AvailabilityRule, ControlWindows, FeatureSpec, PanelSpec, Split, ViewRoles

HOLIDAYS = ("01-01", "07-04", "12-25")
MONTH_RULE = AvailabilityRule("month", "next_trading_day_open")
ROLES = ViewRoles("entity", "month", ("qty", "px", "n"), ("thin",))
PANEL = PanelSpec(("1995-01-01", "1995-12-31"), "1996-01-01", "2001-12-31", "qty", 1000, 6, 3)
SPLIT = Split(("1996-01-01", "1998-06-30"), ("1998-09-01", "1999-12-31"), ("2000-03-01", "2001-06-30"))
# the frame has monthly sessions, so the windows are shorter than the daily defaults
WINDOWS = ControlWindows((3, 2), (12, 8), 2, (24, 12), (6, 3), (6, 3), (18, 12), (6, 3))
SPECS = (
    FeatureSpec("unit_price", "ratio", ("px", "qty")),
    FeatureSpec("qty_surprise", "surprise", ("qty",), 6),
    FeatureSpec("price_growth", "growth", ("unit_price",), 3),
    FeatureSpec("qty_load", "ratio", ("qty", "adv_proxy")),
    FeatureSpec("price_rel", "peer_relative", ("unit_price",), None, "sector"),
    FeatureSpec("qty_resid", "residualize", ("qty",), None, "adv_proxy"),
    FeatureSpec("n_rank", "rank", ("n",)),
)


class Data:
    """Bound relations of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def t(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, f"{self.dir}/{name}.parquet", columns or None)

    # ---------------------------------------------------------------- calendars
    @cached_property
    def sessions(self) -> DataFrame:
        return trading_days(self.t("orders", "o_orderdate"), "o_orderdate", HOLIDAYS, weekdays_only=True)

    @cached_property
    def cal(self) -> DataFrame:
        """The date dimension, built once: a row per day, which most queries join."""
        return cut(date_dimension(self.sessions))

    @cached_property
    def event_cal(self) -> DataFrame:
        return cut(date_dimension(trading_days(self.t("events", "ts"), "ts", HOLIDAYS, weekdays_only=True)))

    # ---------------------------------------------------------------- supplier months
    @cached_property
    def monthly(self) -> DataFrame:
        """Supplier months: flows, unit prices of the whole month and of its first half, price range."""
        li = self.t("lineitem", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
        q, p = F.col("l_quantity"), F.col("l_extendedprice")
        early = F.dayofmonth("l_shipdate") <= 15
        g = li.groupBy(F.col("l_suppkey").alias("cik"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(
            F.sum(q).alias("qty"), F.round(F.sum(p), 2).alias("px"), F.count(F.lit(1)).alias("n"),
            F.sum(F.when(early, q)).alias("_q1"), F.round(F.sum(F.when(early, p)), 2).alias("_p1"),
            F.min(p / q).alias("bid"), F.max(p / q).alias("ask"))
        return g.select(F.concat(F.lit("S"), F.col("cik").cast("string")).alias("entity"), "cik", "month", "qty", "px",
                        "n", (F.col("n") < 3).alias("thin"), safe_div(F.col("px"), F.col("qty")).alias("prc"),
                        safe_div(F.col("_p1"), F.col("_q1")).alias("openprc"), "bid", "ask")

    @cached_property
    def monthly_table(self) -> DataFrame:
        """The supplier months as a table: the universe, the panel, the returns and their market all read them."""
        return cut(self.monthly)

    @cached_property
    def view(self) -> DataFrame:
        return pit_view(self.monthly, ROLES, MONTH_RULE, self.cal)

    @cached_property
    def view_table(self) -> DataFrame:
        return pit_view(self.monthly_table, ROLES, MONTH_RULE, self.cal)

    @cached_property
    def symbols(self) -> DataFrame:
        """Suppliers with their region as sector; one region plays the unknown sector."""
        s = self.t("supplier").join(self.t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
            self.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        sector = F.when(F.col("r_name") == "MIDDLE EAST", "Unknown").otherwise(F.col("r_name"))
        return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity"),
                        F.col("s_suppkey").alias("cik"), sector.alias("sector"))

    @cached_property
    def facts(self) -> DataFrame:
        li = self.t("lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice")
        filed = F.to_date("l_shipdate")
        return li.select(F.col("l_suppkey").alias("cik"),
                         F.when(F.col("l_linenumber") % 2 == 1, "public_float").otherwise("assets").alias("item"),
                         F.date_sub(filed, (F.col("l_partkey") % 90).cast("int")).alias("end"), filed.alias("filed"),
                         F.col("l_extendedprice").alias("val"))

    @cached_property
    def panel(self) -> DataFrame:
        """Liquidity and sector only: at most 1,000 names on every date.  Built once and read many times, so it is
        materialised in the shared folder."""
        return cut(build_panel(self.view_table, PANEL, ("qty", "px", "n"), self.symbols, bounded=True))

    @cached_property
    def sized_panel(self) -> DataFrame:
        return build_panel(self.view_table, PANEL, ("qty", "px", "n"), self.symbols, self.facts, bounded=True)

    # ---------------------------------------------------------------- returns
    @cached_property
    def returns(self) -> DataFrame:
        """The returns frame as a table: forward returns and controls read it several times."""
        m = next_session(self.monthly_table, "month", self.cal, "date").where(F.col("date").isNotNull())
        w = Window.partitionBy("entity").orderBy("date")   # one row per month
        m = m.withColumns({
            "r_oc": safe_div(F.col("prc"), F.col("openprc")) - 1,
            "ret": safe_div(F.col("prc"), F.lag("prc").over(w)) - 1,
            "vol": F.col("qty"), "shrout": F.lit(100.0) + F.col("n")})
        m = m.withColumn("ret", F.round("ret", 9)).withColumn("r_oc", F.round("r_oc", 9))
        d = market_return(m, id_col="entity").withColumn("mkt", F.round("mkt", 9))
        return cut(d.select("date", "entity", "r_oc", "ret", "prc", "vol", "shrout", "mkt", "bid", "ask"))

    @cached_property
    def plain_returns(self) -> DataFrame:
        return self.returns.drop("bid", "ask")

    def features_of(self, *names: str) -> DataFrame:
        """Features whose last bits are rounded away, for the statistics that rank them."""
        f = build_features(self.panel, SPECS, names, bounded=True)
        return f.select("date", "entity", *[F.round(c, 9).alias(c) for c in names])

    def raw_segment(self, name: str, *features: str) -> DataFrame:
        return segment_frame(self.features_of(*features), self.panel.select("date", "entity", "sector"),
                             self.plain_returns, SPLIT, name, horizons=HORIZONS, windows=WINDOWS)

    def segment(self, name: str, *features: str) -> DataFrame:
        """One segment's frame.  Statistics read it several times, so it is materialised once, in the shared folder."""
        d = self.raw_segment(name, *features)
        # both engines rank these, so the last bits of sums are rounded away first
        fixed = [c for c in d.columns if c.startswith("fwd_")] + ["size", "reversal", "momentum", "beta", "dollar_adv",
                                                                  "vol20", "half_spread"]
        return cut(d.withColumns({c: F.round(c, 9) for c in fixed}))

    def discovery(self, *features: str) -> DataFrame:
        return self.segment("discovery", *features)

    @cached_property
    def forward(self) -> DataFrame:
        return forward_returns(self.plain_returns, HORIZONS)

    # ---------------------------------------------------------------- vintages
    @cached_property
    def prices_published(self) -> DataFrame:
        """Series = supplier, observation = order month, vintage = ship date, value = a price published then."""
        li = self.t("lineitem", "l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        o = self.t("orders", "o_orderkey", "o_orderdate")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("series_id"),
            F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"),
            F.to_date("l_shipdate").alias("realtime_start"), F.col("l_extendedprice").alias("value"))

    @cached_property
    def vintages(self) -> DataFrame:
        """The largest price published for an observation on a day is its value from then on."""
        v = self.prices_published.groupBy("series_id", "date", "realtime_start").agg(F.max("value").alias("value"))
        return with_realtime_end(v)

    @cached_property
    def vintage_table(self) -> DataFrame:
        """The vintages as a table, for measurements that read them several times."""
        return cut(self.vintages)

    # ---------------------------------------------------------------- filings
    @cached_property
    def trans(self) -> DataFrame:
        li = self.t("lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
                    "l_shipdate")
        return li.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("code"),
                         F.when(F.col("l_linestatus") == "F", "A").otherwise("D").alias("acquired"),
                         F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("price"),
                         F.to_date("l_shipdate").alias("trans_date"))

    @cached_property
    def owners(self) -> DataFrame:
        o, c = self.t("orders", "o_orderkey", "o_custkey"), self.t("customer", "c_custkey", "c_mktsegment")
        return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("key"),
                                                            F.col("c_mktsegment").alias("relationship"))

    @cached_property
    def filings(self) -> DataFrame:
        form = F.when(F.col("o_orderstatus") == "F", "4").when(F.col("o_orderstatus") == "O", "4/A").otherwise("3")
        return self.t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("issuer"),
                                       F.to_date("o_orderdate").alias("filing_date"), form.alias("form"))

    @cached_property
    def acceptance(self) -> DataFrame:
        minutes = (F.col("o_orderkey") * 37) % 1440
        t = F.timestamp_micros(F.unix_micros("o_orderdate") + minutes * 60000000)
        return self.t("orders").select(F.col("o_orderkey").alias("key"), t.alias("accepted"))

    # ---------------------------------------------------------------- daily flows per user
    @cached_property
    def volumes(self) -> DataFrame:
        """symbol = user, date, short volume = value of clicks and views, total = value of all events, one row per
        symbol and day."""
        e = self.t("events", "ts", "user_id", "event_type", "value")
        some = F.col("event_type").isin("click", "view")
        g = e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
                      F.to_date("ts").alias("date")).agg(
            F.round(F.sum(F.when(some, F.col("value")).otherwise(0.0)), 2).alias("short_volume"),
            F.round(F.sum("value"), 2).alias("total_volume"))
        return g

    # ---------------------------------------------------------------- documents
    @cached_property
    def passages(self) -> DataFrame:
        return docs.passages(self.t("documents", "doc_id", "text"))

    @cached_property
    def doc_queries(self) -> DataFrame:
        """Each benchmark text."""
        return self.t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
