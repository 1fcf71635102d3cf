"""Does a finding survive trading: legs, spreads, turnover, impact and capacity (inventory K).

The portfolio is equal weight, long the quantile the sign favours and short the opposite one, rebalanced every h
sessions.  All functions take ``keys``, so several findings and segments are one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_div, safe_sqrt
from tidemark.operators.order import positions, quantiles, with_group_quantile, with_rank
from tidemark.operators.predict import finding_ics
from tidemark.session import cut
from tidemark.specs import Finding

# Half-spread bounds, sessions a year, and the capacity range in dollars.
MIN_HALF, MAX_HALF = 1e-4, 2e-2
PERIODS_PER_YEAR = 252
MIN_CAPITAL, MAX_CAPITAL = 1e3, 1e11
MIN_PERIODS = 10


def rebalance_dates(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """K1. (keys, date) of every h-th distinct date; ``h`` is a column."""
    dates = df.select(*keys, "date", "h").distinct()
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")   # one row per date
    return dates.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % F.col("h") == 0).select(*keys, "date")


def legs(df: DataFrame, keys: Sequence[str] = (), n: int = 5, bounded: bool = False) -> DataFrame:
    """K1. Rows of the long (1) and short (-1) leg on rebalance dates.  df: keys, date, entity, sig, sign, h, ...; ties
    are split in entity order."""
    d = df.join(rebalance_dates(df, keys), [*keys, "date"], "left_semi").where(F.col("sig").isNotNull())
    d = positions(d, [*keys, "date"], ["sig", "entity"], "_p", bounded=bounded)
    q = F.greatest(F.least(F.ceil((F.col("_p") + 1) / F.col("group_n") * n), F.lit(n)), F.lit(1))
    top = F.when(F.col("sign") > 0, n).otherwise(1)
    leg = F.when(q == top, 1).when(q == n + 1 - top, -1)
    return d.withColumn("leg", leg).where(F.col("leg").isNotNull()).drop("_p", "group_n")


def fill_half_spread(df: DataFrame, keys: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """K2. Adds hs: the half-spread, else the same-date liquidity tercile's median, else the overall one; clipped."""
    by = [*keys, "date"]
    d = with_rank(df, by, "dollar_adv", "_pct", bounded=bounded)
    d = d.withColumn("_terc", F.coalesce(F.floor(F.least(F.col("_pct") * 3, F.lit(2.999))), F.lit(1)))
    d = with_group_quantile(d, [*by, "_terc"], "half_spread", bounded=bounded, _fill=0.5)
    ks = list(keys) or ["_one"]
    d = d if keys else d.withColumn("_one", F.lit(0))
    d = d.join(quantiles(d, ks, "half_spread", {"_all_med": .5}).drop("n"), ks, "left")
    hs = F.coalesce("half_spread", "_fill", "_all_med")
    d = d.withColumn("hs", F.when(hs.isNotNull(), F.greatest(F.least(hs, F.lit(MAX_HALF)), F.lit(MIN_HALF))))
    return d.select(*df.columns, "hs")


def _leg_rows(df: DataFrame, keys: Sequence[str], n: int, bounded: bool) -> DataFrame:
    """The held rows with their spread and period.  Every statistic below reads them, so they are materialised."""
    d = cut(legs(df, keys, n, bounded).where(F.col("fwd").isNotNull()))
    w = Window.partitionBy(*keys).orderBy("date")
    order = d.select(*keys, "date").distinct().withColumn("period", F.row_number().over(w))   # one row per date
    return cut(fill_half_spread(d, keys, bounded).join(order, [*keys, "date"]))


def period_returns(df: DataFrame, keys: Sequence[str], n: int = 5, bounded: bool = False) -> DataFrame:
    """K3-K5. Per period: gross return, round-trip and changes-only cost, and the long leg's share of new names."""
    return _periods(_leg_rows(df, keys, n, bounded), keys)


def _periods(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = [*keys, "period"]
    held = rows.select(*keys, (F.col("period") + 1).alias("period"), "leg", "entity").withColumn("_held", F.lit(True))
    m = rows.join(held, [*per, "leg", "entity"], "left")   # equality on every column: no set is built
    entered = F.col("_held").isNull()
    g = m.groupBy(*per, "date", "leg").agg(
        F.avg("fwd").alias("ret"), F.avg("hs").alias("hs"), F.count(F.lit(1)).alias("names"),
        F.sum(F.when(entered, 1).otherwise(0)).alias("new"), F.sum(F.when(entered, F.col("hs"))).alias("new_hs"))
    def leg(c, k):
        return F.max(F.when(F.col("leg") == k, F.col(c)))
    change = 2 * safe_div(F.coalesce("new_hs", F.lit(0.0)), F.col("names"))
    p = g.withColumn("_ch", change).groupBy(*per, "date").agg(
        (leg("ret", 1) - leg("ret", -1)).alias("gross"), (2 * F.sum("hs")).alias("cost_round_trip"),
        F.sum("_ch").alias("cost_changes_only"),
        F.when(F.col("period") > 1, F.coalesce(safe_div(leg("new", 1), leg("names", 1)), F.lit(0.0))).alias("turnover"))
    return p


def portfolio(df: DataFrame, keys: Sequence[str] = (), n: int = 5, bounded: bool = False) -> DataFrame:
    """K6/K7. One row per key: gross and net statistics, break-even half-spread, turnover and capacity.

    df: keys, date, entity, sig, sign, h, fwd, half_spread, dollar_adv, vol20, spread_quoted.  Capacity is the capital
    per leg at which square-root impact eats the net edge, in closed form.  A key of fewer than MIN_PERIODS rebalance dates
    keeps its row and its number of periods; its statistics are null.
    """
    ks = list(keys) or ["_one"]
    d = df if keys else df.withColumn("_one", F.lit(0))
    rows = _leg_rows(d, ks, n, bounded)
    per = _periods(rows, ks)
    year = per.join(d.select(*ks, "h").distinct(), ks)
    g = year.where(F.col("gross").isNotNull()).withColumns({
        "net_rt": F.col("gross") - F.col("cost_round_trip"), "net_ch": F.col("gross") - F.col("cost_changes_only"),
        "_py": PERIODS_PER_YEAR / F.col("h")})
    def stats(c, name):
        mean, sd, py = F.avg(c), F.stddev_samp(c), F.max("_py")
        return [(mean * 1e4).alias(f"{name}_mean_bp"), (mean * py).alias(f"{name}_ann_return"),
                F.when(sd > 0, mean / sd * F.sqrt(py)).alias(f"{name}_ann_sharpe")]
    s = g.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("periods"), F.max("h").alias("rebalance_every_sessions"), *stats("gross", "gross"),
        *stats("net_rt", "net_round_trip"), *stats("net_ch", "net_changes_only"),
        (F.avg("cost_changes_only") * 1e4).alias("cost_changes_only_bp"),
        (F.avg("gross") / 4 * 1e4).alias("break_even_half_spread_bp"), F.avg("net_rt").alias("_edge"))
    t = per.groupBy(*ks).agg(F.avg("turnover").alias("turnover_long_leg"),
                             (F.avg("cost_round_trip") * 1e4).alias("cost_round_trip_bp"),
                             F.count_distinct("date").alias("_dates"))
    size = rows.groupBy(*ks, "date", "leg").agg(F.count(F.lit(1)).alias("c")).groupBy(*ks).agg(
        F.avg("c").alias("names_per_leg"))
    rows = rows.join(quantiles(rows, ks, "vol20", {"_vol_med": .5}).drop("n"), ks, "left")
    vol = F.coalesce("vol20", "_vol_med")
    imp = rows.groupBy(*ks).agg(F.avg(safe_div(vol, safe_sqrt(F.exp("dollar_adv")))).alias("_unit"),
                                (F.avg(F.coalesce("spread_quoted", F.lit(0.0))) > 0.5).alias("_quoted"))
    med = quantiles(rows, ks, "hs", {"_hs_med": .5}).drop("n")
    out = s.join(t, ks).join(size, ks).join(imp, ks).join(med, ks)
    need = safe_div(F.col("_edge"), 4 * F.col("_unit"))
    cap = F.greatest(F.least(F.col("names_per_leg") * need * need, F.lit(MAX_CAPITAL)), F.lit(MIN_CAPITAL))
    out = out.withColumns({
        "median_half_spread_bp": F.col("_hs_med") * 1e4,
        "spread_source": F.when(F.col("_quoted"), "quoted").otherwise("roll"),
        "capacity_per_leg_usd": F.when((F.col("_edge") > 0) & need.isNotNull(), cap)})
    told = [c for c in out.columns if c not in (*ks, "periods", "rebalance_every_sessions", "_dates")]
    out = out.withColumns({c: F.when(F.col("_dates") >= MIN_PERIODS, F.col(c)) for c in told})
    return out.drop("_edge", "_unit", "_quoted", "_hs_med", "_dates", "_one")


def cost_check(findings: Sequence[Finding], segments: dict[str, DataFrame], n: int = 5, bounded: bool = False,
               min_names: int = 20) -> DataFrame:
    """K8. Costs and capacity of every finding on every segment, in one job per control set."""
    parts = []
    info = [(f.name, int(f.sign) or 1, f.horizon) for f in findings]
    for name, df in segments.items():
        signals, _ = finding_ics(df, [(f.name, f.feature, f.horizon, f.controls) for f in findings], None, min_names,
                                 bounded)
        meta = df.sparkSession.createDataFrame(info, "test_id string, sign int, h int")
        d = signals.join(F.broadcast(meta), "test_id").join(
            df.select("date", "entity", "half_spread", "dollar_adv", "vol20", "spread_quoted"), ["date", "entity"])
        parts.append(d.select(F.col("test_id").alias("finding"), F.lit(name).alias("segment"), "date", "entity",
                              F.col("signal").alias("sig"), F.col("y").alias("fwd"), "sign", "h", "half_spread",
                              "dollar_adv", "vol20", "spread_quoted"))
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return portfolio(d, ["finding", "segment"], n, bounded)
