"""Information coefficients, Newey-West statistics, quantile spreads and the batch screen (inventory J11-J20, J24, J25).

Every statistic takes ``keys``: extra grouping columns, so one job tests many features, horizons and subsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import (count_if, hurdle, pearson, pearson_sums, require_columns, safe_div,
                                        significance)
from tidemark.operators.order import positions, rank_columns, with_group_stat, with_rank
from tidemark.specs import CONTROLS, HORIZONS, Finding

MIN_NAMES = 20
MIN_DATES = 10   # a t-statistic needs at least this many dates
T_BAR = 2.0
DEPENDENT = 1e-10   # share of a control's variation that must be its own


def _and_known(*cols: str) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return ok


def centered_rank(df: DataFrame, x: str, out: str, keys: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """J11. Same-date percentile rank minus its mean."""
    d = with_rank(df, [*keys, "date"], x, "_pct", bounded=bounded)
    d = with_group_stat(d, [*keys, "date"], _cnt=F.count(x))
    return d.withColumn(out, F.col("_pct") - 0.5 * (1 + safe_div(F.lit(1.0), F.col("_cnt")))).drop("_pct", "_cnt")


def _swept(state: Column, turn: Column) -> Column:
    """One elimination: the unused control that varies most beside those used clears its column from every other row."""
    size = F.size(state["used"])
    left = F.transform(state["m"], lambda row, i: F.struct(F.when(F.get(state["used"], i), F.lit(-1.0)).otherwise(F.get(row, i)).alias("most"), (-i).alias("first")))
    best = F.array_max(left)
    at = -best["first"]
    pivot = F.get(state["m"], at)
    # what is left of a control that the others explain is rounding
    goes = best["most"] > DEPENDENT * F.get(state["scale"], at)

    def cleared(row: Column, i: Column) -> Column:
        times = F.when(i == at, F.lit(0.0)).otherwise(F.get(row, at) / F.get(pivot, at))
        return F.transform(row, lambda v, j: v - times * F.get(pivot, j))
    m = F.when(goes, F.transform(state["m"], cleared)).otherwise(state["m"])
    used = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(state["used"], i) | (goes & (i == at)))
    return F.struct(m.alias("m"), used.alias("used"), state["scale"].alias("scale"))


def solved(products: Column, size: int) -> Column:
    """Least-squares coefficients from cross-products, rows (xx, xy) of ``size`` controls: a pivoted Cholesky elimination as a
    fold.  A control that the others explain gets 0, which leaves the fit as it is."""
    start = F.struct(products.alias("m"), F.array(*[F.lit(False)] * size).alias("used"),
                     F.transform(products, lambda row, i: F.get(row, i)).alias("scale"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, _swept, lambda s: F.transform(
        s["m"], lambda row, i: F.when(F.get(s["used"], i), F.get(row, F.lit(size)) / F.get(row, i)).otherwise(F.lit(0.0))))
    return done


def residualize(df: DataFrame, x: str, controls: Sequence[str], out: str = "resid", keys: Sequence[str] = (),
                min_names: int = MIN_NAMES, bounded: bool = False) -> DataFrame:
    """J12. The feature's same-date rank net of the controls' ranks and, with "sector" among them, of sector means.

    Only rows complete in all of them are ranked; the rest, and dates with too few names, get null.  Demeaning by sector
    (or date) turns the fit into one small system per date, solved in column expressions.
    """
    num = [c for c in controls if c != "sector"]
    need = [x, *num, *(["sector"] if "sector" in controls else [])]
    require_columns(df, "date", "entity", *need, *keys)
    by = [*keys, "date"]
    ids = [*by, "entity"]
    d = df.where(_and_known(*need)).select(*ids, *need)
    d = rank_columns(d, by, [x, *num], row_id=ids, bounded=bounded)
    d = with_group_stat(d, by, _n=F.count(F.lit(1))).where(F.col("_n") >= min_names)
    cells = [*by, "sector"] if "sector" in controls else by
    ranks = [f"{c}_rank" for c in (x, *num)]
    d = with_group_stat(d, cells, **{f"_m_{r}": F.avg(r) for r in ranks})
    d = d.select(*ids, *[(F.col(r) - F.col(f"_m_{r}")).alias(f"_d{i}") for i, r in enumerate(ranks)])
    y = F.col("_d0")
    if num:
        xs = [F.col(f"_d{i + 1}") for i in range(len(num))]
        prods = d.groupBy(*by).agg(F.array(*[F.array(*[F.sum(a * b) for b in (*xs, y)]) for a in xs]).alias("_xx"))
        beta = prods.select(*by, solved(F.col("_xx"), len(xs)).alias("_beta"))
        d = d.join(beta, by)
        fit = F.lit(0.0)
        for i, c in enumerate(xs):
            fit = fit + F.get("_beta", F.lit(i)) * c
        y = y - fit
    # the last bits of a fit are noise; residuals equal to twelve digits stay ties
    return df.join(d.select(*ids, F.round(y, 12).alias(out)), ids, "left")


def daily_ic(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_names: int = MIN_NAMES,
             bounded: bool = False) -> DataFrame:
    """J13. (keys, date, n, ic): same-date rank correlation on complete pairs, for dates with enough names."""
    require_columns(df, "date", "entity", x, y, *keys)
    by = [*keys, "date"]
    d = df.where(_and_known(x, y)).select(*by, "entity", F.col(x).alias("_x"), F.col(y).alias("_y"))
    d = rank_columns(d, by, ["_x", "_y"], "rank", row_id=[*by, "entity"], bounded=bounded)
    ic = d.groupBy(*by).agg(*pearson_sums(F.col("_x_rank"), F.col("_y_rank")))
    return (ic.where(F.col("n") >= min_names).select(*by, "n", pearson().alias("ic"))
            .where(F.col("ic").isNotNull()))


def nw_lag(h: Column) -> Column:
    """Overlapping h-session returns are correlated over h-1 sessions; persistent features add some: at least 5."""
    return F.greatest(F.lit(5), h)


def newey_west_t(values: Column, lag: Column) -> Column:
    """J14. t of the mean of an ordered array, Bartlett weights; null under MIN_DATES values."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    mean = total / n
    e = F.transform(values, lambda v: v - mean)
    def dot(k):
        return F.aggregate(F.zip_with(F.slice(e, k + 1, n - k), F.slice(e, F.lit(1), n - k), lambda a, b: a * b),
                           F.lit(0.0), lambda s, v: s + v)
    lags = F.sequence(F.lit(1), F.greatest(F.least(lag, n - 1), F.lit(1)))
    covs = F.aggregate(F.transform(lags, lambda k: 2 * (1 - k / (lag + 1)) * dot(k)), F.lit(0.0), lambda s, v: s + v)
    s = (dot(F.lit(0)) + covs) / n
    return F.when((n >= MIN_DATES) & (s > 0), mean / F.sqrt(s / n))


def nw_t(series: DataFrame, value: str, lag: Column, keys: Sequence[str] = (), order: str = "date") -> DataFrame:
    """J14. The t of each keyed series (one value per date, so the calendar bounds the array)."""
    ks = list(keys) or ["_one"]
    s = series if keys else series.withColumn("_one", F.lit(0))
    s = s.where(F.col(value).isNotNull()).groupBy(*ks).agg(
        F.sort_array(F.collect_list(F.struct(order, value))).alias("_v"), F.max(lag).alias("_lag"))
    values = F.transform("_v", lambda r: r[value])
    return s.select(*keys, F.size("_v").cast("long").alias("n_dates"), F.aggregate(
        values, F.lit(0.0), lambda a, v: a + v).alias("_sum"), newey_west_t(values, F.col("_lag")).alias("t_nw")
    ).withColumn("mean", F.col("_sum") / F.col("n_dates")).drop("_sum")


def ic_stats(ic: DataFrame, h: Column | int, keys: Sequence[str] = ()) -> DataFrame:
    """J15. Mean, volatility, Newey-West t, hit rate, dates."""
    h = F.lit(h) if isinstance(h, int) else h
    ks = list(keys) or ["_one"]
    s = ic if keys else ic.withColumn("_one", F.lit(0))
    s = s.withColumn("_lag", nw_lag(h))
    return s.groupBy(*ks).agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_vol"),
        F.sort_array(F.collect_list(F.struct("date", "ic"))).alias("_v"),   # one value per date
        safe_div(count_if(F.col("ic") > 0), F.count("ic")).alias("hit_rate"), F.count("ic").alias("n_dates"),
        F.max("_lag").alias("nw_lag"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ).withColumn("t_nw", newey_west_t(F.transform("_v", lambda r: r["ic"]), F.col("nw_lag"))).drop("_v", "_one")


def ic_by_year(ic: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """J15."""
    return ic.groupBy(*keys, F.year("date").alias("year")).agg(F.avg("ic").alias("mean_ic"),
                                                               F.count("ic").alias("n_dates"))


def quantile_returns(df: DataFrame, x: str, y: str, n: int, keys: Sequence[str] = (), min_names: int = MIN_NAMES,
                     bounded: bool = False) -> DataFrame:
    """J16. (keys, date, q, excess): mean of y in each same-date quantile of x, in excess of the date's mean.  Ties are
    split in entity order."""
    by = [*keys, "date"]
    d = df.where(_and_known(x, y)).select(*by, "entity", F.col(x).alias("_x"), F.col(y).alias("_y"))
    d = positions(d, by, ["_x", "entity"], "_p", bounded=bounded).where(
        F.col("group_n") >= max(min_names, 2 * n))
    q = F.least(F.ceil((F.col("_p") + 1) / F.col("group_n") * n), F.lit(n)).cast("int")
    cells = d.groupBy(*by, q.alias("q")).agg(F.avg("_y").alias("_m"), F.sum("_y").alias("_s"),
                                             F.count("_y").alias("_c"))
    mean = cells.groupBy(*by).agg(safe_div(F.sum("_s"), F.sum("_c")).alias("_date_mean"))
    return cells.join(mean, by).select(*by, "q", (F.col("_m") - F.col("_date_mean")).alias("excess"))


def quantile_means(per: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """J16. Mean excess of each quantile over the dates."""
    return per.groupBy(*keys, "q").agg(F.avg("excess").alias("mean_excess"), F.count("excess").alias("n_dates"))


def quantile_spread(df: DataFrame, x: str, y: str, n: int, h: int, keys: Sequence[str] = (),
                    min_names: int = MIN_NAMES, bounded: bool = False) -> DataFrame:
    """J16. Top minus bottom quantile with its Newey-West t, and monotonicity (rank correlation of the quantile means
    with their order)."""
    ks = list(keys) or ["_one"]
    per = quantile_returns(df if keys else df.withColumn("_one", F.lit(0)), x, y, n, ks, min_names, bounded)
    ends = per.groupBy(*ks, "date").agg(F.max(F.when(F.col("q") == n, F.col("excess"))).alias("_top"),
                                        F.max(F.when(F.col("q") == 1, F.col("excess"))).alias("_bottom"))
    spread = ends.withColumn("spread", F.col("_top") - F.col("_bottom"))
    t = nw_t(spread, "spread", nw_lag(F.lit(h)), ks).withColumnRenamed("mean", "top_minus_bottom")
    m = rank_columns(quantile_means(per, ks), ks, ["mean_excess"], "rank", bounded=True, row_id=[*ks, "q"])
    mono = m.groupBy(*ks).agg(*pearson_sums(F.col("mean_excess_rank"), F.col("q").cast("double"))).select(
        *ks, pearson().alias("monotonicity"))
    return t.join(mono, ks).drop("_one")


def ic_summary(df: DataFrame, feature: str, h: int, controls: Sequence[str] = (), n_tests: int | Column = 1,
               min_names: int = MIN_NAMES, bounded: bool = False) -> DataFrame:
    """J18. IC statistics of a feature at one horizon, optionally net of controls, with the hurdle for n tests."""
    bad = [c for c in controls if c not in CONTROLS]
    if bad:
        raise ValueError(f"unknown controls {bad}; available: {CONTROLS}")
    d, x = df, feature
    if controls:
        d, x = residualize(df, feature, controls, "_resid", min_names=min_names, bounded=bounded), "_resid"
    s = ic_stats(daily_ic(d, x, f"fwd_{h}", min_names=min_names, bounded=bounded), h)
    bar = hurdle(F.lit(n_tests) if isinstance(n_tests, int) else n_tests)
    return s.select(F.lit(feature).alias("feature"), F.lit(h).alias("horizon"),
                    F.lit(",".join(sorted(controls))).alias("controls"), "*").withColumns(
        {"hurdle_t": bar, "significance": significance(F.col("t_nw"), bar)})


def horizon_long(df: DataFrame, horizons: Sequence[int], *cols: str) -> DataFrame:
    """(date, entity, cols, horizon, y) with the known forward returns."""
    d = df.select("date", "entity", *cols, *[F.col(f"fwd_{h}").alias(str(h)) for h in horizons])
    d = d.unpivot(["date", "entity", *cols], [str(h) for h in horizons], "horizon", "y")
    return d.where(F.col("y").isNotNull()).withColumn("horizon", F.col("horizon").cast("int"))


def ic_decay(df: DataFrame, feature: str, controls: Sequence[str] = (), horizons: Sequence[int] = HORIZONS,
             min_names: int = MIN_NAMES, bounded: bool = False) -> DataFrame:
    """J19. IC statistics at every horizon in one job; ``peak`` marks the strongest mean."""
    d, x = df, feature
    if controls:
        d, x = residualize(df, feature, controls, "_resid", min_names=min_names, bounded=bounded), "_resid"
    long = horizon_long(d.withColumn("_x", F.col(x)).where(F.col("_x").isNotNull()), horizons, "_x")
    ic = daily_ic(long, "_x", "y", ["horizon"], min_names, bounded)
    s = ic_stats(ic, F.col("horizon"), ["horizon"]).select("horizon", "mean_ic", "t_nw", "n_dates")
    peak = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.abs("mean_ic").desc_nulls_last(), "horizon"))
    return s.withColumn("peak", peak == 1)   # one row per horizon


def tercile(df: DataFrame, col: str, out: str, bounded: bool = False) -> DataFrame:
    """Same-date tercile of a column: low, mid, high."""
    d = with_rank(df, ["date"], col, "_pct", bounded=bounded)
    label = F.when(F.col("_pct") <= 1 / 3, "low").when(F.col("_pct") <= 2 / 3, "mid").when(
        F.col("_pct").isNotNull(), "high")
    return d.withColumn(out, label).drop("_pct")


def with_bucket(df: DataFrame, by: str, bounded: bool = False) -> DataFrame:
    """Adds ``bucket``: terciles of dollar_adv, size or beta, the sector, or the year."""
    if by == "year":
        return df.withColumn("bucket", F.year("date").cast("string"))
    if by == "sector":
        return df.withColumn("bucket", F.coalesce("sector", F.lit("Unknown")))
    if by in ("dollar_adv", "size", "beta"):
        return tercile(df, by, "bucket", bounded)
    raise ValueError("by must be dollar_adv, size, beta, sector or year")


def conditional_ic(df: DataFrame, feature: str, h: int, by: str, min_names: int = MIN_NAMES,
                   bounded: bool = False) -> DataFrame:
    """J20. IC statistics within each bucket of a conditioner."""
    d = with_bucket(df, by, bounded).where(F.col("bucket").isNotNull())
    ic = daily_ic(d, feature, f"fwd_{h}", ["bucket"], min_names, bounded)
    return ic_stats(ic, h, ["bucket"]).select("bucket", "mean_ic", "t_nw", "n_dates")


def finding_ics(df: DataFrame, pairs: Sequence[tuple], keep: dict[str, Column] | None = None,
                min_names: int = MIN_NAMES, bounded: bool = False) -> tuple[DataFrame, DataFrame]:
    """Signals and IC statistics of many (id, feature, horizon, controls) tests, each on the rows ``keep[id]`` lets
    through, in one job.  Returns (signal rows, statistics)."""
    keep = keep or {}
    sets: dict[tuple, list] = {}
    for p in pairs:
        sets.setdefault(tuple(sorted(p[3])), []).append(p)
    parts = []
    for ctrl, group in sets.items():
        cells = [F.struct(F.lit(pid).alias("test_id"), F.lit(h).alias("horizon"), F.col(f).cast("double").alias("x"),
                          F.col(f"fwd_{h}").cast("double").alias("y"),
                          F.coalesce(keep.get(pid, F.lit(True)), F.lit(False)).alias("_in"))
                 for pid, f, h, _ in group]
        d = df.select("date", "entity", *ctrl, F.explode(F.array(*cells)).alias("c")).select(
            "date", "entity", *ctrl, "c.*").where("_in").drop("_in")
        if ctrl:
            d = residualize(d, "x", ctrl, "signal", ["test_id"], min_names, bounded)
        else:
            d = d.withColumn("signal", F.col("x"))
        parts.append(d.select("test_id", "horizon", "date", "entity", "signal", "y"))
    signals = parts[0]
    for p in parts[1:]:
        signals = signals.unionByName(p)
    ic = daily_ic(signals, "signal", "y", ["test_id", "horizon"], min_names, bounded)
    return signals, ic_stats(ic, F.col("horizon"), ["test_id", "horizon"])


def retest(findings: Sequence[Finding], df: DataFrame, min_names: int = MIN_NAMES, bounded: bool = False) -> DataFrame:
    """J24. The findings on a later segment: validated with the same sign and |t| of at least 2."""
    _, s = finding_ics(df, [(f.name, f.feature, f.horizon, f.controls) for f in findings], None, min_names, bounded)
    info = df.sparkSession.createDataFrame([(f.name, f.feature, int(f.sign)) for f in findings],
                                           "test_id string, feature string, sign int")
    out = info.join(s, "test_id", "left")
    ok = (F.signum("mean_ic") == F.col("sign")) & (F.abs("t_nw") >= T_BAR)
    return out.select(F.col("test_id").alias("finding"), "feature", "sign", "mean_ic", "t_nw", "n_dates",
                      F.coalesce(ok, F.lit(False)).alias("validated"))


def screen(df: DataFrame, features: Sequence[str], horizons: Sequence[int], control_sets: Sequence[Sequence[str]],
           by: str | None = None, min_names: int = MIN_NAMES, bounded: bool = False) -> DataFrame:
    """J25. Every (feature, horizon, control set) in one job, judged against the hurdle for the number of distinct
    tests, buckets of the conditioner included.

    Labels: informative, not_informative, explained_by_control (the raw relation clears the hurdle, the controlled one
    does not), unstable (buckets of opposite sign, each with |t| of at least 2), inconclusive (no estimate).
    """
    sets = {",".join(sorted(c)): tuple(sorted(c)) for c in control_sets}
    sets = {"": (), **sets}   # a controlled test is read against the raw one
    parts = []
    for label, ctrl in sets.items():
        long = df.select("date", "entity", *ctrl, *[F.col(f).cast("double").alias(f"_f_{f}") for f in features]).unpivot(
            ["date", "entity", *ctrl], [f"_f_{f}" for f in features], "feature", "x")
        long = long.withColumn("feature", F.substr("feature", F.lit(4))).where(F.col("x").isNotNull())
        if ctrl:
            long = residualize(long, "x", ctrl, "signal", ["feature"], min_names, bounded)
        else:
            long = long.withColumn("signal", F.col("x"))
        parts.append(long.where(F.col("signal").isNotNull()).select(
            F.lit(label).alias("controls"), "feature", "date", "entity", "signal"))
    signals = parts[0]
    for p in parts[1:]:
        signals = signals.unionByName(p)
    d = with_bucket(df, by, bounded) if by else df.withColumn("bucket", F.lit(None).cast("string"))
    y = horizon_long(d, horizons, "bucket")
    pairs = signals.join(y, ["date", "entity"])
    keys = ["controls", "feature", "horizon"]
    main = ic_stats(daily_ic(pairs, "signal", "y", keys, min_names, bounded), F.col("horizon"), keys)
    main = main.select(*keys, "mean_ic", "t_nw", "n_dates")
    grid = df.sparkSession.createDataFrame([(c, f, h) for c in sets for f in features for h in horizons],
                                           "controls string, feature string, horizon int")
    main = grid.join(main, keys, "left")
    main = main.withColumn("test_key", F.concat_ws("|", F.lit("ic"), "feature", F.col("horizon").cast("string"),
                                                   "controls"))
    tests = main.select("test_key")
    if by:
        raw = pairs.where((F.col("controls") == "") & F.col("bucket").isNotNull())
        bk = ["feature", "horizon", "bucket"]
        cond = ic_stats(daily_ic(raw, "signal", "y", bk, min_names, bounded), F.col("horizon"), bk)
        flips = cond.groupBy("feature", "horizon").agg(
            (F.coalesce(F.bool_or(F.col("t_nw") >= T_BAR), F.lit(False)) &
             F.coalesce(F.bool_or(F.col("t_nw") <= -T_BAR), F.lit(False))).alias("_flips"))
        main = main.join(flips, ["feature", "horizon"], "left")
        tests = tests.unionByName(cond.select(F.concat_ws("|", F.lit("cond"), "feature", F.col("horizon").cast(
            "string"), F.concat(F.lit(f"{by}="), "bucket")).alias("test_key")))
    else:
        main = main.withColumn("_flips", F.lit(False))
    n = tests.agg(F.count_distinct("test_key").alias("n_tests")).withColumn("_one", F.lit(0))
    raw_t = main.where(F.col("controls") == "").select("feature", "horizon", F.col("t_nw").alias("_raw_t"))
    out = main.join(raw_t, ["feature", "horizon"], "left").withColumn("_one", F.lit(0)).join(F.broadcast(n), "_one")
    out = out.withColumn("hurdle_t", hurdle(F.col("n_tests")))
    clears = F.abs("t_nw") >= F.col("hurdle_t")
    label = (F.when(F.col("t_nw").isNull(), "inconclusive")
             .when(F.coalesce("_flips", F.lit(False)), "unstable")
             .when(clears, "informative")
             .when((F.col("controls") != "") & (F.abs("_raw_t") >= F.col("hurdle_t")), "explained_by_control")
             .otherwise("not_informative"))
    return out.select("feature", "horizon", "controls", "mean_ic", "t_nw", "n_dates", "n_tests", "hurdle_t",
                      label.alias("label"))
