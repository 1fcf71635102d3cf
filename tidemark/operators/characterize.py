"""What a feature depends on and how stable it is, by same-date ranks (inventory I).

The statistics work on the long form (feature, date, entity, x, c), so many features cost one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import count_if, pearson, pearson_sums, safe_div, share
from tidemark.operators.breaks import MIN_SCORE, level_shifts
from tidemark.operators.explore import variance_split
from tidemark.operators.features import NEUTRALIZING, lineage
from tidemark.operators.order import quantiles, rank_columns, with_rank
from tidemark.operators.panel import CATEGORICAL, conditioner
from tidemark.specs import FeatureSpec

# Strong and moderate dependence, as a mean rank correlation and as a share of rank variance.
STRONG_RHO, MODERATE_RHO = 0.3, 0.1
STRONG_ETA, MODERATE_ETA = 0.10, 0.03
MIN_ROWS = 50
ADDRESSING = ("ratio", "rank", *NEUTRALIZING)   # operations that can remove a dependence


def feature_long(panel: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """(feature, date, entity, x[, c]) with every panel row, known or not."""
    cond = [conditioner(by).alias("c")] if by else []
    d = panel.select("date", "entity", *cond, *[F.col(f).cast("double").alias(f"_f_{f}") for f in features])
    ids = ["date", "entity", *(["c"] if by else [])]
    long = d.unpivot(ids, [f"_f_{f}" for f in features], "feature", "x")
    return long.withColumn("feature", F.substr("feature", F.lit(4)))


def _complete(long: DataFrame) -> DataFrame:
    return long.where(F.col("x").isNotNull() & F.col("c").isNotNull())


def _strength(value: Column, strong: float, moderate: float, rows: Column) -> Column:
    return (F.when(rows < MIN_ROWS, "not measurable").when(F.abs(value) >= strong, "strong")
            .when(F.abs(value) >= moderate, "moderate").when(value.isNotNull(), "negligible")
            .otherwise("not measurable"))


def ranked_pairs(long: DataFrame, bounded: bool = False) -> DataFrame:
    """Complete pairs with the same-date percentile ranks of both sides."""
    return rank_columns(_complete(long), ["feature", "date"], ["x", "c"], row_id=["feature", "date", "entity"],
                        bounded=bounded)


def rank_corr_by_date(long: DataFrame, bounded: bool = False) -> DataFrame:
    """(feature, date, n, rho): same-date rank correlation of x and c on complete pairs."""
    r = ranked_pairs(long, bounded)
    sums = pearson_sums(F.col("x_rank"), F.col("c_rank"))
    return r.groupBy("feature", "date").agg(*sums).select("feature", "date", "n", pearson().alias("rho"))


def exposure_numeric(long: DataFrame, bounded: bool = False) -> DataFrame:
    """I1. Per feature: mean same-date rank correlation with the conditioner, its t, the share of dates above zero."""
    rho = rank_corr_by_date(long, bounded)
    s = rho.groupBy("feature").agg(F.sum("n").alias("rows_compared"), F.avg("rho").alias("rank_corr_mean"),
                                   F.stddev_samp("rho").alias("_s"), F.count("rho").alias("n_dates"),
                                   safe_div(count_if(F.col("rho") > 0), F.count("rho")).alias("share_dates_positive"))
    t = F.when(F.col("_s") > 0, F.col("rank_corr_mean") / F.col("_s") * F.sqrt("n_dates"))
    return s.withColumn("rank_corr_t", t).withColumn(
        "strength", _strength(F.col("rank_corr_mean"), STRONG_RHO, MODERATE_RHO, F.col("rows_compared"))).drop("_s")


def exposure_by_year(long: DataFrame, bounded: bool = False) -> DataFrame:
    """I1."""
    return rank_corr_by_date(long, bounded).groupBy("feature", F.year("date").alias("year")).agg(
        F.avg("rho").alias("rank_corr"))


def exposure_profile(long: DataFrame, bounded: bool = False, groups: int = 5) -> DataFrame:
    """I1. Per conditioner quintile: rows, mean feature rank and p10-p90 spread of the feature."""
    r = ranked_pairs(long, bounded)
    q = F.greatest(F.least(F.ceil(F.col("c_rank") * groups), F.lit(groups)), F.lit(1)).cast("int")
    r = r.withColumn("quintile", q)
    mean = r.groupBy("feature", "quintile").agg(F.count(F.lit(1)).alias("rows"), F.avg("x_rank").alias("mean_rank"))
    disp = quantiles(r, ["feature", "quintile"], "x", {"_lo": .1, "_hi": .9})
    return mean.join(disp, ["feature", "quintile"]).select(
        "feature", "quintile", "rows", "mean_rank", (F.col("_hi") - F.col("_lo")).alias("p10_p90_spread"))


def _group_cells(long: DataFrame, bounded: bool) -> DataFrame:
    d = with_rank(_complete(long), ["feature", "date"], "x", "r", bounded=bounded)
    return d.groupBy("feature", "date", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"),
                                                 F.sum(F.col("r") * F.col("r")).alias("ss"))


def eta_by_date(long: DataFrame, bounded: bool = False) -> DataFrame:
    """Share of same-date rank variance between groups, adjusted for the number of groups."""
    g = _group_cells(long, bounded).groupBy("feature", "date").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("gs"))
    n, mean_sq = F.col("n"), F.col("s") * F.col("s") / F.col("n")
    total = F.col("ss") - mean_sq
    raw = F.when(total > 1e-12 * F.col("ss"), (F.col("gs") - mean_sq) / total)
    eta = 1 - (1 - raw) * safe_div(n - 1, F.when(n > F.col("k"), n - F.col("k")))
    return g.select("feature", "date", "n", eta.alias("eta"))


def exposure_categorical(long: DataFrame, bounded: bool = False) -> DataFrame:
    """I2. Per feature: mean bias-adjusted eta squared."""
    e = eta_by_date(long, bounded).groupBy("feature").agg(
        F.sum("n").alias("rows_compared"), F.avg("eta").alias("eta_squared_mean"), F.count("eta").alias("n_dates"))
    return e.withColumn("strength", _strength(F.col("eta_squared_mean"), STRONG_ETA, MODERATE_ETA,
                                              F.col("rows_compared")))


def eta_by_year(long: DataFrame, bounded: bool = False) -> DataFrame:
    """I2."""
    return eta_by_date(long, bounded).groupBy("feature", F.year("date").alias("year")).agg(
        F.avg("eta").alias("eta_squared"))


def group_profile(long: DataFrame, bounded: bool = False) -> DataFrame:
    """I2. Rows and mean feature rank of each group."""
    g = _group_cells(long, bounded).groupBy("feature", F.col("c").alias("group"))
    return g.agg(F.sum("n").alias("rows"), safe_div(F.sum("s"), F.sum("n")).alias("mean_rank"))


def exposure(panel: DataFrame, x: str, by: str, bounded: bool = False) -> DataFrame:
    """I1/I2 of one feature."""
    long = feature_long(panel, [x], by)
    return (exposure_categorical if by in CATEGORICAL else exposure_numeric)(long, bounded)


def rank_autocorrelation(panel: DataFrame, features: Sequence[str], lags: Sequence[int] = (1, 5, 20),
                         bounded: bool = False) -> DataFrame:
    """I3. Per feature: correlation of same-date ranks with those of the entity's earlier records."""
    long = with_rank(feature_long(panel, features), ["feature", "date"], "x", "r", bounded=bounded)
    w = Window.partitionBy("feature", "entity").orderBy("date")   # one row per date
    d = long.withColumns({f"_r{k}": F.lag("r", k).over(w) for k in lags})
    sums = [c for k in lags for c in pearson_sums(F.col("r"), F.col(f"_r{k}"), f"_l{k}_")]
    return d.groupBy("feature").agg(share(F.col("x").isNotNull()).alias("coverage_share"), *sums).select(
        "feature", "coverage_share", *[pearson(f"_l{k}_", 11).alias(f"rank_acf_lag{k}") for k in lags])


def stability_series(panel: DataFrame, x: str, bounded: bool = False) -> DataFrame:
    """I3. Per date: known values, median, p10 and p90."""
    d = panel.select("date", F.col(x).cast("double").alias("x"))
    n = d.groupBy("date").agg(F.count("x").alias("n"))
    q = quantiles(d, ["date"], "x", {"median": .5, "p10": .1, "p90": .9}, bounded=bounded).drop("n")
    return n.join(q, "date", "left")


def stability_breaks(series: DataFrame, window: int, min_score: float = MIN_SCORE) -> DataFrame:
    """I3. Level shifts of the cross-sectional median and of coverage."""
    long = series.select("date", "median", F.col("n").cast("double").alias("coverage")).unpivot(
        ["date"], ["median", "coverage"], "series", "value")
    return level_shifts(long, window, min_score=min_score, at="date")


def stability(panel: DataFrame, x: str, lags: Sequence[int] = (1, 5, 20), edge: int = 250,
              bounded: bool = False) -> DataFrame:
    """I3. One row: coverage per date, median of the first and last dates, rank persistence, variance split."""
    one = F.lit(0).alias("_one")
    s = stability_series(panel, x, bounded)
    up = Window.partitionBy(F.lit(0))   # one row per date
    s = s.withColumns({"_i": F.row_number().over(up.orderBy("date")),
                       "_j": F.row_number().over(up.orderBy(F.desc("date")))})
    def mid(c):
        return F.percentile(c, F.lit(0.5))
    head = s.agg(F.count(F.lit(1)).alias("n_dates"), F.min("n").alias("coverage_min"), mid("n").alias("coverage_median"),
                 F.max("n").alias("coverage_max"),
                 mid(F.when(F.col("_i") <= edge, F.col("median"))).alias("median_first"),
                 mid(F.when(F.col("_j") <= edge, F.col("median"))).alias("median_last")).select("*", one)
    ac = rank_autocorrelation(panel, [x], lags, bounded).drop("feature", "coverage_share").select("*", one)
    v = variance_split(panel, "entity", "date", x).select(
        "share_between_entities", "share_within_entities", "share_common_over_time", one)
    return head.join(ac, "_one").join(v, "_one").drop("_one")


def compare_representations(panel: DataFrame, features: Sequence[str], by: str, bounded: bool = False) -> DataFrame:
    """I4. Per feature: dependence on the conditioner, its strength, lag-5 rank persistence, coverage; ``least`` marks
    the least dependent one."""
    long = feature_long(panel, features, by)
    if by in CATEGORICAL:
        dep = exposure_categorical(long, bounded).withColumnRenamed("eta_squared_mean", "dependence")
    else:
        dep = exposure_numeric(long, bounded).withColumnRenamed("rank_corr_mean", "dependence")
    ac = rank_autocorrelation(panel, features, (5,), bounded)
    d = ac.join(dep.select("feature", "dependence", "strength"), "feature", "left")
    # one row per feature
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.abs("dependence").asc_nulls_last(), "feature"))
    return d.select("feature", F.lit(by).alias("by"), "dependence", F.coalesce("strength", F.lit("not measurable"))
                    .alias("strength"), "rank_acf_lag5", "coverage_share", (best == 1).alias("least"))


def rank_corr(panel: DataFrame, a: str, b: str, faithful: float = 0.9, bounded: bool = False) -> DataFrame:
    """I5. Mean same-date rank correlation of two features, and whether one stands in for the other."""
    long = panel.select(F.lit(f"{a}~{b}").alias("feature"), "date", "entity", F.col(a).cast("double").alias("x"),
                        F.col(b).cast("double").alias("c"))
    r = rank_corr_by_date(long, bounded).agg(F.avg("rho").alias("rank_corr"), F.count("rho").alias("n_dates"))
    return r.withColumn("faithful", F.col("rank_corr") >= faithful)


def dependence_matrix(panel: DataFrame, features: Sequence[str], bys: Sequence[str],
                      specs: Sequence[FeatureSpec] = (), bounded: bool = False) -> DataFrame:
    """I6. (feature, by, dependence, strength, label) for every feature and conditioner.

    Labels: needless_neutralization (the input hardly depended on it), still_strong (after neutralizing), no_alternative
    (strong, and no feature from the same raw fields that could remove it).
    """
    numeric = [b for b in bys if b not in CATEGORICAL]
    parts = [exposure_numeric(feature_long(panel, features, b), bounded).select(
        "feature", F.lit(b).alias("by"), F.col("rank_corr_mean").alias("dependence"), "strength") for b in numeric]
    parts += [exposure_categorical(feature_long(panel, features, b), bounded).select(
        "feature", F.lit(b).alias("by"), F.col("eta_squared_mean").alias("dependence"), "strength")
        for b in bys if b in CATEGORICAL]
    m = parts[0]
    for p in parts[1:]:
        m = m.unionByName(p)
    by_name = {s.name: s for s in specs}
    meta = []   # metadata of the specs: a few rows
    for f in features:
        s = by_name.get(f)
        raw = {n for n in lineage(f, by_name) if n not in by_name}
        for b in bys:
            base = s.inputs[0] if s and s.op in NEUTRALIZING and s.group == b else None
            other = any(n != f and n in features and o.op in ADDRESSING and
                        raw & lineage(n, by_name) for n, o in by_name.items())
            meta.append((f, b, base, other))
    info = panel.sparkSession.createDataFrame(meta, "feature string, by string, base string, has_other boolean")
    base = m.select(F.col("feature").alias("base"), "by", F.col("strength").alias("_base_strength"))
    m = m.join(F.broadcast(info), ["feature", "by"]).join(F.broadcast(base), ["base", "by"], "left")
    label = (F.when(F.col("_base_strength") == "negligible", "needless_neutralization")
             .when(F.col("base").isNotNull() & (F.col("strength") == "strong"), "still_strong")
             .when((F.col("strength") == "strong") & ~F.col("has_other"), "no_alternative"))
    return m.select("feature", "by", "dependence", "strength", label.alias("label"))
