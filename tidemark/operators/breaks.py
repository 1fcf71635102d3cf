"""Level shifts and structural breaks of aggregated series (inventory C4, C5, C15, C16).

A series has one value per period or date, so the calendar bounds it; scores are window expressions, and the
order-sensitive choice among candidates is a fold over a series' candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import count_if, period, require_columns
from tidemark.operators.explore import array_median
from tidemark.operators.order import quantiles

MIN_SCORE, MAX_BREAKS = 4.0, 3
MAD_TO_SD = 1.4826   # fixed value: median absolute deviation to standard deviation


def default_window(n_periods: int) -> int:
    return max(5, min(60, n_periods // 20))


def shift_scores(series: DataFrame, window: int, key: str = "series", at: str = "period",
                 value: str = "value") -> DataFrame:
    """C4. Per position with a full window on both sides: the medians before and after, and their distance in robust
    standard deviations (pooled absolute deviations)."""
    w = Window.partitionBy(key).orderBy(at)
    v = F.col(value).cast("double")
    def side(start, end):
        return F.array_sort(F.collect_list(v).over(w.rowsBetween(start, end)))
    s = series.withColumns({
        "pos": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(key)),
        "_b": side(-window, -1), "_a": side(0, window - 1)})
    s = s.where((F.col("pos") >= window) & (F.col("pos") <= F.col("_n") - window))
    s = s.where((F.size("_b") >= window // 2) & (F.size("_a") >= window // 2) & (F.size("_b") > 0) & (F.size("_a") > 0))
    s = s.withColumns({"before_median": array_median(F.col("_b")), "after_median": array_median(F.col("_a"))})
    dev = F.array_sort(F.concat(F.transform("_b", lambda x: F.abs(x - F.col("before_median"))),
                                F.transform("_a", lambda x: F.abs(x - F.col("after_median")))))
    scale = F.greatest(MAD_TO_SD * array_median(dev), 1e-9 + 0.01 * F.abs("before_median"))
    return s.select(key, at, "pos", "before_median", "after_median",
                    (F.abs(F.col("after_median") - F.col("before_median")) / scale).alias("score"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _split_point(values: Column, i: Column, w: int) -> Column:
    """Position near i whose two sides (within one window) differ most in mean, weighted by their sizes; the first of equals
    (to nine digits)."""
    lo, hi = F.greatest(F.lit(0), i - w), F.least(F.size(values), i + w)
    first, last = F.greatest(lo + 1, i - w // 2), F.least(hi - 1, i + w // 2)

    def parted(at: Column) -> Column:
        left = F.filter(F.slice(values, lo + 1, at - lo), F.isnotnull)
        right = F.filter(F.slice(values, at + 1, hi - at), F.isnotnull)
        sides = F.struct(F.size(left).alias("l"), F.size(right).alias("r"), _total(left).alias("ls"), _total(right).alias("rs"))
        return F.transform(F.array(sides), lambda x: F.when((x["l"] > 0) & (x["r"] > 0), F.struct(
            (-F.round(x["l"] * x["r"] / (x["l"] + x["r"]) * F.pow(x["ls"] / x["l"] - x["rs"] / x["r"], F.lit(2.0)), 9)).alias("less"), at.alias("at"))))[0]
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.transform(places, parted))["at"], i)


def level_shifts(series: DataFrame, window: int, k: int = MAX_BREAKS, min_score: float = MIN_SCORE,
                 key: str = "series", at: str = "period", value: str = "value") -> DataFrame:
    """C4/C5. The strongest shifts of each series, at most k, none within a window of a stronger one, each dated at
    the split that best separates the two sides.  A fold over a series' candidates, strongest first, chooses them."""
    scores = shift_scores(series, window, key, at, value).select(key, at, "score", "before_median", "after_median")
    whole = series.select(key, at, F.col(value).cast("double").alias("value")).join(
        scores.where(F.col("score") >= min_score), [key, at], "left")
    rows = whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, "value", "score", "before_median", "after_median"))).alias("_rows"))
    rows = rows.withColumn("_values", F.col("_rows.value"))
    ranked = F.array_sort(F.filter(F.transform("_rows", lambda x, i: F.struct((-x["score"]).alias("less"), (-i).alias("later"))),
                                   lambda c: c["less"].isNotNull()))

    def keep(found: Column, c: Column) -> Column:
        free = (F.size(found) < k) & F.forall(found, lambda f: F.abs(f + c["later"]) >= window)
        return F.when(free, F.array_append(found, -c["later"])).otherwise(found)
    found = F.aggregate(ranked, F.array().cast("array<int>"), keep)
    rows = rows.select(key, "_rows", "_values", F.explode(found).alias("_pos"))
    chosen, split = F.get("_rows", F.col("_pos")), F.get("_rows", _split_point(F.col("_values"), F.col("_pos"), window))
    before, after = chosen["before_median"], chosen["after_median"]
    return rows.select(key, split[at].alias(at), before.alias("before_median"), after.alias("after_median"),
                       (100 * (after - before) / F.nullif(F.abs(before), F.lit(0.0))).alias("change_pct"), chosen["score"].alias("score"))


BREAK_STATS = ("rows", "entities", "median", "p90", "null_share")


def period_stats(df: DataFrame, time: str, field: str | None = None, entity: str | None = None, freq: str = "M",
                 stats: Sequence[str] = BREAK_STATS) -> DataFrame:
    """C15. (series, period, value) for the chosen statistics of each period."""
    require_columns(df, time, field, entity)
    d = df.withColumn("period", period(F.col(time), freq)).where(F.col("period").isNotNull())
    shares = [(count_if(F.col(field).isNull()) / F.count(F.lit(1))).alias("null_share")] if field and "null_share" in stats else []
    wide = d.groupBy("period").agg(F.count(F.lit(1)).cast("double").alias("rows"), *shares)
    if entity and "entities" in stats:
        ents = d.groupBy("period", entity).agg(F.lit(1)).groupBy("period").agg(
            F.count(entity).cast("double").alias("entities"))
        wide = wide.join(ents, "period", "left")
    if field and {"median", "p90"} & set(stats):
        wide = wide.join(quantiles(d, ["period"], field, {"median": .5, "p90": .9}).drop("n"), "period", "left")
    names = [s for s in stats if s in wide.columns]
    return wide.unpivot(["period"], names, "series", "value").select("series", "period", "value")


def structural_breaks(df: DataFrame, time: str, field: str | None = None, entity: str | None = None, freq: str = "M",
                      stats: Sequence[str] = BREAK_STATS, window: int = 5) -> DataFrame:
    """C15. Level shifts of every statistic (``default_window`` gives the usual window for a number of periods)."""
    return level_shifts(period_stats(df, time, field, entity, freq, stats), window)


def zero_until(series: DataFrame) -> DataFrame:
    """C16. Series that are zero through their whole first half and positive later, with the first positive period."""
    w = Window.partitionBy("series").orderBy("period")
    s = series.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(
        Window.partitionBy("series"))})
    early = F.col("_i") < F.floor(F.col("_n") / 2)
    zero = F.coalesce(F.col("value") == 0, F.lit(False))
    g = s.groupBy("series").agg(F.bool_and(~early | zero).alias("_z"),
                                F.min(F.when(F.col("value") > 0, F.col("period"))).alias("starts"))
    return g.where("_z and starts is not null").select("series", "starts")


def break_clusters(breaks: DataFrame, days: int = 62) -> DataFrame:
    """C16. Break dates no further than ``days`` from the one before form one event: its dates, and the statistics that
    break within ``days`` of its first date."""
    w = Window.partitionBy(F.lit(0)).orderBy("period")   # a handful of break dates
    dates = breaks.select("period").distinct()
    new = F.when(F.datediff("period", F.lag("period").over(w)) <= days, 0).otherwise(1)
    dates = dates.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w))
    firsts = dates.groupBy("cluster").agg(F.min("period").alias("_first"))
    named = breaks.join(dates.select("period", "cluster"), "period").join(firsts, "cluster")
    near = F.datediff("period", "_first") <= days
    return named.groupBy("cluster").agg(
        F.min("period").alias("first_date"), F.max("period").alias("last_date"),
        F.concat_ws(", ", F.sort_array(F.collect_set(F.when(near, F.col("series"))))).alias("statistics"),
        F.concat_ws(", ", F.sort_array(F.collect_set(F.date_format("period", "yyyy-MM")))).alias("months"))
