"""Coverage, missingness, distributions, dynamics, keys, breadth and category mix (inventory C)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import (count_if, is_numeric, pearson, pearson_sums, period, require_columns,
                                        safe_div, sample_kurtosis, sample_skew, share)
from tidemark.operators.order import quantiles, record_chunks, value_ranks, weighted_quantiles, with_group_stat
from tidemark.session import cut


def _series(order: str = "period") -> Window:
    """Order of an aggregated series: one row per period, so one partition holds at most the calendar."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


# ---------------------------------------------------------------- coverage

def coverage(df: DataFrame, time: str, entity: str | None = None, freq: str = "M") -> DataFrame:
    """C2. Per period: rows, and with an entity its distinct entities, the ones first seen and the ones last seen."""
    require_columns(df, time, entity)
    d = df.select(period(F.col(time), freq).alias("period"), *([F.col(entity).alias("e")] if entity else []))
    d = d.where(F.col("period").isNotNull())
    if not entity:
        return d.groupBy("period").agg(F.count(F.lit(1)).alias("rows"))
    cells = d.groupBy("period", "e").agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("period").agg(F.sum("n").alias("rows"), F.count("e").alias("entities"))
    span = cells.where(F.col("e").isNotNull()).groupBy("e").agg(F.min("period").alias("first"),
                                                                F.max("period").alias("last"))
    new = span.groupBy(F.col("first").alias("period")).agg(F.count(F.lit(1)).alias("new"))
    lost = span.groupBy(F.col("last").alias("period")).agg(F.count(F.lit(1)).alias("lost"))
    return (per.join(new, "period", "left").join(lost, "period", "left").na.fill(0, ["new", "lost"]))


def coverage_summary(per: DataFrame) -> DataFrame:
    """C2. One row from a coverage series: sizes, extremes and when, variation, typical entry and exit."""
    x = "entities" if "entities" in per.columns else "rows"
    first, last = F.min("period").over(Window.partitionBy(F.lit(0))), F.max("period").over(Window.partitionBy(F.lit(0)))
    s = per.withColumns({"_first": first, "_last": last})
    def extreme(agg, sign):   # the earliest period with the extreme value
        return agg("period", F.struct(F.col(x), (sign * F.datediff("period", F.lit("1970-01-01"))).alias("d")))
    cols = [F.count(F.lit(1)).alias("n_periods"), F.min("period").alias("first_period"),
            F.max("period").alias("last_period"), F.sum("rows").alias("n_rows"),
            F.min(x).alias("min_value"), F.percentile(x, F.lit(0.5)).alias("median_value"), F.max(x).alias("max_value"),
            extreme(F.min_by, 1).alias("min_at"), extreme(F.max_by, -1).alias("max_at"),
            safe_div(F.stddev_samp(x), F.avg(x)).alias("cv")]
    if x == "entities":
        cols += [F.percentile(F.when(F.col("period") != F.col("_first"), F.col("new")), F.lit(0.5)).alias("median_new"),
                 F.percentile(F.when(F.col("period") != F.col("_last"), F.col("lost")), F.lit(0.5)).alias("median_lost")]
    return s.agg(*cols)


def coverage_dips(per: DataFrame, value: str = "entities", below: float = 0.8) -> DataFrame:
    """C3. Periods far under the centred rolling median of the series (a short hole, not a lasting shift)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    s = per.select("period", F.col(value).cast("double").alias("value")).withColumn("_n", n)
    s = s.withColumn("_w", F.greatest(F.lit(3), F.least(F.lit(60), F.floor(F.col("_n") / 10))))
    # the frame's width depends on the series' length: collect the widest frame, slice the middle of it
    widest = _series().rowsBetween(-60, 60)
    around = F.filter(F.collect_list(F.struct("value", F.col("_i"))).over(widest),
                      lambda x: F.abs(x["_i"] - F.col("_i")) <= F.col("_w"))
    s = s.withColumn("_i", F.row_number().over(_series())).withColumn("_a", around)
    s = s.withColumn("_v", F.array_sort(F.transform(F.filter("_a", lambda x: x["value"].isNotNull()),
                                                    lambda x: x["value"])))
    s = s.withColumn("typical", F.when(F.size("_v") >= 3, array_median(F.col("_v"))))
    return s.where(F.col("value") < below * F.col("typical")).select("period", "value", "typical")


def array_median(sorted_values: Column) -> Column:
    """Median of a sorted array without nulls."""
    n = F.size(sorted_values)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(sorted_values, lo) + F.get(sorted_values, hi)) / 2)


# ---------------------------------------------------------------- missingness

def missingness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """C6. Per field: null, zero (numbers) and empty-text counts and shares, in one pass."""
    require_columns(df, *fields)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in fields:
        aggs.append(count_if(F.col(f).isNull()).alias(f"{f}__null"))
        if is_numeric(df, f):
            aggs.append(count_if(F.col(f) == 0).alias(f"{f}__zero"))
        elif isinstance(df.schema[f].dataType, T.StringType):
            aggs.append(count_if(F.trim(f) == "").alias(f"{f}__empty"))
    wide = df.agg(*aggs)
    def cell(f, kind):
        name = f"{f}__{kind}"
        return F.col(name) if name in wide.columns else F.lit(None).cast("long")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("_n").alias("n_rows"),
                                        cell(f, "null").alias("null_count"), cell(f, "zero").alias("zero_count"),
                                        cell(f, "empty").alias("empty_count")) for f in fields]))
    out = wide.select(rows.alias("r")).select("r.*")
    return out.withColumns({f"{k}_share": safe_div(F.col(f"{k}_count"), F.col("n_rows"))
                            for k in ("null", "zero", "empty")})


def missingness_over_time(df: DataFrame, fields: Sequence[str], time: str, freq: str = "M") -> DataFrame:
    """C7. Per field: largest null share of a period and the first period that has it; the same for zeros, with the
    typical zero share."""
    require_columns(df, time, *fields)
    d = df.withColumn("period", period(F.col(time), freq)).where(F.col("period").isNotNull())
    per = d.groupBy("period").agg(
        *[share(F.col(f).isNull()).alias(f"{f}__null") for f in fields],
        *[share(F.col(f) == 0).alias(f"{f}__zero") for f in fields if is_numeric(df, f)])
    def cell(f, kind):
        name = f"{f}__{kind}"
        return (F.col(name) if name in per.columns else F.lit(None).cast("double")).alias(kind)
    long = per.select("period", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), cell(f, "null"), cell(f, "zero")) for f in fields])).alias("r"))
    long = long.select("period", "r.*")
    early = (-F.datediff("period", F.lit("1970-01-01"))).alias("d")
    def when_max(c):
        return F.when(F.max(c) > 0, F.max_by("period", F.struct(F.coalesce(c, F.lit(-1.0)), early)))
    # one value per period
    return long.groupBy("field").agg(
        F.max("null").alias("null_max"), when_max("null").alias("null_max_at"), F.max("zero").alias("zero_max"),
        when_max("zero").alias("zero_max_at"), F.percentile("zero", F.lit(0.5)).alias("zero_median"))


def _days_present(df: DataFrame, time: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """Per entity its dates present and its span on the calendar, and the number of the table's dates (those of unknown
    entities too): one deal of the distinct (date, entity) serves all of it."""
    require_columns(df, time, entity)
    d = df.select(F.to_date(time).alias("day"), F.col(entity).alias("entity")).where(F.col("day").isNotNull()).distinct()
    dates = d.select("day").distinct().agg(F.count(F.lit(1)).alias("calendar_dates"))
    known = d.where(F.col("entity").isNotNull())
    cal = known.select("day").distinct().withColumn("pos", F.row_number().over(_series("day")))   # one row per date
    # only an entity's first and last date need their places
    per = known.groupBy("entity").agg(F.count(F.lit(1)).alias("n_dates"), F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    for end in ("_lo", "_hi"):
        per = per.join(F.broadcast(cal.select(F.col("day").alias(end), F.col("pos").alias(f"{end}_pos"))), end)
    per = per.select("entity", "n_dates", (F.col("_hi_pos") - F.col("_lo_pos") + 1).cast("long").alias("span"))
    return per.withColumn("presence", F.col("n_dates") / F.col("span")), dates


def entity_presence(df: DataFrame, time: str, entity: str) -> DataFrame:
    """C8. Per entity: dates present, dates of its own first..last span on the table's calendar, and their ratio."""
    return _days_present(df, time, entity)[0]


def presence(df: DataFrame, time: str, entity: str) -> DataFrame:
    """C8. How much of the entity x date panel is absent inside the entities' own histories."""
    per, dates = _days_present(df, time, entity)
    # the statistics read the entities several times, the table is read once
    whole = cut(per.join(F.broadcast(dates), F.lit(True), "cross").withColumn("_one", F.lit(0)))
    med = quantiles(whole, [], "presence", {"median_presence": .5}).drop("n").withColumn("_one", F.lit(0))
    agg = whole.groupBy("_one").agg(
        F.max("calendar_dates").alias("calendar_dates"), F.count(F.lit(1)).alias("entities"),
        safe_div(F.sum(F.col("span") - F.col("n_dates")), F.sum("span")).alias("absent_inside_span_share"),
        share(F.col("n_dates") == F.col("span")).alias("always_present_share"),
        share(F.col("span") == F.col("calendar_dates")).alias("whole_calendar_share"))
    return agg.join(med, "_one").drop("_one")


# ---------------------------------------------------------------- distributions

DISTRIBUTION_PROBS = {"p0": 0.0, "p1": .01, "p5": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95, "p99": .99,
                      "p100": 1.0}


def _field(df: DataFrame, field: str, denominator: str | None) -> Column:
    require_columns(df, field, denominator)
    x = F.col(field).cast("double")
    return safe_div(x, F.col(denominator)) if denominator else x


def distribution(df: DataFrame, field: str, denominator: str | None = None) -> DataFrame:
    """C9. One row: percentiles, moments, mass at zero and at the extremes, tails, and processing hints."""
    x = df.select(_field(df, field, denominator).alias("x")).withColumn("_one", F.lit(0))
    q = quantiles(x, ["_one"], "x", DISTRIBUTION_PROBS)
    iqr = F.col("p75") - F.col("p25")
    far = (F.col("x") > F.col("p75") + 3 * iqr) | (F.col("x") < F.col("p25") - 3 * iqr)
    known = F.col("x").isNotNull()
    s = x.join(F.broadcast(q), "_one").groupBy("_one", *q.columns[1:]).agg(
        count_if(~known).alias("n_null"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        sample_skew(F.col("x")).alias("skew"), sample_kurtosis(F.col("x")).alias("kurtosis"),
        count_if(F.col("x") == 0).alias("zero_count"), count_if(F.col("x") < 0).alias("_neg"),
        count_if(F.col("x") == F.col("p100")).alias("_max"), count_if(F.col("x") == F.col("p0")).alias("_min"),
        F.bool_and(F.when(known, F.col("x") % 1 == 0)).alias("integer_valued"), count_if(far).alias("_far"))
    n = F.col("n")
    s = s.withColumns({"zero_share": safe_div(F.col("zero_count"), n), "negative_share": safe_div(F.col("_neg"), n),
                       "share_at_max": safe_div(F.col("_max"), n), "share_at_min": safe_div(F.col("_min"), n),
                       "far_outlier_share": F.when(iqr > 0, safe_div(F.col("_far"), n)).otherwise(0.0)})
    spread = F.col("p100") != F.col("p0")
    s = s.withColumns({
        "hint_right_skewed": (F.col("negative_share") == 0) & (F.coalesce("skew", F.lit(0.0)) > 2),
        "hint_zero_mass": F.col("zero_share") > 0.05,
        "hint_capped": (F.col("share_at_max") > 0.01) & spread,
        "hint_heavy_tails": F.col("far_outlier_share") > 0.01,
        "mass_at_max": (F.col("share_at_max") >= 0.01) & spread})
    return s.drop("_one", "_neg", "_max", "_min", "_far")


def distribution_by_period(df: DataFrame, field: str, time: str, freq: str = "Y",
                           denominator: str | None = None) -> DataFrame:
    """C10. p10, median, p90 and count per period."""
    d = df.select(period(F.col(time), freq).alias("period"), _field(df, field, denominator).alias("x"))
    return quantiles(d, ["period"], "x", {"p10": .1, "median": .5, "p90": .9})


def histogram(df: DataFrame, field: str, bins: int = 60, denominator: str | None = None, log10: bool | None = None,
              clip: tuple[float, float] | None = None) -> DataFrame:
    """C11. Equal-width bins (bin, lo, hi, n).  ``log10=None`` takes logs of the positive values of a non-negative
    field with skew above 2; ``clip`` moves values outside two quantiles to them."""
    d = df.select(_field(df, field, denominator).alias("x")).where(F.col("x").isNotNull()).withColumn("_one", F.lit(0))
    if log10 is None:
        shape = d.groupBy("_one").agg(((F.min("x") >= 0) & (sample_skew(F.col("x")) > 2)).alias("_log"))
        d = d.join(F.broadcast(shape), "_one")
    else:
        d = d.withColumn("_log", F.lit(log10))
    d = d.withColumn("x", F.when(F.coalesce("_log", F.lit(False)), F.when(F.col("x") > 0, F.log10("x")))
                     .otherwise(F.col("x"))).where(F.col("x").isNotNull())
    if clip:
        q = quantiles(d, ["_one"], "x", {"_lo": clip[0], "_hi": clip[1]}).drop("n")
        d = d.join(F.broadcast(q), "_one").withColumn("x", F.greatest(F.least("x", "_hi"), "_lo")).drop("_lo", "_hi")
    b = d.groupBy("_one").agg(F.min("x").alias("_min"), F.max("x").alias("_max"))
    width = (F.col("_max") - F.col("_min")) / bins
    at = F.least(F.floor(safe_div(F.col("x") - F.col("_min"), width)), F.lit(bins - 1))
    got = d.join(F.broadcast(b), "_one").groupBy("_min", "_max", F.coalesce(at, F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    return got.select("bin", (F.col("_min") + F.col("bin") * width).alias("lo"),
                      (F.col("_min") + (F.col("bin") + 1) * width).alias("hi"), "n")


def ecdf(df: DataFrame, field: str, denominator: str | None = None) -> DataFrame:
    """C11. (x, share of known values at or below x), one row per distinct value."""
    d = df.select(_field(df, field, denominator).alias("x"))
    r = value_ranks(d.withColumn("_one", F.lit(0)), ["_one"], "x")
    upto = F.col("_before") + F.col("_ties")
    return r.select("x", upto.alias("n_at_or_below"), (upto / F.col("_total")).alias("share"))


def part_exceeds_whole(df: DataFrame, part: str, whole: str) -> DataFrame:
    """C12. Rows whose part exceeds the whole, with the predicate that flags them."""
    require_columns(df, part, whole)
    over = (F.col(whole) != 0) & (safe_div(F.col(part), F.col(whole)) > 1)
    return df.agg(count_if(over).alias("n_rows_over"), F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"remedy_column": F.lit(part), "remedy_op": F.lit(">col"), "remedy_value": F.lit(whole)})


# ---------------------------------------------------------------- dynamics and variance

def update_dynamics(df: DataFrame, entity: str, time: str, field: str, lags: Sequence[int] = (1, 5, 20),
                    tie: Sequence[str] = ()) -> DataFrame:
    """C13. How a field evolves within entities: share unchanged, days between observations and between changes of
    value, and pooled autocorrelation at the lags.  ``tie`` orders records of one entity and time."""
    require_columns(df, entity, time, field, *tie)
    d = df.where(F.col(field).isNotNull()).select(entity, time, field, *tie)
    d = d.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    order = [time, *(tie or [field])]
    chunked, w, own = record_chunks(d, [entity], order, max(lags))
    x = F.col(field).cast("double")
    recs = chunked.withColumns({"_prev_t": F.lag(time, 1).over(w), **{f"_x{k}": F.lag(x, k).over(w) for k in {1, *lags}}})
    recs = recs.withColumn("_change", F.when(own & F.col("_x1").isNotNull() & (x != F.col("_x1")), F.col(time)))
    before = F.last("_change", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    recs = recs.withColumns({"_gap": F.datediff(time, "_prev_t"), "_change_gap": F.datediff("_change", before)}).where(own)
    change = F.when(F.col("_change").isNotNull(), F.struct("_pos", "_change"))
    sums = [F.count(F.lit(1)).alias("n_obs"), F.count("_x1").alias("_n1"), count_if(x == F.col("_x1")).alias("_same"),
            count_if(F.col("_pos") == 0).alias("n_entities")]
    for k in lags:
        sums += pearson_sums(x, F.col(f"_x{k}"), f"_l{k}_")
    # everything comes from one pass over the chunks: sums and gaps, and what a chunk hands to the next ones
    cells = cut(recs.groupBy(entity, "_chunk", "_gap", "_change_gap").agg(*sums, F.min(change).alias("_first"), F.max(change).alias("_last")))
    names = [c for c in cells.columns[4:] if c not in ("_first", "_last")]
    base = cells.agg(*(F.sum(c).alias(c) for c in names)).withColumns({f"acf_lag{k}": pearson(f"_l{k}_", 11) for k in lags})
    base = base.select(F.coalesce("n_obs", F.lit(0)).alias("n_obs"), safe_div(F.col("_same"), F.col("_n1")).alias("share_unchanged"),
                       *[f"acf_lag{k}" for k in lags], F.lit(0).alias("_one"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))
    ends = cells.groupBy(entity, "_chunk").agg(F.min("_first._change").alias("_f"), F.max("_last._change").alias("_l"))
    earlier = F.lag("_l", 1).over(Window.partitionBy(entity).orderBy("_chunk"))
    across = ends.where(F.col("_f").isNotNull()).select(F.datediff("_f", earlier).alias("gap"), F.lit(1).cast("long").alias("n"))
    gaps = cells.where(F.col("_change_gap").isNotNull()).select(F.col("_change_gap").alias("gap"), F.col("n_obs").alias("n")).unionByName(across)

    def spread(frame, name):   # whole days: few distinct values
        q = {f"{name}_min": 0.0, f"{name}_median": .5, f"{name}_max": 1.0}
        return weighted_quantiles(frame.withColumn("_one", F.lit(0)), ["_one"], "gap", "n", q, bounded=True).drop("n")
    return (base.join(spread(cells.select(F.col("_gap").alias("gap"), F.col("n_obs").alias("n")), "days_between_obs"), "_one", "left")
            .join(spread(gaps, "days_between_changes"), "_one", "left").drop("_one"))


def variance_split(df: DataFrame, entity: str, time: str, field: str, log1p: bool = False,
                   denominator: str | None = None) -> DataFrame:
    """C14. Share of a field's variance between entities, within them over time, and common to a date."""
    require_columns(df, entity, time)
    x = _field(df, field, denominator)
    if log1p:
        x = F.log1p(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))
    d = df.select(F.col(entity).alias("e"), F.col(time).alias("t"), x.alias("x")).where(F.col("x").isNotNull())
    d = with_group_stat(d, ["e"], em=F.avg("x"))
    d = with_group_stat(d, ["t"], tm=F.avg("x"))
    s = d.agg(F.count(F.lit(1)).alias("n_obs"), F.var_samp("x").alias("total_variance"),
              F.var_samp("em").alias("_b"), F.var_samp(F.col("x") - F.col("em")).alias("_w"),
              F.var_samp("tm").alias("_c"))
    total = F.col("total_variance")
    return s.select("n_obs", "total_variance", safe_div(F.col("_b"), total).alias("share_between_entities"),
                    safe_div(F.col("_w"), total).alias("share_within_entities"),
                    safe_div(F.col("_c"), total).alias("share_common_over_time"),
                    F.when(F.col("_b") > F.col("_w"), "mostly differs across entities (cross-sectional)")
                    .otherwise("mostly moves within entities over time").alias("reading"))


# ---------------------------------------------------------------- keys

def key_check(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """C17. Distinct keys, rows sharing a key, exact duplicate rows, rows with a null in the key."""
    require_columns(df, *key)
    def dup(n):
        return F.coalesce(F.sum(F.when(F.col(n) > 1, F.col(n))), F.lit(0))
    has_null = F.lit(False)
    for k in key:
        has_null = has_null | F.col(k).isNull()
    by_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    ks = by_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_keys"),
                    dup("n").alias("rows_with_duplicated_key"),
                    F.coalesce(F.sum(F.when(has_null, F.col("n"))), F.lit(0)).alias("null_in_key_rows"))
    # equal rows have equal hashes, so where no hash comes twice no row does; else the rows themselves are compared
    most = df.groupBy(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (most or 0) > 1:
        exact = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(dup("_n").alias("exact_duplicate_rows"))
    else:
        exact = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("exact_duplicate_rows"))
    out = ks.withColumn("_one", F.lit(0)).join(exact.withColumn("_one", F.lit(0)), "_one").drop("_one")
    return out.withColumn("key_is_unique", F.col("rows_with_duplicated_key") == 0)


def duplicate_examples(df: DataFrame, key: Sequence[str], n: int = 8) -> DataFrame:
    """C17. The first rows that share a key, in key order."""
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    first = dup.orderBy(*key).limit(n).drop("_n")   # n keys cover at least n rows
    same = [df[k].eqNullSafe(first[k]) for k in key]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    rows = df.join(F.broadcast(first), cond, "left_semi")
    return rows.orderBy(*key, *[c for c in df.columns if c not in key]).limit(n)


def redundant_key_columns(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """C18. Per key column: is the key still unique without it (only asked of a key that is unique)."""
    if len(key) < 2:
        raise ValueError("a key of one column has no redundant column")
    def shared(cols):
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    whole = shared(key).select(F.col("most").alias("_whole"), F.lit(0).alias("_one"))
    parts = None
    for c in key:
        p = shared([k for k in key if k != c]).select(F.lit(c).alias("column"), "most", F.lit(0).alias("_one"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.join(F.broadcast(whole), "_one").select(
        "column", (F.col("_whole") <= 1).alias("key_is_unique"),
        ((F.col("_whole") <= 1) & (F.col("most") <= 1)).alias("redundant"))


# ---------------------------------------------------------------- breadth

def entity_lives(df: DataFrame, entity: str, time: str) -> DataFrame:
    d = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    per = d.groupBy(F.col(entity).alias("entity")).agg(F.min(time).alias("first"), F.max(time).alias("last"),
                                                       F.count(F.lit(1)).alias("n"))
    per = per.withColumn("years", F.datediff("last", "first") / 365.25)
    return per.withColumn("obs_per_year", F.col("n") / F.greatest("years", F.lit(1 / 12)))


def entities_per_year(df: DataFrame, entity: str, time: str) -> DataFrame:
    return (df.where(F.col(time).isNotNull()).groupBy(F.year(time).alias("year"), entity).agg(F.lit(1))
            .groupBy("year").agg(F.count(entity).alias("entities")))


def breadth(df: DataFrame, entity: str, time: str) -> DataFrame:
    """C19. Entities, history, lifetimes, observation frequency, and a rule-of-thumb reading of both."""
    require_columns(df, entity, time)
    one = F.lit(0).alias("_one")
    lives = entity_lives(df, entity, time)
    life = lives.agg(F.count(F.lit(1)).alias("n_entities"),
                     share(F.col("years") < 1).alias("under_1y_share")).select("*", one)
    def q(col, name):
        return quantiles(lives.select(col, one), ["_one"], col,
                         {f"{name}_min": 0.0, f"{name}_median": .5, f"{name}_max": 1.0}).drop("n")
    span = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("n_rows")).select(
        F.to_date("lo").alias("history_start"), F.to_date("hi").alias("history_end"),
        F.round(F.datediff("hi", "lo") / 365.25, 2).alias("history_years"), "n_rows", one)
    dates = (df.select(F.to_date(time).alias("d")).where(F.col("d").isNotNull()).distinct()
             .agg(F.count(F.lit(1)).alias("distinct_dates")).select("*", one))
    years = entities_per_year(df, entity, time).agg(
        F.percentile("entities", F.lit(0.5)).alias("entities_per_year_median")).select("*", one)
    out = life
    for part in (span, dates, years, q("years", "lifetime_years"), q("obs_per_year", "obs_per_entity_year")):
        out = out.join(part, "_one", "left")
    def grade(c, lo, hi):
        return F.when(c < lo, "weak").when(c <= hi, "moderate").otherwise("strong")
    return out.drop("_one").withColumns({
        "history_reading": grade(F.col("history_years"), 2, 5),
        "breadth_reading": grade(F.col("entities_per_year_median"), 100, 1000)})


def concentration(df: DataFrame, entity: str, weight: str, top: Sequence[int] = (10, 100), names: int = 10) -> DataFrame:
    """C20. Share of a weight held by the largest entities, and the Herfindahl index."""
    require_columns(df, entity, weight)
    per = (df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).cast("string").alias("entity"))
           .agg(F.coalesce(F.sum(F.col(weight).cast("double")), F.lit(0.0)).alias("w")))
    one = F.lit(0).alias("_one")
    total = per.agg(F.sum("w").alias("_t"), F.sum(F.col("w") * F.col("w")).alias("_t2")).select("*", one)
    largest = per.orderBy(F.desc("w"), F.asc("entity")).limit(max(*top, names))   # a top-k report
    ranked = largest.withColumn("_r", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("w"), F.asc("entity"))))
    tops = ranked.agg(*[F.sum(F.when(F.col("_r") <= k, F.col("w"))).alias(f"_top{k}") for k in top],
                      F.sort_array(F.collect_list(F.when(F.col("_r") <= names, F.struct("_r", "entity"))))
                      .alias("_names")).select("*", one)
    j = total.join(tops, "_one")
    return j.select(*[safe_div(F.col(f"_top{k}"), F.col("_t")).alias(f"top{k}_share") for k in top],
                    safe_div(F.col("_t2"), F.col("_t") * F.col("_t")).alias("hhi"),
                    F.concat_ws(", ", F.transform("_names", lambda x: x["entity"])).alias("top_names"))


# ---------------------------------------------------------------- categories

def category_shares(df: DataFrame, time: str, field: str, freq: str = "M", split_on: str | None = None) -> DataFrame:
    """C21. (period, value, n, share of the period's rows that carry the value); a missing cell is its own text."""
    require_columns(df, time, field)
    d = df.select(period(F.col(time), freq).alias("period"),
                  F.coalesce(F.col(field).cast("string"), F.lit("None")).alias("v"))
    d = d.where(F.col("period").isNotNull())
    cells = d.groupBy("period", "v").agg(F.count(F.lit(1)).alias("n"))   # whole cells first, then their parts
    rows = cells.groupBy("period").agg(F.sum("n").alias("_rows"))
    if split_on:
        parts = F.split("v", F.concat(F.lit(r"\Q"), F.lit(split_on), F.lit(r"\E")))
        cells = (cells.select("period", F.explode(F.transform(parts, F.trim)).alias("v"), "n")
                 .groupBy("period", "v").agg(F.sum("n").alias("n")))
    return cells.join(rows, "period").select("period", F.col("v").alias("value"), "n",
                                             (F.col("n") / F.col("_rows")).alias("share"))


def category_mix(df: DataFrame, time: str, field: str, freq: str = "M", split_on: str | None = None,
                 top: int | None = None) -> DataFrame:
    """C21. Per value: mean share over all periods, first and last period seen, whether it appears after the start or
    is gone before the end.  ``top`` keeps only so many values of the largest mean share."""
    s = category_shares(df, time, field, freq, split_on)
    span = s.agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"),
                 F.count_distinct("period").alias("_n")).withColumn("_one", F.lit(0))
    per = s.groupBy("value").agg(F.sum("share").alias("_s"), F.min("period").alias("first_seen"),
                                 F.max("period").alias("last_seen")).withColumn("_one", F.lit(0))
    out = per.join(F.broadcast(span), "_one").select(
        "value", (F.col("_s") / F.col("_n")).alias("mean_share"), "first_seen", "last_seen",
        (F.col("first_seen") != F.col("_lo")).alias("appears_after_start"),
        (F.col("last_seen") != F.col("_hi")).alias("gone_before_end"),
        F.col("value").rlike("[,;|]").alias("multi_valued"))
    return out.orderBy(F.desc("mean_share"), F.asc("value")).limit(top) if top else out


