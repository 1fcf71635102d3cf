"""Order statistics, as-of joins and record windows that survive one group holding most of the rows.

A window partitioned by a key sends every row of a key to one task.  That is fine where a key's rows are bounded (one
row per entity and date), and is what the panel operators do.  Everything here is for keys whose rows are *not*
bounded: ``scan`` deals their order to ranges, one task each, and carries from range to range what they hand on.  Results
are exact whatever the ranges; ``ranges`` says how many, by default the bytes do.

``bounded=True`` says that a group's ordered items are bounded by construction (sessions of a calendar, names of a
top-N universe, distinct day counts); the plain window or aggregate is then enough and cheaper.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import require_columns
from tidemark.operators.scan import last_known, running_totals

SKETCH = 2_000   # accuracy of the sketch that brackets quantiles: a rank is off by n / SKETCH at most
BRACKET = 3      # a bracket reaches that many times as far


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """No keys means one group: the constant key is split like any hot key."""
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Broadcasts a frame known to have at most ``rows`` rows if that is few enough; else AQE decides by size."""
    return F.broadcast(df) if rows <= most else df


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    return left.join(right, list(keys), how)


def ordered_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column | None = None,
                   ranges: int | None = None, bounded: bool = False) -> DataFrame:
    """Adds ``before`` (weight of the rows earlier in the group's order) and ``total`` (weight of the group).

    Rows with a null key are dropped, as a grouping does in the reference semantics.  ``order`` should identify a row
    within its group; a weight is a count.
    """
    added = [] if keys else ["_all"]
    base, keys = _keyed(df, keys)
    if not bounded:
        return running_totals(base, keys, order, weight, ranges).drop(*added)
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    w = Window.partitionBy(*keys)
    wt = F.lit(1) if weight is None else weight
    upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return base.withColumns({"before": F.coalesce(F.sum(wt).over(upto), F.lit(0)),
                             "total": F.sum(wt).over(w)}).drop(*added)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos",
              ranges: int | None = None, bounded: bool = False) -> DataFrame:
    """Zero-based position of each row in its group's order (``out``), and the group's size (``group_n``)."""
    p = ordered_prefix(df, keys, order, ranges=ranges, bounded=bounded)
    return p.withColumnsRenamed({"before": out, "total": "group_n"})


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None,
                bounded: bool = False) -> DataFrame:
    """One row per distinct known value of a group: ``_ties``, ``_before`` (smaller rows), ``_total``, and the average
    rank ``_rank`` and percentile rank ``_pct`` of the tied rows.  Heavy ties are counted before any ordering."""
    d = (df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties")))
    p = ordered_prefix(d, keys, [value], F.col("_ties"), ranges, bounded).withColumnsRenamed(
        {"before": "_before", "total": "_total"})
    rank = F.col("_before") + (F.col("_ties") + 1) / 2
    return p.withColumn("_rank", rank).withColumn("_pct", rank / F.col("_total"))


def _window_rank(keys: Sequence[str], value: str, measure: str) -> Column:
    """Average (percentile) rank among the known values of a bounded group."""
    known = F.col(value).isNotNull()
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    nulls_last = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    rank = nulls_last + (ties - 1) / 2
    if measure == "pct":
        rank = rank / F.count(value).over(w)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, rank)


def with_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, measure: str = "pct",
              ranges: int | None = None, bounded: bool = False) -> DataFrame:
    """Adds the same-group rank of a value (null where the value or a key is null)."""
    if bounded:
        return df.withColumn(out, _window_rank(keys, value, measure))
    r = value_ranks(df, keys, value, ranges).select(*keys, value, F.col("_" + measure).alias(out))
    return _join(df, r, [*keys, value])


def rank_columns(df: DataFrame, keys: Sequence[str], values: Sequence[str], measure: str = "pct",
                 suffix: str = "_rank", row_id: Sequence[str] = ("date", "entity"),
                 ranges: int | None = None, bounded: bool = False) -> DataFrame:
    """Same-group ranks of several columns in one pass: long form, one ranking, back to wide on the row id."""
    if bounded:
        return df.withColumns({v + suffix: _window_rank(keys, v, measure) for v in values})
    row_id = list(dict.fromkeys([*row_id, *keys]))
    long = df.select(*row_id, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        row_id, list(values), "_col", "_val").where(F.col("_val").isNotNull())
    r = value_ranks(long, ["_col", *keys], "_val", ranges).select("_col", *keys, "_val", F.col("_" + measure).alias("_m"))
    ranked = _join(long, r, ["_col", *keys, "_val"], "inner")
    wide = ranked.groupBy(*row_id).agg(
        *[F.max(F.when(F.col("_col") == v, F.col("_m"))).alias(v + suffix) for v in values])
    return _join(df, wide, row_id)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              ranges: int | None = None, bounded: bool = False) -> DataFrame:
    """Exact, linearly interpolated quantiles per group (names -> probabilities), plus ``n`` known values.

    The values are not ordered.  A mergeable sketch brackets each quantile; a second pass counts what lies below and
    keeps distinct values inside the brackets only, and these few are ordered.  The built-in aggregate, which keeps every
    distinct value of a group in memory, serves the bounded case.
    """
    base, ks = _keyed(df, keys)
    for k in ks:
        base = base.where(F.col(k).isNotNull())
    v = F.col(value).cast("double")
    if bounded:
        g = base.groupBy(*ks).agg(F.count(value).alias("n"),
                                  *[F.percentile(v, F.lit(float(q))).alias(n) for n, q in probs.items()])
        return g.where(F.col("n") > 0).select(*keys, "n", *probs)
    base = base.select(*ks, v.alias("__v")).where(F.col("__v").isNotNull())
    cells = _bracketed(base, ks, sorted(set(probs.values())), ranges)
    out = pick_quantiles(cells, ks, "__v", probs)
    # the sketch's error is bounded, so this cannot be; a wrong number must not come out all the same
    missed = F.exists(F.array(*probs), F.isnull)
    sure = F.when(missed, F.raise_error(F.lit("a quantile lies outside the bracket of its sketch"))).otherwise(F.col("n"))
    return out.select(*keys, sure.alias("n"), *probs)


def _bracketed(base: DataFrame, keys: Sequence[str], probs: Sequence[float], ranges: int | None) -> DataFrame:
    """Distinct values inside the brackets of some quantiles, and one row (null) for all values of each gap between them,
    with ``_ties``, ``_before`` and ``_total``."""
    lows, highs = [max(0.0, q - BRACKET / SKETCH) for q in probs], [min(1.0, q + BRACKET / SKETCH) for q in probs]
    found = base.groupBy(*keys).agg(F.percentile_approx("__v", [*lows, *highs], SKETCH).alias("__s"), F.count(F.lit(1)).alias("__n"))
    # a group of few values is bracketed as a whole: there the bracket is less than a rank wide
    at = lambda i, whole, end: F.when(F.lit(whole) | (F.col("__n") <= SKETCH), F.lit(end)).otherwise(F.get("__s", F.lit(i)))
    found = found.select(*keys, *(at(i, q == 0, float("-inf")).alias(f"__lo{i}") for i, q in enumerate(lows)),
                         *(at(i + len(lows), q == 1, float("nan")).alias(f"__hi{i}") for i, q in enumerate(highs)))
    rows = _join(base, found, keys, "inner")
    past_low = reduce(add, ((F.col(f"__lo{i}") <= F.col("__v")).cast("int") for i in range(len(probs))))
    past_high = reduce(add, ((F.col(f"__hi{i}") < F.col("__v")).cast("int") for i in range(len(probs))))
    rows = rows.select(*keys, (past_low + past_high).alias("__cell"), F.when(past_low > past_high, F.col("__v")).alias("__v"))
    counts = rows.groupBy(*keys, "__cell", "__v").agg(F.count(F.lit(1)).alias("_ties"))
    p = running_totals(counts, keys, ["__cell", "__v"], F.col("_ties"), ranges)
    return p.withColumnsRenamed({"before": "_before", "total": "_total"})


def pick_quantiles(p: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from distinct values that carry ``_before``, their weight ``_ties`` and the group's ``_total``."""
    v = F.col(value).cast("double")
    aggs = [F.max("_total").alias("n")]
    for name, q in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(q))
        def at(i):
            return F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_ties")), v))
        aggs += [at(F.floor(h)).alias(f"_{name}_lo"), at(F.ceil(h)).alias(f"_{name}_hi"),
                 F.max(h - F.floor(h)).alias(f"_{name}_f")]
    cols = [(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in probs]
    return p.groupBy(*keys).agg(*aggs).select(*keys, "n", *cols)


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, probs: dict[str, float],
                       bounded: bool = False) -> DataFrame:
    """Quantiles of values that stand for ``weight`` rows each (counts aggregated beforehand)."""
    base, ks = _keyed(df, keys)
    d = base.where(F.col(value).isNotNull()).groupBy(*ks, value).agg(F.sum(weight).alias("_ties"))
    p = ordered_prefix(d, ks, [value], F.col("_ties"), bounded=bounded).withColumnsRenamed(
        {"before": "_before", "total": "_total"})
    return pick_quantiles(p, ks, value, probs).select(*keys, "n", *probs)


def with_group_stat(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Adds group aggregates to every row: partial aggregation, then a join AQE may broadcast or split.  A window over
    the group would hold it in one task."""
    return _join(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


def with_group_quantile(df: DataFrame, keys: Sequence[str], value: str, bounded: bool = False,
                        **probs: float) -> DataFrame:
    return _join(df, quantiles(df, keys, value, probs, bounded=bounded).drop("n"), keys)


def record_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int,
                  chunk_rows: int = 1_000_000, ranges: int | None = None) -> tuple[DataFrame, Window, Column]:
    """Cuts each group's records into chunks that also hold the ``back`` records before them.

    Returns (frame, window, own): window functions over ``window`` that look at most ``back`` records back are exact
    on the rows where ``own`` is true; filter on it afterwards.
    """
    p = positions(df, keys, order, "_pos", ranges)
    chunk = F.floor(F.col("_pos") / chunk_rows)
    last = (F.col("group_n") - 1) / chunk_rows
    spill = (F.col("_pos") % chunk_rows >= chunk_rows - back) & (chunk < F.floor(last))
    p = p.withColumn("_chunk", F.explode(F.when(spill, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    p = p.withColumn("_own", F.col("_chunk") == chunk)
    return p, Window.partitionBy(*keys, "_chunk").orderBy("_pos"), F.col("_own")


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str] | str, left_time: str, right_time: str,
              values: Sequence[str], tie: Sequence[str] = (), how: str = "left", prefix: str = "",
              ranges: int | None = None) -> DataFrame:
    """For each left row the values of the latest right row with ``right_time <= left_time`` and the same key.

    Only the distinct (key, time) points of both sides are ordered.  A key's dates are bounded by the calendar and go
    through one window; its timestamps are not, and go through a scan that carries the last value from range to range.
    Several right rows at one time are settled by the largest ``tie``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(left, *keys, left_time)
    require_columns(right, *keys, right_time, *values)
    daily = all(isinstance(d.schema[t].dataType, T.DateType) for d, t in ((left, left_time), (right, right_time)))
    kind = "date" if daily else "timestamp"
    payload = F.struct(*[F.col(v) for v in values])
    rank = F.struct(*[F.col(t) for t in (tie or values)])
    points = (left.where(F.col(left_time).isNotNull())
              .select(*keys, F.col(left_time).cast(kind).alias("_t")).distinct()
              .withColumns({"_v": F.lit(None).cast(right.select(payload.alias("v")).schema["v"].dataType),
                            "_side": F.lit(1)}))
    facts = (right.where(F.col(right_time).isNotNull())
             .groupBy(*keys, F.col(right_time).cast(kind).alias("_t")).agg(F.max_by(payload, rank).alias("_v"))
             .withColumn("_side", F.lit(0)))
    both = points.unionByName(facts)
    if daily:   # one point and one fact per key and day
        upto = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(upto))
    else:
        both = last_known(both, keys, ["_t", "_side"], "_v", "_hit", ranges).drop("_v").withColumnRenamed("_hit", "_v")
    hit = both.where(F.col("_side") == 1)
    hit = hit.select(*keys, F.col("_t").alias("_pt"), "_v")
    if how == "inner":
        hit = hit.where(F.col("_v").isNotNull())
    probe = left.withColumn("_pt", F.col(left_time).cast(kind))
    out = _join(probe, hit, [*keys, "_pt"], how)
    return out.select(*left.columns, *[F.col("_v")[v].alias(prefix + v) for v in values])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group.  Spark limits each group before the shuffle, so hot groups stay small (for n up
    to spark.sql.optimizer.windowGroupLimitThreshold, 1000 by default)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
