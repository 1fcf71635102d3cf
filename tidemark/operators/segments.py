"""Segment-cut frames: features, conditioners, controls and forward returns of one segment (inventory L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pit import dated_link
from tidemark.operators.returns import controls, forward_returns
from tidemark.specs import HORIZONS, ControlWindows, Split

EMBARGO_SESSIONS = 20


def split_errors(split: Split, sessions: DataFrame, embargo: int = EMBARGO_SESSIONS) -> DataFrame:
    """L1. One row per boundary: the sessions strictly between two segments and whether they are enough."""
    spark = sessions.sparkSession
    order = [("discovery", "validation"), ("validation", "test")]
    rows = [(a, b, split.bounds(a)[1], split.bounds(b)[0]) for a, b in order]
    for name in ("discovery", "validation", "test"):
        lo, hi = split.bounds(name)
        if lo > hi:
            raise ValueError(f"segment {name} ends before it starts")
    gaps = spark.createDataFrame(rows, "before string, after string, ends string, starts string")
    g = gaps.withColumn("_days", sessions.agg(F.sort_array(F.collect_set("session"))).scalar())
    between = F.size(F.filter("_days", lambda d: (d > F.col("ends").cast("date")) & (d < F.col("starts").cast("date"))))
    return g.select("before", "after", between.cast("long").alias("gap_sessions"),
                    ((F.col("starts") > F.col("ends")) & (between >= embargo)).alias("ok"))


def segment_frame(features: DataFrame, conditioners: DataFrame, returns: DataFrame, split: Split, segment: str,
                  link: DataFrame | None = None, names: DataFrame | None = None, horizons=HORIZONS,
                  windows: ControlWindows = ControlWindows()) -> DataFrame:
    """L1. One segment's rows with everything a test needs and nothing from after the segment.

    Returns are cut at the segment's end before any window: forward returns come from the segment only, controls from
    all history up to its end.  ``link`` is a daily identifier file (and ``names`` its ranges) that maps a feature's
    entity to the returns' entity by date.
    """
    lo, hi = (F.lit(d).cast("date") for d in split.bounds(segment))
    hist = returns.where(F.col("date") <= hi)
    f = features.where(F.col("date").between(lo, hi))
    if link is not None:
        f = f.join(dated_link(f.select("date", "entity"), link, names), ["date", "entity"], "left")
    else:
        f = f.withColumn("rid", F.col("entity"))
    # windows over the entities that the features ask about, not over all that have returns
    asked = f.select(F.col("rid").alias("entity")).where(F.col("entity").isNotNull()).distinct()
    fwd = forward_returns(hist.where(F.col("date") >= lo), horizons, asked).withColumnRenamed("entity", "rid")
    ctl = controls(hist, windows, asked).where(F.col("date") >= lo).withColumnRenamed("entity", "rid")
    extra = [c for c in conditioners.columns if c not in f.columns]
    d = f.join(conditioners.select("date", "entity", *extra), ["date", "entity"], "left")
    return d.join(ctl, ["date", "rid"], "left").join(fwd, ["date", "rid"], "left")


def segment_coverage(df: DataFrame) -> DataFrame:
    """L2. Rows, dates, entities, share linked, share with a return, range."""
    ents = df.select("entity").distinct().agg(F.count(F.lit(1)).alias("entities")).withColumn("_one", F.lit(0))
    d = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count("rid").alias("linked"),
                               F.count("fwd_1").alias("with_return"))
    s = d.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("dates"),
              (F.sum("linked") / F.sum("n")).alias("share_linked"),
              (F.sum("with_return") / F.sum("n")).alias("share_with_return"), F.min("date").alias("first_date"),
              F.max("date").alias("last_date")).withColumn("_one", F.lit(0))
    return s.join(ents, "_one").drop("_one")
