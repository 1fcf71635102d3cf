"""Attacks on findings: restricted universes, subperiods, added controls, and their verdicts (inventory J21-J23)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_div
from tidemark.operators.order import with_rank
from tidemark.operators.predict import MIN_NAMES, T_BAR, finding_ics
from tidemark.specs import Finding, RobustnessTest

SURVIVE_RETENTION, REFUTE_RETENTION = 0.5, 0.25


def standard_battery(period: tuple[str, str]) -> list[RobustnessTest]:
    """What every finding faces: no illiquid third, no low prices, and each half of the period."""
    a, b = (date.fromisoformat(x) for x in period)
    mid = a + timedelta(days=(b - a).days // 2)
    halves = [(str(a), str(mid)), (str(mid + timedelta(days=1)), str(b))]
    return [RobustnessTest("no_illiquid_third", "restrict_universe", "drop_illiquid_tercile", standard=True),
            RobustnessTest("price_ge_5", "restrict_universe", "price_ge_5", standard=True),
            *[RobustnessTest(f"half_{i + 1}", "subperiod", period=p, standard=True) for i, p in enumerate(halves)]]


def with_universe_ranks(df: DataFrame, bounded: bool = False) -> DataFrame:
    """The same-date ranks the universe restrictions cut on, over the whole frame."""
    d = with_rank(df, ["date"], "dollar_adv", "_adv_pct", bounded=bounded)
    return with_rank(d, ["date"], "size", "_size_pct", bounded=bounded)


def kept(test: RobustnessTest) -> Column:
    """J21. The rows a test keeps; an unknown tercile or price is out, an unknown sector is not the excluded one."""
    if test.kind == "subperiod":
        return F.col("date").between(F.lit(test.period[0]).cast("date"), F.lit(test.period[1]).cast("date"))
    if test.kind != "restrict_universe":
        return F.lit(True)
    rules = {"drop_illiquid_tercile": lambda: F.col("_adv_pct") > 1 / 3, "large_caps": lambda: F.col("_size_pct") > 2 / 3,
             "price_ge_5": lambda: F.col("price") >= 5,
             "exclude_sector": lambda: F.coalesce(F.col("sector") != test.sector, F.lit(True))}
    if test.universe not in rules:
        raise ValueError(f"unknown universe {test.universe!r}; one of {sorted(rules)}")
    return F.coalesce(rules[test.universe](), F.lit(False))


def subset(df: DataFrame, test: RobustnessTest, bounded: bool = False) -> DataFrame:
    """J21."""
    d = with_universe_ranks(df, bounded) if test.kind == "restrict_universe" else df
    return d.where(kept(test)).select(*df.columns)


def verdict(mean_ic: Column, t: Column, claimed: Column) -> tuple[Column, Column]:
    """J23. (retention, outcome): survived with half of the claim and |t| of 2; refuted under a quarter of it."""
    retention = safe_div(mean_ic, claimed)
    sure = F.abs(t) >= T_BAR
    outcome = (F.when(retention.isNull() | t.isNull(), "inconclusive")
               .when(retention < REFUTE_RETENTION, "refuted")
               .when((retention >= SURVIVE_RETENTION) & sure, "survived").otherwise("inconclusive"))
    return retention, outcome


def robustness(df: DataFrame, findings: Sequence[Finding], tests: Sequence[RobustnessTest],
               min_names: int = MIN_NAMES, bounded: bool = False) -> DataFrame:
    """J22/J23. Every finding under every test it faces, one job.

    Standard tests hit every finding; a test with a ``target`` hits that finding, and also the other findings of the
    same feature if it refutes the target (``source`` tells which).
    """
    by_name = {f.name: f for f in findings}
    pairs, info, keep = [], [], {}
    for t in tests:
        for f in findings:
            target = by_name.get(t.target) if t.target else None
            if target is None:
                source = "standard" if t.standard else "critic"
            elif target is f:
                source = "critic"
            elif target.feature == f.feature:
                source = "propagated"
            else:
                continue
            extra = set(t.controls) if t.kind == "add_controls" else set()
            if source == "propagated" and t.kind == "add_controls" and not extra - set(f.controls):
                continue
            pid = f"{f.name}|{t.name}"
            ctrl = tuple(sorted(set(f.controls) | extra))
            pairs.append((pid, f.feature, f.horizon, ctrl))
            keep[pid] = kept(t)
            info.append((pid, f.name, f.feature, t.name, t.target or "", source, ",".join(ctrl), f.claimed_ic))
    d = with_universe_ranks(df, bounded)
    signals, stats = finding_ics(d, pairs, keep, min_names, bounded)
    names = (signals.where(F.col("signal").isNotNull() & F.col("y").isNotNull()).groupBy("test_id", "entity").agg(
        F.lit(1)).groupBy("test_id").agg(F.count(F.lit(1)).alias("names")))
    meta = df.sparkSession.createDataFrame(info, "test_id string, finding string, feature string, test string, "
                                                 "target string, source string, controls string, claimed_ic double")
    out = meta.join(stats.select("test_id", "mean_ic", "t_nw", "n_dates"), "test_id", "left").join(
        names, "test_id", "left")
    retention, outcome = verdict(F.col("mean_ic"), F.col("t_nw"), F.col("claimed_ic"))
    out = out.withColumns({"retention": retention, "outcome": outcome, "names": F.coalesce("names", F.lit(0))})
    hit = out.where((F.col("source") == "critic") & (F.col("outcome") == "refuted")).select(
        "test", F.lit(True).alias("_hit"))   # a few rows per test
    out = out.join(hit.distinct(), "test", "left").where((F.col("source") != "propagated") | F.col("_hit"))
    return out.select("finding", "feature", "test", "source", "controls", "names", "mean_ic", "t_nw", "n_dates",
                      "retention", "outcome")
