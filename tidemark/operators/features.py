"""The feature language: thirteen operations on the panel, composed by name (inventory H).

Windows over an entity run over its *records*; a panel has one row per (date, entity), so the calendar bounds them.
Cross-sections are exact for any number of names; ``bounded=True`` says a top-N universe bounds a date's names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, require_columns, rolling, safe_div, sample_skew, share
from tidemark.operators.order import quantiles, with_group_quantile, with_group_stat, with_rank
from tidemark.operators.panel import CATEGORICAL, CONDITIONERS, conditioner
from tidemark.specs import FEATURE_OPS, FeatureSpec

@dataclass(frozen=True)
class Operation:
    """What an operation takes, how it reads in words, and what it removes.

    words: {a} and {b} are the inputs, {w} the window, {g} the group.
    """

    words: str
    arity: int = 1
    windowed: bool = False
    groups: tuple[str | None, ...] = ()    # what its cross-section may be split by; empty: no cross-section
    scale_free: bool = False
    neutral: bool = False                  # removes a dependence on its group


_PEERS = (None, "", "sector")
OPERATIONS = {
    "field": Operation("{a}"),
    "ratio": Operation("{a} / {b}", arity=2, scale_free=True),
    "diff": Operation("{a} - {b}", arity=2),
    "log1p": Operation("log(1 + {a})"),
    "change": Operation("{a} less {a} {w} records earlier", windowed=True),
    "growth": Operation("growth of {a} over {w} records", windowed=True, scale_free=True),
    "surprise": Operation("{a} against its {w} records before, in their standard deviations", windowed=True, scale_free=True),
    "rolling_mean": Operation("average {a}, {w} records", windowed=True),
    "rolling_sum": Operation("total {a}, {w} records", windowed=True),
    "rolling_std": Operation("spread of {a}, {w} records", windowed=True),
    "peer_relative": Operation("{a} above the day's median{g}", groups=_PEERS, neutral=True),
    "rank": Operation("the day's rank of {a}{g}", groups=_PEERS, scale_free=True),
    "residualize": Operation("{a} with the day's effect removed{g}", groups=tuple(CONDITIONERS), neutral=True),
}


def _where(trait: Callable[[Operation], object]) -> tuple[str, ...]:
    return tuple(name for name, op in OPERATIONS.items() if trait(op))


WINDOWED, CROSS_SECTIONAL, NEUTRALIZING = (_where(lambda o: o.windowed), _where(lambda o: o.groups),
                                           _where(lambda o: o.neutral))
NOT_INPUTS = ("date", "entity", "quality_flag", *CATEGORICAL)


def least_records(window: int) -> int:
    return max(2, window // 2)


def _entity_op(op: str, x, w: int):
    ent = Window.partitionBy("entity").orderBy("date")
    by, order = ["entity"], ["date"]
    if op == "change":
        return x - F.lag(x, w).over(ent)
    if op == "growth":
        prev = F.lag(x, w).over(ent)
        return safe_div(x - prev, F.abs(prev))
    if op == "surprise":   # today's value stays out of its own mean
        mean = rolling(F.avg, x, by, order, -w, -1, least_records(w))
        sd = rolling(F.stddev_samp, x, by, order, -w, -1, least_records(w))
        return F.when(sd > 0, (x - mean) / sd)
    agg = {"rolling_mean": F.avg, "rolling_sum": F.sum, "rolling_std": F.stddev_samp}[op]
    return rolling(agg, x, by, order, -(w - 1), 0, least_records(w))


def feature_op(df: DataFrame, op: str, inputs: Sequence[str], name: str, window: int | None = None,
               group: str | None = None, bounded: bool = False) -> DataFrame:
    """H1-H14. Adds one feature to the panel; infinities and NaN become null."""
    if op not in FEATURE_OPS:
        raise ValueError(f"{op!r} is no operation; there are {FEATURE_OPS}")
    require_columns(df, "date", "entity", *inputs)
    x = F.col(inputs[0]).cast("double")
    y = F.col(inputs[1]).cast("double") if len(inputs) > 1 else None
    if op in WINDOWED:
        return df.withColumn(name, finite(_entity_op(op, x, window)))
    if op in CROSS_SECTIONAL:
        return _cross_section(df, op, x, name, group, bounded)
    value = {"field": lambda: x, "ratio": lambda: safe_div(x, y), "diff": lambda: x - y,
             "log1p": lambda: F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))}[op]()
    return df.withColumn(name, finite(value))


def _cross_section(df: DataFrame, op: str, x, name: str, group: str | None, bounded: bool) -> DataFrame:
    keep = df.columns
    d = df.withColumn("_x", finite(x))
    keys = ["date"]
    if group:
        d = d.withColumn("_c", conditioner(group))
        if op != "residualize" or group in CATEGORICAL:
            keys = ["date", "_c"]
    if op == "rank":
        d = with_rank(d, keys, "_x", "_out", bounded=bounded)
    elif op == "peer_relative":
        d = with_group_quantile(d, keys, "_x", bounded=bounded, _med=0.5).withColumn("_out", F.col("_x") - F.col("_med"))
    elif group in CATEGORICAL:
        d = with_group_stat(d, keys, _mean=F.avg("_x")).withColumn("_out", F.when(
            F.col("_c").isNotNull(), F.col("_x") - F.col("_mean")))
    else:
        both = F.col("_x").isNotNull() & F.col("_c").isNotNull()
        a, b = F.when(both, F.col("_x")), F.when(both, F.col("_c"))
        d = with_group_stat(d, ["date"], _mx=F.avg(a), _mc=F.avg(b), _mxc=F.avg(a * b), _mcc=F.avg(b * b))
        var = F.col("_mcc") - F.col("_mc") * F.col("_mc")
        beta = F.when(var > 1e-12 * F.col("_mcc"), (F.col("_mxc") - F.col("_mx") * F.col("_mc")) / var)
        d = d.withColumn("_out", F.when(both, F.col("_x") - F.col("_mx") - beta * (F.col("_c") - F.col("_mc"))))
    return d.select(*[c for c in keep if c != name], finite(F.col("_out")).alias(name))


def formula(s: FeatureSpec) -> str:
    """A spec in words."""
    return OPERATIONS[s.op].words.format(a=s.inputs[0], b=s.inputs[-1], w=s.window, g=f", by {s.group}" if s.group else "")


def lineage(name: str, specs: Mapping[str, FeatureSpec]) -> set[str]:
    """The feature, everything it is built from, down to raw fields."""
    inputs = [i for i in specs[name].inputs if i != name] if name in specs else []
    return {name}.union(*[lineage(i, specs) for i in inputs])


def _name_errors(s: FeatureSpec, specs: Mapping[str, FeatureSpec], columns: set[str]) -> Iterator[str]:
    if re.fullmatch(r"[a-z][a-z0-9_]{1,40}", s.name) is None:
        yield f"{s.name!r} is no feature name: a letter, then 1 to 40 of a-z, 0-9 and _"
    itself = s.op == "field" and tuple(s.inputs) == (s.name,)
    if s.name in columns and not itself:
        yield f"{s.name!r} is a panel column"
    if specs.get(s.name, s) != s:
        yield f"{s.name!r} already names another feature"


def _input_errors(s: FeatureSpec, op: Operation, specs: Mapping[str, FeatureSpec], columns: set[str]) -> Iterator[str]:
    if len(s.inputs) != op.arity:
        yield f"{s.op} takes {op.arity} input(s), not {len(s.inputs)}"
    usable = columns.difference(NOT_INPUTS).union(specs)
    yield from (f"unknown input {i!r}: neither a numeric column nor an earlier feature" for i in s.inputs if i not in usable)
    if s.op == "ratio" and len(s.inputs) == 2:
        over, under = specs.get(s.inputs[0]), s.inputs[1]
        if over and OPERATIONS[over.op].scale_free and under in set(CONDITIONERS) - set(CATEGORICAL):
            yield f"{over.name} is scale-free and would depend on {under} again"


def spec_errors(s: FeatureSpec, specs: Mapping[str, FeatureSpec], columns: Iterable[str]) -> list[str]:
    """What stops a spec from being built on a panel with these columns and these earlier specs."""
    op, columns = OPERATIONS.get(s.op), set(columns)
    if op is None:
        return [f"{s.op!r} is no operation; there are {FEATURE_OPS}"]
    errs = [*_input_errors(s, op, specs, columns), *_name_errors(s, specs, columns)]
    if op.groups and s.group not in op.groups:
        errs.append(f"{s.op} needs a group among {[g for g in op.groups if g]}, not {s.group!r}")
    if op.windowed and not s.window:
        errs.append(f"{s.op} needs a window, in records")
    return errs


def build_order(specs: Sequence[FeatureSpec], names: Sequence[str], columns: Iterable[str]) -> list[FeatureSpec]:
    """The specs the names need, inputs first; among those ready, entity windows before cross-sections, so that
    features with the same partitioning follow each other."""
    by_name = {s.name: s for s in specs}
    needed = set().union(*[lineage(n, by_name) for n in names]) & set(by_name)
    done = set(columns)
    waiting = {n: by_name[n] for n in by_name if n in needed and by_name[n].inputs != (n,)}
    out = []
    while waiting:
        ready = [s for s in waiting.values() if all(i in done for i in s.inputs)]
        if not ready:
            raise ValueError(f"specs form a cycle or lack an input: {sorted(waiting)}")
        ready.sort(key=lambda s: s.op in CROSS_SECTIONAL)
        nxt = [s for s in ready if (s.op in CROSS_SECTIONAL) == (ready[0].op in CROSS_SECTIONAL)]
        for s in nxt:
            out.append(s)
            done.add(s.name)
            del waiting[s.name]
    return out


def build_features(panel: DataFrame, specs: Sequence[FeatureSpec], names: Sequence[str] | None = None,
                   bounded: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """H15. date, entity and the named features, built in dependency order from validated specs."""
    seen: dict[str, FeatureSpec] = {}
    for s in specs:
        errs = spec_errors(s, seen, panel.columns)
        if errs:
            raise ValueError(f"{s.name}: " + "; ".join(errs))
        seen[s.name] = s
    names = list(names or [s.name for s in specs])
    d = panel
    for s in build_order(specs, names, panel.columns):
        d = feature_op(d, s.op, s.inputs, s.name, s.window, s.group, bounded)
    return d.select("date", "entity", *keep, *[finite(F.col(n)).alias(n) for n in names])


def feature_summary(df: DataFrame, x: str) -> DataFrame:
    """H16. Count, coverage, p1 / median / p99, skew, share of zeros and of negatives."""
    d = df.select(F.col(x).cast("double").alias("x")).withColumn("_one", F.lit(0))
    q = quantiles(d, ["_one"], "x", {"p1": .01, "median": .5, "p99": .99}).drop("n")
    known = d.where(F.col("x").isNotNull())
    s = known.groupBy("_one").agg(F.count("x").alias("n"), sample_skew(F.col("x")).alias("skew"),
                                  share(F.col("x") == 0).alias("zero_share"),
                                  share(F.col("x") < 0).alias("negative_share"))
    rows = d.groupBy("_one").agg(F.count(F.lit(1)).alias("_rows"))
    return s.join(q, "_one").join(rows, "_one").withColumn(
        "coverage_share", safe_div(F.col("n"), F.col("_rows"))).drop("_one", "_rows")
