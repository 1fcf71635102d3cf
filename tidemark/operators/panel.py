"""The research panel: one row per (date, entity) with point-in-time conditioners (inventory G5-G10)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import require_columns, safe_div
from tidemark.operators.order import asof_join, record_chunks, small, top_rows
from tidemark.operators.signals import top_by_median
from tidemark.specs import PanelSpec, definition_hash

CONDITIONERS = ("adv_proxy", "size_float", "size_assets", "sector")
CATEGORICAL = ("sector",)
UNKNOWN = "Unknown"


def _between(c: str, lo: str, hi: str) -> Column:
    return F.col(c).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))


def universe(view: DataFrame, spec: PanelSpec, bounded: bool = False) -> DataFrame:
    """G5. The most active entities of the formation window, which ends before the panel starts."""
    if spec.formation[1] >= spec.start:
        raise ValueError("the formation window must end before the panel starts")
    return top_by_median(view.where(_between("decision_time", *spec.formation)), "entity", spec.scale_field,
                         spec.universe_n, bounded)


def liquidity_proxy(view: DataFrame, scale: str, window: int, least: int, tie: tuple[str, ...] = (),
                    bounded: bool = False) -> DataFrame:
    """G6. Adds adv_proxy: mean scale over the entity's last records, up to and including each."""
    order = ["decision_time", "source_time", *tie]
    if bounded:
        d, w, own = view, Window.partitionBy("entity").orderBy(*order), F.lit(True)
    else:
        d, w, own = record_chunks(view, ["entity"], order, window - 1)
    frame = w.rowsBetween(-(window - 1), 0)
    x = F.col(scale).cast("double")
    adv = F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))
    return d.withColumn("adv_proxy", adv).where(own).select(*view.columns, "adv_proxy")


def latest_per_date(view: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """G7. One record per entity and decision date: the one with the latest source time."""
    return top_rows(view, ["entity", "decision_time"], [F.desc("source_time"), *[F.desc(t) for t in tie]], 1)


def asof_value(panel: DataFrame, facts: DataFrame, item: str, out: str, id_col: str = "cik") -> DataFrame:
    """G8. Latest positive value of an item filed strictly before each date; of values filed together, the one for the
    latest period end."""
    require_columns(facts, id_col, "item", "end", "filed", "val")
    f = facts.where((F.col("item") == item) & (F.col("val") > 0)).select(
        id_col, F.date_add("filed", 1).alias("_avail"), "end", F.col("val").alias(out))
    return asof_join(panel, f, id_col, "date", "_avail", [out], ["end", out])


SIZES = {"size_float": "public_float", "size_assets": "assets"}


def build_panel(view: DataFrame, spec: PanelSpec, values: tuple[str, ...], symbols: DataFrame,
                facts: DataFrame | None = None, sizes: Mapping[str, str] = SIZES, tie: tuple[str, ...] = (),
                bounded: bool = False) -> DataFrame:
    """G9. The panel of the universe over the spec's dates: values, quality flag, liquidity, sector and sizes.

    The universe has at most ``spec.universe_n`` names, which bounds every date's cross-section.
    ``bounded`` says the view has one record per entity and source time.
    """
    require_columns(view, "entity", "decision_time", "source_time", spec.scale_field, *values)
    names = universe(view, spec, bounded)
    v = view.join(small(names, spec.universe_n), "entity", "left_semi")
    v = liquidity_proxy(v, spec.scale_field, spec.adv_window, spec.adv_min, tie, bounded)   # warm-up counts
    v = latest_per_date(v.where(_between("decision_time", spec.start, spec.end)), tie)
    p = v.select(F.col("decision_time").alias("date"), "entity", *values, "quality_flag", "adv_proxy")
    sym = top_rows(symbols.select("entity", "cik", "sector"), ["entity"], [F.asc("cik"), F.asc("sector")], 1)
    p = p.join(sym, "entity", "left").withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN)))
    for out, item in (sizes if facts is not None else {}).items():
        p = asof_value(p, facts, item, out)
    return p.drop("cik")


def panel_meta(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """G9. One row that names the panel: its sizes and the hash of its definition."""
    return panel.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_dates"),
                     F.count_distinct("entity").alias("n_entities")).withColumns(
        {"start": F.lit(spec.start), "end": F.lit(spec.end), "universe_n": F.lit(spec.universe_n),
         "hash": F.lit(definition_hash(spec))})


def describe_panel(panel: DataFrame) -> DataFrame:
    """G10. Rows, dates, entities, range, and the coverage of each conditioner (one row)."""
    cells = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.when((F.col(c) != UNKNOWN) if c in CATEGORICAL else F.col(c).isNotNull(), 1).otherwise(0)).alias(c)
        for c in CONDITIONERS])
    ents = panel.select("entity").distinct().agg(F.count(F.lit(1)).alias("entities")).withColumn("_one", F.lit(0))
    d = cells.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("dates"), F.min("date").alias("first_date"),
                  F.max("date").alias("last_date"),
                  *[safe_div(F.sum(c), F.sum("n")).alias(f"{c}_coverage") for c in CONDITIONERS])
    return d.withColumn("_one", F.lit(0)).join(ents, "_one").drop("_one")


def entities_per_sector(panel: DataFrame) -> DataFrame:
    """G10."""
    return panel.select("entity", "sector").distinct().groupBy("sector").agg(F.count(F.lit(1)).alias("entities"))


def conditioner(name: str) -> Column:
    """A conditioner made comparable: the log of a positive size or liquidity, a sector that is known."""
    if name in CATEGORICAL:
        return F.nullif(F.col(name), F.lit(UNKNOWN))
    c = F.col(name).cast("double")
    return F.when(c > 0, F.log(c))

