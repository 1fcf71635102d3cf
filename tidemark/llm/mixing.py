"""Mixing sources to target weights: a curriculum whose source weights change over training time.

Targets: the sources share all words by weight; a source stops at ``MOST`` times its own words and the rest is shared again
(the fixed point is found in closed form over one row per source).  Which documents are taken one time more than the others
follows from their place in the source: documents are dealt to ``SLOTS`` slots by a hash of their id, and the words before
each slot say where the source's demand ends.  A source's weight schedule over training time is integrated; inverting the
cumulative demand gives each taken copy its training position, and copies are range-sorted by it.

All groups are combined on the map side; a source, however large, is never gathered or ordered in one task.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a document of size 0 takes 0
words; without words all targets are 0; repeated rows are documents of their own that share a place; a null id has one too.
Rows with equal positions are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import broadcast_checked, fresh, text_of, words_of
from tidemark.session import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SLOTS = 512
#: Weight over training time, at equally spaced points from 0 to 1, for the sources of each entry of WEIGHTS in turn: heavy
#: sources fade, middle ones stay level, light ones come in late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.25, 1.0, 1.75))


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def place_of(doc_id: Column) -> Column:
    """A number in [0, 2^32) that only the id decides."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary")), 1, 8), 16, 10).cast("long")


def _slot(place: Column) -> Column:
    return F.floor(place / (2**32 // SLOTS)).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """A row per source: source, source_size, rank, weight, target, and ``before``, the words before each slot and in all.

    sizes: source, place, size.  The windows below run over one row per source, and over at most SLOTS rows of a source.
    """
    slots = sizes.groupBy("source", _slot(F.col("place")).alias("slot")).agg(F.sum("size").alias("words"))
    per = slots.groupBy("source").agg(F.sum("words").alias("source_size"), F.map_from_entries(F.collect_list(F.struct("slot", "words"))).alias("m"))
    found = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    per = per.withColumn("each", found).withColumn("before", F.aggregate("each", F.array(F.lit(0).cast("long")),
                                                                          lambda a, w: F.array_append(a, F.element_at(a, -1) + w)))
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.select("source", "source_size", "before", (F.row_number().over(ordered) - 1).alias("rank"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    # by how soon a source stops: those before a source have stopped when its own share is found
    everything, stops = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    earlier = stops.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("gone", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * MOST)
           .withColumn("left", F.col("weights") - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    level = (F.col("total") - F.col("gone")) / F.col("left")
    per = per.withColumn("own", F.when(MOST * F.col("source_size") > level * F.col("weight"), level))
    per = per.withColumn("level", F.max("own").over(everything))
    cap = (F.col("source_size") * MOST).cast("double")
    return per.select("source", "source_size", "rank", "weight", "before",
                      F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))


def _time(share: Column, rank: Column) -> Column:
    """Training time in [0, 1] at which the integrated schedule has asked for ``share`` of the source's demand."""
    out = F.lit(0.0)
    for k, knots in enumerate(SCHEDULES):
        step, reached = 1.0 / (len(knots) - 1), 0.0
        areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False)]
        time = F.lit(1.0)
        for i in reversed(range(len(areas))):
            reached = sum(areas[:i]) / sum(areas)
            need = F.greatest((share - F.lit(reached)) * sum(areas), F.lit(0.0))
            slope = (knots[i + 1] - knots[i]) / step
            # need = w t + slope t^2 / 2, solved without cancellation
            t = 2 * need / (F.lit(knots[i]) + F.sqrt(F.greatest(F.lit(knots[i] ** 2) + 2 * slope * need, F.lit(0.0))))
            piece = i * step + F.least(t, F.lit(step))
            time = piece if i == len(areas) - 1 else F.when(share < F.lit(sum(areas[: i + 1]) / sum(areas)), piece).otherwise(time)
        out = F.when(rank % len(SCHEDULES) == k, time).otherwise(out)
    return out


def planned(docs: DataFrame, size: str) -> DataFrame:
    """Every row of docs (``size``: its column of words) with source size, target, copies and positions (a training time in
    [0, 1] for each copy) in four more columns.  The rows are not shuffled: what joins is one row per source."""
    names = {n: fresh(docs, f"mix_{n}") for n in ("source_size", "target", "copies", "positions", "place", "on")}
    rows = docs.withColumn(names["place"], place_of(F.col("doc_id")))
    per = cut(targets(rows.select("source", F.col(names["place"]).alias("place"), F.col(f"`{size}`").alias("size"))))
    per = broadcast_checked(per.select(F.struct("source", "source_size", "rank", "before", "target").alias(names["on"])), 8 * SLOTS + 200)
    rows = rows.join(per, F.col("source").eqNullSafe(F.col(names["on"])["source"]), "left")
    on, place = F.col(names["on"]), F.col(names["place"])
    asked = F.coalesce(on["target"] / F.nullif(on["source_size"], F.lit(0)), F.lit(0.0))
    whole = F.floor(asked + 1e-9)
    slot = _slot(place)
    start, end = F.element_at(on["before"], slot + 1), F.element_at(on["before"], slot + 2)
    # one more for the slots whose middle lies before the end of the demand
    extra = ((start + end) / 2 <= (asked - whole) * on["source_size"]) & (asked - whole > 1e-9)
    copies = F.least(F.lit(MOST).cast("long"), whole + F.when(extra, 1).otherwise(0))
    inside = (place % (2**32 // SLOTS)) / F.lit(float(2**32 // SLOTS))
    reached = F.coalesce((start + (end - start) * inside) / F.nullif(on["source_size"], F.lit(0)), F.lit(0.0))
    # copies of a document are a round of the source apart; the demand is spread over all rounds
    rounds = F.greatest(asked, F.lit(1e-9))
    times = F.transform(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>")),
                        lambda k: _time(F.least((k + reached) / rounds, F.lit(1.0)), on["rank"]))
    taken = F.col(f"`{size}`") > 0
    return rows.select(*(f"`{c}`" for c in docs.columns), on["source_size"].alias(names["source_size"]), on["target"].alias(names["target"]),
                       F.when(taken, copies).otherwise(F.lit(0)).cast("long").alias(names["copies"]),
                       F.when(taken, times).otherwise(F.array().cast("array<double>")).alias(names["positions"]))


def curriculum(docs: DataFrame) -> DataFrame:
    """The documents in training order: a row for each copy taken, range-sorted by training position, with docs' own columns."""
    size = fresh(docs, "mix_size")
    plan = planned(docs.withColumn(size, size_of(text_of())), size)
    position = fresh(plan, "position")
    rows = plan.withColumn(position, F.explode(plan.columns[-1]))
    return rows.orderBy(position, "doc_id").select(*(f"`{c}`" for c in docs.columns))


def mixture(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken and positions, range-sorted by the first position
    (documents that are not taken come last)."""
    sizes = cut(docs.select("doc_id", "source", size_of(text_of()).alias("size")))
    plan = planned(sizes, "size")
    source_size, target, copies, positions = plan.columns[-4:]
    out = plan.select("doc_id", "size", F.col(source_size).alias("source_size"), F.col(target).alias("target"),
                      (F.col(copies) * F.col("size")).alias("taken"), F.col(positions).alias("positions"))
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
