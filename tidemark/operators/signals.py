"""Researcher signals and their leaky variants (inventory G1-G4).  A variant changes one line of the clean job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import require_columns, rolling, safe_div
from tidemark.operators.calendar import first_open_after, next_session, roll_forward, to_exchange_time
from tidemark.operators.order import quantiles, small
from tidemark.operators.vintages import end_of_period, releases

EVENT_VARIANTS = ("clean", "transdate", "filingdate", "noclose")
MACRO_VARIANTS = ("clean", "latest", "obsdate", "periodend")
PRESSURE_VARIANTS = ("clean", "sameday", "centered", "fullmean")


def _check(variant: str, known: Sequence[str]) -> None:
    if variant not in known:
        raise ValueError(f"variant must be one of {known}, got {variant!r}")


def event_table(trans: DataFrame, owners: DataFrame, filings: DataFrame, acceptance: DataFrame, cal: DataFrame,
                variant: str = "clean", codes: Sequence[str] = ("P",), roles: str = "Officer|Director",
                forms: Sequence[str] = ("4", "4/A")) -> DataFrame:
    """G1. One row per filing of insider purchases: value, transactions and the session it may first be traded.

    trans: key, code, acquired, shares, price, trans_date; owners: key, relationship; filings: key, issuer,
    filing_date, form; acceptance: key, accepted (UTC).
    """
    _check(variant, EVENT_VARIANTS)
    buys = trans.where(F.col("code").isin(list(codes)) & (F.col("acquired") == "A"))
    insiders = owners.where(F.coalesce("relationship", F.lit("")).rlike(roles)).select("key")
    per = (buys.join(insiders, "key", "left_semi").groupBy("key")
           .agg(F.sum(F.col("shares") * F.col("price")).alias("value"), F.count(F.lit(1)).alias("n_trans"),
                F.min("trans_date").alias("trans_date")))
    ev = per.join(filings.where(F.col("form").isin(list(forms))), "key").join(acceptance, "key")
    ev = ev.withColumn("accepted_et", to_exchange_time(F.col("accepted"), "UTC"))
    if variant == "transdate":
        ev = roll_forward(ev, "trans_date", cal, "asof_date")
    elif variant == "filingdate":
        ev = roll_forward(ev, "filing_date", cal, "asof_date")
    elif variant == "noclose":   # only filings after the close wait for the next session
        ev = next_session(roll_forward(ev, "accepted_et", cal, "_same"), "accepted_et", cal, "_next")
        late = F.hour("accepted_et") >= 16
        ev = ev.withColumn("asof_date", F.when(late, F.col("_next")).otherwise(F.col("_same")))
    else:
        ev = first_open_after(ev, "accepted_et", cal, "asof_date")
    return ev.select("key", "issuer", "asof_date", "value", "n_trans", "trans_date", "filing_date", "accepted_et")


def macro_variants(v: DataFrame, cal: DataFrame, variants: Sequence[str] = MACRO_VARIANTS, start: str | None = None,
                   quarterly: Sequence[str] = ()) -> DataFrame:
    """G2. One row per observation and variant: the value that variant uses and the session it uses it from."""
    for variant in variants:
        _check(variant, MACRO_VARIANTS)
    r = releases(v, start).withColumn("period_end", end_of_period(
        F.col("date"), F.col("series_id").cast("string").isin(list(quarterly))))
    when = {"obsdate": "date", "periodend": "period_end"}
    each = F.array(*[F.struct(F.lit(x).alias("variant"), F.col(when.get(x, "release_date")).alias("_when"),
                              F.col("latest_value" if x == "latest" else "first_value").alias("value")) for x in variants])
    r = r.select("series_id", "date", "release_date", "period_end", F.inline(each))
    return roll_forward(r, "_when", cal, "asof_date").select(
        "variant", "series_id", "date", "asof_date", "value", "release_date", "period_end")


def macro_features(v: DataFrame, cal: DataFrame, variant: str = "clean", start: str | None = None,
                   quarterly: Sequence[str] = ()) -> DataFrame:
    """G2. One row per observation: the value a signal uses and the session it is used from."""
    return macro_variants(v, cal, [variant], start, quarterly).drop("variant")


def top_by_median(df: DataFrame, entity: str, scale: str, n: int, bounded: bool = False) -> DataFrame:
    """The n entities with the largest median scale (ties by name)."""
    q = quantiles(df, [entity], scale, {"median_scale": .5}, bounded=bounded)
    return q.orderBy(F.desc("median_scale"), F.asc(entity)).limit(n).select(entity)


def session_grid(entities: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Every (entity, session): one array of sessions, exploded per entity."""
    days = sessions.agg(F.sort_array(F.collect_set("session"))).scalar()
    return entities.select(key).withColumn("_days", days).select(key, F.explode("_days").alias("date"))


def pressure_reference(df: DataFrame, sessions: DataFrame, formation: tuple[str, str], start: str, end: str,
                       universe_n: int = 500, window: int = 5, history: int = 20, variant: str = "clean") -> DataFrame:
    """G3. symbol, date, value: the average short ratio of the last sessions relative to the symbol's own past.

    df: symbol, date, short_volume, total_volume, one row per symbol and date; so the calendar bounds a symbol.  The
    universe is formed in [formation), the grid covers the sessions in [start, end].
    """
    require_columns(df, "symbol", "date", "short_volume", "total_volume")
    def day(s):
        return F.lit(s).cast("date")
    formed = df.where((F.col("date") >= day(formation[0])) & (F.col("date") < day(formation[1])))
    universe = top_by_median(formed, "symbol", "total_volume", universe_n, bounded=True)
    inside = F.col("date").between(day(start), day(end))
    x = df.where(inside & (F.col("total_volume") > 0)).join(small(universe, universe_n), "symbol", "left_semi").select(
        "symbol", "date", safe_div(F.col("short_volume"), F.col("total_volume")).alias("ratio"))
    days = sessions.where(F.col("session").between(day(start), day(end)))
    g = session_grid(universe, days, "symbol").join(x, ["symbol", "date"], "left")
    past = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("ratio", F.last("ratio", ignorenulls=True).over(past))
    first, last = (-(window // 2), window // 2) if variant == "centered" else (-(window - 1), 0)
    g = g.withColumn("avg", rolling(F.avg, F.col("ratio"), ["symbol"], ["date"], first, last, window))
    if variant == "fullmean":
        own = F.avg("avg").over(Window.partitionBy("symbol"))
    else:
        own = F.when(F.count("avg").over(past) >= history, F.avg("avg").over(past))
    return g.select("symbol", "date", (F.col("avg") - own).alias("value"))


def pressure_signal(df: DataFrame, sessions: DataFrame, cal: DataFrame, formation: tuple[str, str], start: str,
                    end: str, signal_start: str, variant: str = "clean", **windows) -> DataFrame:
    """G3/G4. The signal from ``signal_start`` on, with the session it is used from."""
    _check(variant, PRESSURE_VARIANTS)
    g = pressure_reference(df, sessions, formation, start, end, variant=variant, **windows)
    g = g.where(F.col("value").isNotNull() & (F.col("date") >= F.lit(signal_start).cast("date")))
    step = roll_forward if variant == "sameday" else next_session
    return step(g, "date", cal, "asof_date")
