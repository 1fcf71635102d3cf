"""Forward returns and point-in-time controls on a dense grid of sessions (inventory J1-J10).

A returns frame has one row per (date, entity): r_oc (open to close), ret (close to close), prc, vol, shrout, mkt, and
optionally bid and ask.  Stays long: one window per entity, bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import require_columns, safe_div, safe_sqrt
from tidemark.specs import HORIZONS, ControlWindows

FLOOR = -0.999999   # a -100% day loses its own window; later windows survive


def _ent() -> Window:
    return Window.partitionBy("entity").orderBy("date")


def _upto() -> Window:
    return _ent().rowsBetween(Window.unboundedPreceding, 0)


def _rows_of(df: DataFrame, entities: DataFrame | None) -> DataFrame:
    return df if entities is None else df.join(entities.select("entity").distinct(), "entity", "left_semi")


def densify(df: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """J1. Every session of the frame (or of ``sessions``, its ``date``) for every entity, from the entity's first row on
    (before it all is missing)."""
    require_columns(df, "date", "entity")
    days = (df if sessions is None else sessions).select("date").distinct().agg(F.sort_array(F.collect_list("date"))).scalar()   # the calendar, one value
    ents = df.groupBy("entity").agg(F.min("date").alias("_first")).withColumn("_days", days)
    grid = ents.select("entity", F.explode(F.filter("_days", lambda d: d >= F.col("_first"))).alias("date"))
    return grid.join(df, ["date", "entity"], "left")


def _log_return(ret: Column) -> Column:
    return F.log1p(F.when(ret.isNotNull(), F.greatest(ret, F.lit(FLOOR))))


def forward_returns(df: DataFrame, horizons: Sequence[int] = HORIZONS, entities: DataFrame | None = None) -> DataFrame:
    """J2/J3. date, entity, fwd_<h>: from the open of the date to the close h-1 sessions later.

    Null when a session inside the window has no return or the window runs past the frame; after an entity's last
    return the proceeds are cash.  Running sums give every horizon from one sort.
    """
    require_columns(df, "date", "entity", "r_oc", "ret")
    g = densify(_rows_of(df, entities).select("date", "entity", "r_oc", "ret"), df)
    last = F.max(F.when(F.col("ret").isNotNull(), F.col("date"))).over(Window.partitionBy("entity"))
    g = g.withColumn("_last", last)
    ret = F.when(F.col("_last").isNull() | (F.col("date") > F.col("_last")), 0.0).otherwise(F.col("ret"))
    g = g.withColumn("_lr", _log_return(ret))
    g = g.withColumns({"_c": F.sum(F.coalesce("_lr", F.lit(0.0))).over(_upto()),
                       "_m": F.sum(F.when(F.col("_lr").isNull(), 1).otherwise(0)).over(_upto())})
    def ahead(h):
        if h == 1:
            return F.col("r_oc")
        whole = F.lead("_m", h - 1).over(_ent()) - F.col("_m") == 0
        later = F.lead("_c", h - 1).over(_ent()) - F.col("_c")
        held = F.when(F.col("r_oc") <= -1, -1.0).otherwise(F.expm1(F.log1p("r_oc") + later))
        return F.when(whole & F.col("r_oc").isNotNull(), held)
    return g.select("date", "entity", *[ahead(h).alias(f"fwd_{h}") for h in horizons])


class _Rolling:
    """Rolling sums and counts as differences of running sums: a long window costs the same as a short one."""

    def __init__(self, df: DataFrame):
        self.df = df

    def add(self, **columns: Column) -> None:
        run = {}
        for name, c in columns.items():
            run[f"_S_{name}"] = F.sum(F.coalesce(c, F.lit(0.0))).over(_upto())
            run[f"_N_{name}"] = F.count(c).over(_upto())
        self.df = self.df.withColumns(run)

    def _diff(self, col: str, w: int) -> Column:
        return F.col(col) - F.coalesce(F.lag(col, w).over(_ent()), F.lit(0))

    def sum(self, name: str, w: int, least: int) -> Column:
        return F.when(self._diff(f"_N_{name}", w) >= least, self._diff(f"_S_{name}", w))

    def mean(self, name: str, w: int, least: int) -> Column:
        n = self._diff(f"_N_{name}", w)
        return F.when(n >= least, safe_div(self._diff(f"_S_{name}", w), n))

    def std(self, name: str, square: str, w: int, least: int) -> Column:
        n = self._diff(f"_N_{name}", w)
        s, ss = self._diff(f"_S_{name}", w), self._diff(f"_S_{square}", w)
        return F.when(n >= least, safe_sqrt(F.greatest(safe_div(ss - safe_div(s * s, n), n - 1), F.lit(0.0))))


def controls(df: DataFrame, windows: ControlWindows = ControlWindows(), entities: DataFrame | None = None) -> DataFrame:
    """J4-J10. date, entity and size, reversal, momentum, beta, dollar_adv, price, vol20, half_spread, spread_quoted,
    each as known at the close of the session before the date.  ``entities`` names those that are asked for; sessions and
    market are the whole frame's all the same."""
    require_columns(df, "date", "entity", "ret", "prc", "vol", "shrout", "mkt")
    quoted = {"bid", "ask"} <= set(df.columns)
    mkt = df.groupBy("date").agg(F.max("mkt").alias("_mkt"))   # the same for every entity of a date
    g = densify(_rows_of(df, entities).drop("mkt"), df).join(mkt, "date", "left")
    ret, prc = F.col("ret"), F.abs("prc")
    mm = F.when(ret.isNotNull(), F.col("_mkt"))
    g = g.withColumns({"_lr": _log_return(ret), "_mm": mm, "_prev": F.lag("ret").over(_ent())})
    r = _Rolling(g)
    r.add(lr=F.col("_lr"), ret=ret, ret2=ret * ret, mm=F.col("_mm"), mm2=F.col("_mm") * F.col("_mm"),
          xy=ret * F.col("_mm"), dv=prc * F.col("vol"), prev=F.col("_prev"), rp=ret * F.col("_prev"))
    b, bm = windows.beta
    cov = r.mean("xy", b, bm) - r.mean("ret", b, bm) * r.mean("mm", b, bm)
    var = r.mean("mm2", b, bm) - r.mean("mm", b, bm) * r.mean("mm", b, bm)
    sw, sm = windows.roll
    serial = r.mean("rp", sw, sm) - r.mean("ret", sw, sm) * r.mean("prev", sw, sm)
    cap, adv = prc * F.col("shrout"), r.mean("dv", *windows.adv)
    cols = {"size": F.when(cap > 0, F.log(cap)), "reversal": F.expm1(r.sum("lr", *windows.reversal)),
            "_mom": F.expm1(r.sum("lr", *windows.momentum)), "beta": F.when(var > 0, cov / var),
            "dollar_adv": F.when(adv > 0, F.log(adv)), "price": prc,
            "vol20": r.std("ret", "ret2", *windows.vol), "half_spread": F.when(serial < 0, safe_sqrt(-serial)),
            "spread_quoted": F.lit(0.0)}
    d = r.df.withColumns(cols)
    if quoted:
        q = F.when((F.col("ask") > F.col("bid")) & (F.col("bid") > 0),
                   safe_div(F.col("ask") - F.col("bid"), F.col("ask") + F.col("bid")))
        w, least = windows.quote
        frame = _ent().rowsBetween(-(w - 1), 0)
        d = d.withColumn("_q", q)
        med = F.when(F.count("_q").over(frame) >= least, F.percentile("_q", F.lit(0.5)).over(frame))
        d = d.withColumn("_qh", med).withColumns({"half_spread": F.coalesce("_qh", "half_spread"),
                                                  "spread_quoted": F.col("_qh").isNotNull().cast("double")})
    names = ["size", "reversal", "beta", "dollar_adv", "price", "vol20", "half_spread", "spread_quoted"]
    skip = windows.momentum_skip + 1
    return d.select("date", "entity", *[F.lag(n, 1).over(_ent()).alias(n) for n in names],
                    F.lag("_mom", skip).over(_ent()).alias("momentum"))
