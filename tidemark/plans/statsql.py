"""Check SQL of the panel statistics: features, returns, controls, rank correlations and Newey-West."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.plans.bindings import HORIZONS, SPLIT
from tidemark.plans.registry import RELATIONS, r

RELATIONS["feat0"] = """
  SELECT date, entity, sector, qty, px, n, adv_proxy, px / nullif(qty, 0) AS unit_price,
         qty / nullif(adv_proxy, 0) AS qty_load, nullif(sector, 'Unknown') AS known_sector,
         CASE WHEN adv_proxy > 0 THEN ln(adv_proxy) END AS ladv,
         CASE WHEN count(qty) OVER w >= 3 AND stddev_samp(qty) OVER w > 0
              THEN (qty - avg(qty) OVER w) / stddev_samp(qty) OVER w END AS qty_surprise
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"""
RELATIONS["feat1"] = """
  SELECT *, (unit_price - lag(unit_price, 3) OVER e) / nullif(abs(lag(unit_price, 3) OVER e), 0) AS price_growth,
         CASE WHEN known_sector IS NOT NULL THEN
           unit_price - quantile_cont(unit_price, 0.5) OVER (PARTITION BY date, known_sector) END AS price_rel,
         qty - regr_avgy(qty, ladv) OVER d - regr_slope(qty, ladv) OVER d * (ladv - regr_avgx(qty, ladv) OVER d) AS qty_resid,
         (rank() OVER (PARTITION BY date ORDER BY n) + (count(*) OVER (PARTITION BY date, n) - 1) / 2)
           / count(n) OVER d AS n_rank
  FROM feat0 WINDOW e AS (PARTITION BY entity ORDER BY date), d AS (PARTITION BY date)"""
FEATURES = ("qty_surprise", "price_growth", "qty_load", "price_rel", "qty_resid", "n_rank")
RELATIONS["feats"] = "SELECT date, entity, " + ", ".join(
    f"round(CASE WHEN isnan({f}) THEN NULL ELSE {f} END, 9) AS {f}" for f in FEATURES) + " FROM feat1"


def forward_sql(hist: str, horizons: Sequence[int] = HORIZONS) -> str:
    """Forward returns of a returns relation, straight from the definition."""
    cols = []
    for h in horizons:
        if h == 1:
            cols.append("r_oc AS fwd_1")
        else:
            frame = f"(PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h - 1} FOLLOWING)"
            cols.append(f"CASE WHEN count(lr) OVER {frame} = {h - 1} AND r_oc IS NOT NULL "
                        f"THEN exp(ln(1 + r_oc) + sum(lr) OVER {frame}) - 1 END AS fwd_{h}")
    return f"""SELECT date, entity, {', '.join(cols)} FROM (
  SELECT *, ln(1 + greatest(CASE WHEN lastr IS NULL OR date > lastr THEN 0 ELSE ret END, -0.999999)) *
    CASE WHEN lastr IS NOT NULL AND date <= lastr AND ret IS NULL THEN NULL ELSE 1 END AS lr
  FROM (SELECT g.date, g.entity, h.ret, h.r_oc, max(CASE WHEN h.ret IS NOT NULL THEN g.date END) OVER (PARTITION BY g.entity) AS lastr
    FROM (SELECT entity, date FROM (SELECT entity, min(date) AS f FROM {hist} GROUP BY 1),
      (SELECT DISTINCT date FROM {hist}) WHERE date >= f) g LEFT JOIN {hist} h ON g.entity = h.entity AND g.date = h.date))"""


def controls_sql(hist: str, quoted: bool = False) -> str:
    """The bindings' control windows, as sliding frames."""
    def w(k):
        return f"(PARTITION BY entity ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    def mean(c, k, least):
        return f"CASE WHEN count({c}) OVER {w(k)} >= {least} THEN avg({c}) OVER {w(k)} END"
    def total(c, k, least):
        return f"CASE WHEN count({c}) OVER {w(k)} >= {least} THEN sum({c}) OVER {w(k)} END"
    quote = ""
    if quoted:
        quote = (f", CASE WHEN count(q) OVER {w(6)} >= 3 THEN quantile_cont(q, 0.5) OVER {w(6)} END AS qh")
    half = "CASE WHEN serial < 0 THEN sqrt(-serial) END"
    return f"""SELECT date, entity, lag(sz) OVER e AS size, lag(rev) OVER e AS reversal, lag(mom, 3) OVER e AS momentum,
  lag(bt) OVER e AS beta, lag(CASE WHEN dv > 0 THEN ln(dv) END) OVER e AS dollar_adv, lag(prc) OVER e AS price,
  lag(v20) OVER e AS vol20, lag({f'coalesce(qh, {half})' if quoted else half}) OVER e AS half_spread,
  lag({'CAST(qh IS NOT NULL AS DOUBLE)' if quoted else '0.0::DOUBLE'}) OVER e AS spread_quoted
FROM (SELECT *, CASE WHEN prc * shrout > 0 THEN ln(prc * shrout) END AS sz, exp({total('lr', 3, 2)}) - 1 AS rev,
    exp({total('lr', 12, 8)}) - 1 AS mom,
    ({mean('xy', 24, 12)} - {mean('ret', 24, 12)} * {mean('mm', 24, 12)})
      / nullif({mean('mm2', 24, 12)} - {mean('mm', 24, 12)} * {mean('mm', 24, 12)}, 0) AS bt,
    {mean('pv', 6, 3)} AS dv, CASE WHEN count(ret) OVER {w(6)} >= 3 THEN stddev_samp(ret) OVER {w(6)} END AS v20,
    {mean('rp', 18, 12)} - {mean('ret', 18, 12)} * {mean('prev', 18, 12)} AS serial{quote}
  FROM (SELECT *, ln(1 + greatest(ret, -0.999999)) * CASE WHEN ret IS NULL THEN NULL ELSE 1 END AS lr, mm * mm AS mm2,
      ret * mm AS xy, prc * vol AS pv, ret * prev AS rp
    FROM (SELECT g.date, g.entity, h.ret, h.prc, h.vol, h.shrout, CASE WHEN h.ret IS NOT NULL THEN m.mkt END AS mm,
        lag(h.ret) OVER (PARTITION BY g.entity ORDER BY g.date) AS prev,
        CASE WHEN h.ask > h.bid AND h.bid > 0 THEN (h.ask - h.bid) / (h.ask + h.bid) END AS q
      FROM (SELECT entity, date FROM (SELECT entity, min(date) AS f FROM {hist} GROUP BY 1),
        (SELECT DISTINCT date FROM {hist}) WHERE date >= f) g
      LEFT JOIN {hist} h ON g.entity = h.entity AND g.date = h.date
      LEFT JOIN (SELECT date, max(mkt) AS mkt FROM {hist} GROUP BY 1) m ON m.date = g.date)))
WINDOW e AS (PARTITION BY entity ORDER BY date)"""


_FIXED = ("size", "reversal", "momentum", "beta", "dollar_adv", "vol20", "half_spread")


def add_segment(name: str, segment: str) -> None:
    lo, hi = SPLIT.bounds(segment)
    RELATIONS[f"{name}_hist"] = f"SELECT * FROM rets WHERE date <= DATE '{hi}'"
    RELATIONS[f"{name}_in"] = f"SELECT * FROM {name}_hist WHERE date >= DATE '{lo}'"
    RELATIONS[f"{name}_fwd"] = forward_sql(f"{name}_in")
    RELATIONS[f"{name}_ctl"] = controls_sql(f"{name}_hist")
    RELATIONS[name] = f"""
  SELECT f.*, p.sector, f.entity AS rid, {', '.join(f'round(c.{c}, 9) AS {c}' for c in _FIXED)}, c.price, c.spread_quoted,
    {', '.join(f'round(w.fwd_{h}, 9) AS fwd_{h}' for h in HORIZONS)}, {', '.join(f'c.{c} AS raw_{c}' for c in _FIXED)},
    {', '.join(f'w.fwd_{h} AS raw_fwd_{h}' for h in HORIZONS)}
  FROM (SELECT * FROM feats WHERE date BETWEEN DATE '{lo}' AND DATE '{hi}') f
  LEFT JOIN panel p ON p.date = f.date AND p.entity = f.entity
  LEFT JOIN {name}_ctl c ON c.date = f.date AND c.entity = f.entity
  LEFT JOIN {name}_fwd w ON w.date = f.date AND w.entity = f.entity"""


add_segment("disc", "discovery")
add_segment("vali", "validation")


def _list(keys: Sequence[str]) -> str:
    return "".join(f"{k}, " for k in keys)


def _rank(c: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2"


def ic_sql(tag: str, source: str, x: str, y: str, keys: Sequence[str] = (), least: int = 20) -> str:
    """CTE {tag}: same-date rank correlations of x and y."""
    ks = _list(keys)
    return f"""{tag}_p AS (SELECT {ks}date, {_rank(x, ks + 'date')} AS rx, {_rank(y, ks + 'date')} AS ry
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{tag} AS (SELECT * FROM (SELECT {ks}date, count(*) AS n, corr(rx, ry) AS ic FROM {tag}_p GROUP BY {ks}date
  HAVING count(*) >= {least}) WHERE ic IS NOT NULL AND NOT isnan(ic))"""


def nw_sql(tag: str, series: str, value: str, lag: str, keys: Sequence[str] = ()) -> str:
    """CTE {tag}: mean and Newey-West t of each keyed series."""
    ks = _list(keys)
    part = f"PARTITION BY {ks[:-2]}" if keys else ""
    on = "".join(f"a.{k} = b.{k} AND " for k in keys)
    return f"""{tag}_e AS (SELECT {ks}date, {value} AS v, {value} - avg({value}) OVER ({part}) AS e,
  row_number() OVER ({part} ORDER BY date) AS i, {lag} AS l FROM {series} WHERE {value} IS NOT NULL),
{tag}_s AS (SELECT {''.join(f'a.{k}, ' for k in keys)}sum(a.e * b.e * CASE WHEN a.i = b.i THEN 1
  ELSE 2 * (1 - (b.i - a.i) / (a.l + 1)) END) AS s FROM {tag}_e a JOIN {tag}_e b ON {on}b.i BETWEEN a.i AND a.i + a.l
  GROUP BY {''.join(f'a.{k}, ' for k in keys)[:-2] or 'ALL'}),
{tag} AS (SELECT {ks}count(*) AS n_dates, avg(v) AS mean, stddev_samp(v) AS vol, min(date) AS lo, max(date) AS hi,
  avg((v > 0)::INT) AS hit, any_value(l) AS nw_lag,
  CASE WHEN count(*) >= 10 AND any_value(s) / count(*) > 0 THEN avg(v) / sqrt(any_value(s) / count(*) / count(*)) END AS t
  FROM {tag}_e {'JOIN ' + tag + '_s USING (' + ks[:-2] + ')' if keys else ', ' + tag + '_s'}
  {'GROUP BY ' + ks[:-2] if keys else ''})"""


def stats_sql(tag: str, source: str, x: str, y: str, lag: str, keys: Sequence[str] = (), least: int = 20) -> str:
    """CTEs {tag}_ic and {tag}: correlations by date, then their statistics."""
    return f"{ic_sql(tag + '_ic', source, x, y, keys, least)},\n{nw_sql(tag, tag + '_ic', 'ic', lag, keys)}"


def unpivot_sql(tag: str, source: str, features: Sequence[str], keep: Sequence[str]) -> str:
    """CTE {tag}: (keep, feature, x) with missing values kept."""
    parts = [f"SELECT {_list(keep)}'{f}' AS feature, {f} AS x FROM {source}" for f in features]
    return f"{tag} AS ({' UNION ALL '.join(parts)})"


def horizons_sql(tag: str, source: str, cols: Sequence[str], horizons: Sequence[int] = HORIZONS) -> str:
    """CTE {tag}: (cols, horizon, y)."""
    parts = [f"SELECT {_list(cols)}{h} AS horizon, fwd_{h} AS y FROM {source}" for h in horizons]
    return f"{tag} AS ({' UNION ALL '.join(parts)})"


NW = "greatest(5, {0})"
STATS = ", ".join([r("mean", "mean_ic"), r("t", "t_nw")])


def shifts_sql(window: int, least: float, k: int = 3) -> str:
    """Level shifts of the relation sv (series, p, v) as the relation br; candidates are gone through one at a time."""
    near = f"greatest(0, i - {window})", f"least(c, i + {window})"
    return f"""ix AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY p) - 1 AS pos, count(*) OVER (PARTITION BY series) AS c,
  list(v) OVER (PARTITION BY series ORDER BY p ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) AS b0,
  list(v) OVER (PARTITION BY series ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS a0 FROM sv),
kn AS (SELECT *, list_filter(b0, lambda t: t IS NOT NULL) AS b, list_filter(a0, lambda t: t IS NOT NULL) AS a FROM ix),
md AS (SELECT *, list_median(b) AS mb, list_median(a) AS ma FROM kn WHERE pos >= {window} AND pos <= c - {window} AND len(b) >= {window // 2} AND len(a) >= {window // 2}),
sh AS (SELECT *, abs(ma - mb) / greatest(1.4826::DOUBLE * list_median(list_concat(list_transform(b, lambda t: abs(t - mb)),
  list_transform(a, lambda t: abs(t - ma)))), 1e-9 + 0.01::DOUBLE * abs(mb)) AS score FROM md),
ca AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, pos DESC) AS r FROM sh WHERE score >= {least}),
gr AS (SELECT DISTINCT series, 0::BIGINT AS r, []::BIGINT[] AS chosen FROM ca
  UNION ALL SELECT gr.series, ca.r, CASE WHEN len(chosen) < {k} AND len(list_filter(chosen, lambda x: abs(x - ca.pos) < {window})) = 0
    THEN list_append(chosen, ca.pos) ELSE chosen END FROM gr JOIN ca ON ca.series = gr.series AND ca.r = gr.r + 1),
ch AS (SELECT series, unnest(arg_max(chosen, r)) AS i FROM gr GROUP BY series),
sg AS (SELECT ch.series, i, c, {near[0]} AS lo, {near[1]} AS hi FROM ch JOIN (SELECT series, max(c) AS c FROM ix GROUP BY 1) USING (series)),
cu AS (SELECT *, unnest(range(greatest(lo + 1, i - {window // 2}), least(hi - 1, i + {window // 2}) + 1)) AS j FROM sg),
sd AS (SELECT cu.series, i, j, count(v) FILTER (pos < j) AS lc, count(v) FILTER (pos >= j) AS rc, avg(v) FILTER (pos < j) AS lm, avg(v) FILTER (pos >= j) AS rm
  FROM cu JOIN ix ON ix.series = cu.series AND ix.pos >= lo AND ix.pos < hi GROUP BY 1, 2, 3 HAVING lc > 0 AND rc > 0),
sp AS (SELECT series, i, j FROM sd QUALIFY row_number() OVER (PARTITION BY series, i ORDER BY round(lc * rc / (lc + rc) * (lm - rm) * (lm - rm), 9) DESC, j) = 1),
br AS (SELECT ch.series, dt.p AS period, sh.mb AS before_median, sh.ma AS after_median, 100 * (sh.ma - sh.mb) / nullif(abs(sh.mb), 0) AS change_pct, sh.score
  FROM ch JOIN sh ON sh.series = ch.series AND sh.pos = ch.i LEFT JOIN sp ON sp.series = ch.series AND sp.i = ch.i
  JOIN ix dt ON dt.series = ch.series AND dt.pos = coalesce(sp.j, ch.i))"""
