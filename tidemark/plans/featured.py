"""Queries of inventory H and I: the feature language and characterisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import characterize as C
from tidemark.operators import features as H
from tidemark.plans import statsql
from tidemark.plans.bindings import SPECS, Data
from tidemark.plans.registry import d, n, query, r
from tidemark.plans.statsql import _rank

_E = "PARTITION BY entity ORDER BY date"
_PRICE = "(px / nullif(qty, 0))"


def _sd(frame: str) -> str:
    return f"CASE WHEN count(qty) OVER ({_E} {frame}) >= 3 THEN {{0}}(qty) OVER ({_E} {frame}) END"


_FRAME = "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"
# id -> (spec, SQL over the panel)
_OPS = {
    "h1_field": (("field", ("qty",)), "qty"),
    "h2_ratio": (("ratio", ("px", "qty")), "px / nullif(qty, 0)"),
    "h3_diff": (("diff", ("px", "qty")), "px - qty"),
    "h4_log1p": (("log1p", ("qty",)), "ln(1 + greatest(qty, 0))"),
    "h5_change": (("change", ("qty",), 3), f"qty - lag(qty, 3) OVER ({_E})"),
    "h6_growth": (("growth", ("qty",), 3), f"(qty - lag(qty, 3) OVER ({_E})) / nullif(abs(lag(qty, 3) OVER ({_E})), 0)"),
    "h7_surprise": (("surprise", ("qty",), 6), "(SELECT qty_surprise FROM feat0 f WHERE f.date = panel.date AND f.entity = panel.entity)"),
    "h8_rolling_mean": (("rolling_mean", ("qty",), 6), _sd(_FRAME).format("avg")),
    "h9_rolling_sum": (("rolling_sum", ("qty",), 6), _sd(_FRAME).format("sum")),
    "h10_rolling_std": (("rolling_std", ("qty",), 6), _sd(_FRAME).format("stddev_samp")),
    "h11_peer_relative": (("peer_relative", ("qty",)), "qty - quantile_cont(qty, 0.5) OVER (PARTITION BY date)"),
    "h11_peer_relative_sector": (("peer_relative", ("qty",), None, "sector"),
                                 "CASE WHEN sector <> 'Unknown' THEN qty - quantile_cont(qty, 0.5) OVER (PARTITION BY date, sector) END"),
    "h12_rank": (("rank", ("qty",)), f"({_rank('qty', 'date')}) / count(qty) OVER (PARTITION BY date)"),
    "h12_rank_sector": (("rank", ("qty",), None, "sector"),
                        f"CASE WHEN sector <> 'Unknown' THEN ({_rank('qty', 'date, sector')}) / count(qty) OVER (PARTITION BY date, sector) END"),
    "h13_residualize_sector": (("residualize", ("qty",), None, "sector"),
                               "CASE WHEN sector <> 'Unknown' THEN qty - avg(qty) OVER (PARTITION BY date, sector) END"),
    "h14_residualize_log": (("residualize", ("qty",), None, "adv_proxy"),
                            "(SELECT qty_resid FROM feat1 f WHERE f.date = panel.date AND f.entity = panel.entity)"),
}


def _register(name: str, spec: tuple, sql: str) -> None:
    @query(name, f"SELECT {d('date', 'date')}, entity, {r(sql, 'x')} FROM panel")
    def _(x: Data):
        op, inputs, *rest = spec
        window, group = (rest + [None, None])[:2]
        return H.feature_op(x.panel, op, inputs, "x", window, group, bounded=True).select("date", "entity", "x")


for _name, (_spec, _sql) in _OPS.items():
    _register(_name, _spec, _sql)


@query("h15_build_features", f"""SELECT {d('date', 'date')}, entity, {', '.join(r(f, f) for f in statsql.FEATURES)} FROM feat1""")
def _(x: Data):
    return H.build_features(x.panel, SPECS, statsql.FEATURES, bounded=True)


@query("h16_feature_summary", f"""SELECT {n('count(qty_surprise)', 'n')}, {r('count(qty_surprise) / count(*)', 'coverage_share')},
{r('quantile_cont(qty_surprise, 0.01)', 'p1')}, {r('quantile_cont(qty_surprise, 0.5)', 'median')},
{r('quantile_cont(qty_surprise, 0.99)', 'p99')}, {r('skewness(qty_surprise)', 'skew')},
{r('count(*) FILTER (qty_surprise = 0) / count(qty_surprise)', 'zero_share')},
{r('count(*) FILTER (qty_surprise < 0) / count(qty_surprise)', 'negative_share')} FROM feats""")
def _(x: Data):
    return H.feature_summary(x.features_of("qty_surprise"), "qty_surprise")


# ---------------------------------------------------------------- characterisation
_BASE = ("qty", "unit_price", "qty_load", "qty_resid", "price_rel")
_WITH = "pf AS (SELECT f.date, f.entity, f.sector, f.qty, f.adv_proxy, round(f.unit_price, 9) AS unit_price, " \
        "round(f.qty_load, 9) AS qty_load, round(g.qty_resid, 9) AS qty_resid, round(g.price_rel, 9) AS price_rel, " \
        "f.ladv, f.known_sector FROM feat0 f JOIN feat1 g USING (date, entity))"
_LONG = statsql.unpivot_sql("lg", "pf", _BASE, ["date", "entity", "ladv", "known_sector"])
_RHO = f"""{_WITH}, {_LONG}, pr AS (SELECT feature, date, x, ladv AS c, ({_rank('x', 'feature, date')}) / count(*) OVER
  (PARTITION BY feature, date) AS rx, ({_rank('ladv', 'feature, date')}) / count(*) OVER (PARTITION BY feature, date) AS rc
  FROM lg WHERE x IS NOT NULL AND ladv IS NOT NULL),
rho AS (SELECT feature, date, n, CASE WHEN NOT isnan(c) THEN c END AS rho FROM (
  SELECT feature, date, count(*) AS n, corr(rx, rc) AS c FROM pr GROUP BY 1, 2))"""
_STRENGTH = "CASE WHEN {rows} < 50 THEN 'not measurable' WHEN abs({v}) >= {s} THEN 'strong' WHEN abs({v}) >= {m} " \
            "THEN 'moderate' WHEN {v} IS NOT NULL THEN 'negligible' ELSE 'not measurable' END"
_RHO_STRENGTH = _STRENGTH.format(rows="sum(n)", v="avg(rho)", s=0.3, m=0.1)
_ETA = f"""{_WITH}, {_LONG}, er AS (SELECT feature, date, known_sector AS c, ({_rank('x', 'feature, date')}) / count(*) OVER
  (PARTITION BY feature, date) AS rx FROM lg WHERE x IS NOT NULL AND known_sector IS NOT NULL),
em AS (SELECT *, avg(rx) OVER (PARTITION BY feature, date, c) AS gm, avg(rx) OVER (PARTITION BY feature, date) AS dm FROM er),
eta AS (SELECT feature, date, n, CASE WHEN tot > 0 AND n > k THEN 1 - (1 - btw / tot) * (n - 1) / (n - k) END AS eta FROM (
  SELECT feature, date, count(*) AS n, count(DISTINCT c) AS k, avg((gm - dm) * (gm - dm)) AS btw, var_pop(rx) AS tot
  FROM em GROUP BY 1, 2))"""
_ETA_STRENGTH = _STRENGTH.format(rows="sum(n)", v="avg(eta)", s=0.10, m=0.03)


def _featured(x: Data):
    """The panel with constructed features next to its fields."""
    names = [f for f in _BASE if f != "qty"]
    f = H.build_features(x.panel, SPECS, names, bounded=True, keep=("sector", "qty", "adv_proxy"))
    return f.withColumns({c: F.round(c, 9) for c in names})


def _long(x: Data, by: str):
    return C.feature_long(_featured(x), _BASE, by)


@query("i1_exposure", f"""WITH {_RHO} SELECT feature, {n('sum(n)', 'rows_compared')}, {r('avg(rho)', 'rank_corr_mean')},
{n('count(rho)', 'n_dates')}, {r('count(*) FILTER (rho > 0) / count(rho)', 'share_dates_positive')},
{r('avg(rho) / stddev_samp(rho) * sqrt(count(rho))', 'rank_corr_t')}, {_RHO_STRENGTH} AS strength FROM rho GROUP BY 1""")
def _(x: Data):
    return C.exposure_numeric(_long(x, "adv_proxy"), bounded=True)


@query("i1_exposure_by_year", f"""WITH {_RHO} SELECT feature, {n('year(date)', 'year')}, {r('avg(rho)', 'rank_corr')}
FROM rho GROUP BY feature, year(date)""")
def _(x: Data):
    return C.exposure_by_year(_long(x, "adv_proxy"), bounded=True)


@query("i1_exposure_profile", f"""WITH {_RHO}, q AS (SELECT *, greatest(least(ceil(rc * 5), 5), 1) AS qt FROM pr)
SELECT feature, {n('qt', 'quintile')}, {n('count(*)', 'rows')}, {r('avg(rx)', 'mean_rank')},
{r('quantile_cont(x, 0.9) - quantile_cont(x, 0.1)', 'p10_p90_spread')} FROM q GROUP BY feature, qt""")
def _(x: Data):
    return C.exposure_profile(_long(x, "adv_proxy"), bounded=True)


@query("i2_exposure_sector", f"""WITH {_ETA} SELECT feature, {n('sum(n)', 'rows_compared')}, {r('avg(eta)', 'eta_squared_mean')},
{n('count(eta)', 'n_dates')}, {_ETA_STRENGTH} AS strength FROM eta GROUP BY 1""")
def _(x: Data):
    return C.exposure_categorical(_long(x, "sector"), bounded=True)


@query("i2_eta_by_year", f"""WITH {_ETA} SELECT feature, {n('year(date)', 'year')}, {r('avg(eta)', 'eta_squared')} FROM eta
GROUP BY feature, year(date)""")
def _(x: Data):
    return C.eta_by_year(_long(x, "sector"), bounded=True)


@query("i2_group_profile", f"""WITH {_ETA} SELECT feature, c AS "group", {n('count(*)', 'rows')}, {r('avg(rx)', 'mean_rank')}
FROM er GROUP BY 1, 2""")
def _(x: Data):
    return C.group_profile(_long(x, "sector"), bounded=True)


_SERIES = """sr AS (SELECT date, count(qty) AS n, quantile_cont(qty, 0.5) AS med, quantile_cont(qty, 0.1) AS lo,
  quantile_cont(qty, 0.9) AS hi FROM panel GROUP BY 1)"""


def _acf(source: str, lags) -> str:
    lag = ", ".join(f"lag(r, {k}) OVER (PARTITION BY feature, entity ORDER BY date) AS r{k}" for k in lags)
    return f"""ac0 AS (SELECT feature, date, entity, x, CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY feature, date
  ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY feature, date, x) - 1) / 2) / count(x) OVER (PARTITION BY feature, date)
  END AS r FROM {source}), ac1 AS (SELECT *, {lag} FROM ac0),
acf AS (SELECT feature, count(x) / count(*) AS cov, {', '.join(f'corr(r, r{k}) AS acf{k}' for k in lags)} FROM ac1 GROUP BY 1)"""


@query("i3_stability_series", f"""WITH {_SERIES} SELECT {d('date', 'date')}, {n('n', 'n')}, {r('med', 'median')}, {r('lo', 'p10')},
{r('hi', 'p90')} FROM sr""")
def _(x: Data):
    return C.stability_series(x.panel, "qty", bounded=True)


@query("i3_stability", f"""WITH {_SERIES}, ix AS (SELECT *, row_number() OVER (ORDER BY date) AS i,
  row_number() OVER (ORDER BY date DESC) AS j FROM sr),
lq AS (SELECT 'qty' AS feature, date, entity, qty AS x FROM panel), {_acf('lq', (1, 5, 20))},
vs AS (SELECT qty AS x, avg(qty) OVER (PARTITION BY entity) AS em, avg(qty) OVER (PARTITION BY date) AS tm FROM panel)
SELECT {n('count(*)', 'n_dates')}, {n('min(n)', 'coverage_min')}, {r('median(n)', 'coverage_median')}, {n('max(n)', 'coverage_max')},
{r('median(med) FILTER (i <= 24)', 'median_first')}, {r('median(med) FILTER (j <= 24)', 'median_last')},
{', '.join(f'(SELECT {r(f"acf{k}", "a")[:-5]} FROM acf) AS rank_acf_lag{k}' for k in (1, 5, 20))},
(SELECT {r('var_samp(em) / var_samp(x)', 'a')[:-5]} FROM vs) AS share_between_entities,
(SELECT {r('var_samp(x - em) / var_samp(x)', 'a')[:-5]} FROM vs) AS share_within_entities,
(SELECT {r('var_samp(tm) / var_samp(x)', 'a')[:-5]} FROM vs) AS share_common_over_time FROM ix""")
def _(x: Data):
    return C.stability(x.panel, "qty", edge=24, bounded=True)


@query("i3_stability_breaks", f"""WITH RECURSIVE {_SERIES}, sv AS (SELECT 'median' AS series, date AS p, med AS v FROM sr
  UNION ALL SELECT 'coverage', date, CAST(n AS DOUBLE) FROM sr), {statsql.shifts_sql(6, 1.0)}
SELECT series, {d('period', 'date')}, {r('before_median', 'before_median')}, {r('after_median', 'after_median')}, {r('change_pct', 'change_pct')},
{r('score', 'score')} FROM br""")
def _(x: Data):
    return C.stability_breaks(C.stability_series(x.panel, "qty", bounded=True), 6, min_score=1.0)


@query("i4_compare_representations", f"""WITH {_RHO}, {_acf('lg', (5,))},
g AS (SELECT feature, avg(rho) AS dep, {_RHO_STRENGTH} AS strength FROM rho GROUP BY 1)
SELECT acf.feature, 'adv_proxy' AS "by", {r('dep', 'dependence')}, coalesce(strength, 'not measurable') AS strength,
{r('acf5', 'rank_acf_lag5')}, {r('cov', 'coverage_share')},
row_number() OVER (ORDER BY abs(dep) NULLS LAST, acf.feature) = 1 AS least FROM acf LEFT JOIN g ON g.feature = acf.feature""")
def _(x: Data):
    return C.compare_representations(_featured(x), _BASE, "adv_proxy", bounded=True)


@query("i5_rank_corr", f"""WITH {_WITH}, {statsql.ic_sql('k', 'pf', 'qty', 'qty_resid', least=1)}
SELECT {r('avg(ic)', 'rank_corr')}, {n('count(ic)', 'n_dates')}, avg(ic) >= 0.9 AS faithful FROM k""")
def _(x: Data):
    return C.rank_corr(_featured(x), "qty", "qty_resid", bounded=True)


@query("i6_dependence_matrix", f"""WITH {_RHO}, {_ETA.split(_LONG + ', ')[1]},
m AS (SELECT feature, 'adv_proxy' AS by_, avg(rho) AS dep, {_RHO_STRENGTH} AS strength FROM rho GROUP BY 1
  UNION ALL SELECT feature, 'sector', avg(eta), {_ETA_STRENGTH} FROM eta GROUP BY 1),
b AS (SELECT m.*, z.strength AS base FROM m LEFT JOIN m z ON z.by_ = m.by_ AND ((m.feature = 'qty_resid' AND m.by_ = 'adv_proxy'
  AND z.feature = 'qty') OR (m.feature = 'price_rel' AND m.by_ = 'sector' AND z.feature = 'unit_price')))
SELECT feature, by_ AS "by", {r('dep', 'dependence')}, strength, CASE WHEN base = 'negligible' THEN 'needless_neutralization'
  WHEN base IS NOT NULL AND strength = 'strong' THEN 'still_strong' END AS label FROM b""")
def _(x: Data):
    return C.dependence_matrix(_featured(x), _BASE, ["adv_proxy", "sector"], [s for s in SPECS if s.name in _BASE], bounded=True)
