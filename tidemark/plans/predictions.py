"""Queries of inventory J, K and L: returns, controls, information coefficients, robustness, costs, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import hurdle, significance
from tidemark.operators import costs as K
from tidemark.operators import predict as P
from tidemark.operators import returns as R
from tidemark.operators import robustness as B
from tidemark.operators import segments as G
from tidemark.plans import statsql as S
from tidemark.plans.bindings import HORIZONS, SPLIT, WINDOWS, Data
from tidemark.plans.registry import RELATIONS, d, n, query, r
from tidemark.plans.statsql import NW, STATS, _rank
from tidemark.specs import Finding, RobustnessTest


def _hl(tag: str, source: str, cols) -> str:
    return S.horizons_sql(tag, source, cols)


# ---------------------------------------------------------------- returns and controls
@query("j1_densify", f"""SELECT {d('date', 'date')}, entity, {r('ret', 'ret', 9)} FROM (SELECT entity, date FROM
  (SELECT entity, min(date) AS f FROM rets GROUP BY 1), (SELECT DISTINCT date FROM rets) WHERE date >= f)
LEFT JOIN rets USING (date, entity)""", digits=9)
def _(x: Data):
    return R.densify(x.plain_returns).select("date", "entity", "ret")


RELATIONS["fwd_all"] = S.forward_sql("rets")
RELATIONS["ctl_all"] = S.controls_sql("rets")
RELATIONS["ctl_quoted"] = S.controls_sql("rets", quoted=True)


@query("j2_forward_returns", f"SELECT {d('date', 'date')}, entity, {', '.join(r(f'fwd_{h}', f'fwd_{h}') for h in HORIZONS)} FROM fwd_all")
def _(x: Data):
    return x.forward


@query("j3_one_session", f"""SELECT {d('date', 'date')}, entity, {r('r_oc', 'fwd_1', 9)}
FROM (SELECT entity, date FROM (SELECT entity, min(date) AS f FROM rets GROUP BY 1), (SELECT DISTINCT date FROM rets)
  WHERE date >= f) LEFT JOIN rets USING (date, entity)""", digits=9)
def _(x: Data):
    return R.forward_returns(x.plain_returns, (1,))


_CONTROL_IDS = {"j4_size": ("size", "price"), "j5_reversal": ("reversal",), "j6_momentum": ("momentum",), "j7_beta": ("beta",),
                "j8_dollar_adv": ("dollar_adv",), "j9_vol_and_roll_spread": ("vol20", "half_spread", "spread_quoted")}


def _control(name: str, cols: tuple) -> None:
    @query(name, f"SELECT {d('date', 'date')}, entity, {', '.join(r(c, c) for c in cols)} FROM ctl_all")
    def _(x: Data):
        return R.controls(x.plain_returns, WINDOWS).select("date", "entity", *cols)


for _name, _cols in _CONTROL_IDS.items():
    _control(_name, _cols)


@query("j10_quoted_spread", f"SELECT {d('date', 'date')}, entity, {r('half_spread', 'half_spread')}, {r('spread_quoted', 'spread_quoted')} FROM ctl_quoted")
def _(x: Data):
    return R.controls(x.returns, WINDOWS).select("date", "entity", "half_spread", "spread_quoted")


# ---------------------------------------------------------------- segments
_L1 = ("size", "reversal", "momentum", "beta", "dollar_adv", "fwd_5", "fwd_20")


@query("l1_segment_frame", f"""SELECT {d('date', 'date')}, entity, sector, qty_surprise IS NOT NULL AS has_feature,
{r('price', 'price')}, {', '.join(r(f'raw_{c}', c) for c in _L1)} FROM disc""")
def _(x: Data):
    f = x.raw_segment("discovery", "qty_surprise")
    return f.select("date", "entity", "sector", F.col("qty_surprise").isNotNull().alias("has_feature"), "price", *_L1)


@query("l1_split_check", f"""WITH b(before, after, e, s) AS (VALUES ('discovery', 'validation', DATE '{SPLIT.discovery[1]}',
  DATE '{SPLIT.validation[0]}'), ('validation', 'test', DATE '{SPLIT.validation[1]}', DATE '{SPLIT.test[0]}'))
SELECT before, after, {n('(SELECT count(*) FROM nth WHERE session > e AND session < s)', 'gap_sessions')},
s > e AND (SELECT count(*) FROM nth WHERE session > e AND session < s) >= 20 AS ok FROM b""")
def _(x: Data):
    return G.split_errors(SPLIT, x.sessions)


@query("l2_segment_coverage", f"""SELECT {n('count(*)', 'rows')}, {n('count(DISTINCT date)', 'dates')}, {n('count(DISTINCT entity)', 'entities')},
{r('count(rid) / count(*)', 'share_linked')}, {r('count(fwd_1) / count(*)', 'share_with_return')}, {d('min(date)', 'first_date')},
{d('max(date)', 'last_date')} FROM disc""")
def _(x: Data):
    return G.segment_coverage(x.discovery("qty_surprise"))


# ---------------------------------------------------------------- information coefficients
_X = "qty_surprise"


def _centered(c: str, part: str) -> str:
    return f"(({_rank(c, part)}) / count(*) OVER (PARTITION BY {part}) - 0.5 * (1 + 1 / count(*) OVER (PARTITION BY {part})))"


@query("j11_centered_rank", f"""SELECT {d('date', 'date')}, entity, {r(_centered(_X, 'date'), 'rank')} FROM disc WHERE {_X} IS NOT NULL""")
def _(x: Data):
    f = P.centered_rank(x.discovery(_X), _X, "rank", bounded=True)
    return f.where(F.col("rank").isNotNull()).select("date", "entity", "rank")


@query("j12_residualize_sector", f"""WITH c AS (SELECT date, entity, sector, {_centered(_X, 'date')} AS y, count(*) OVER (PARTITION BY date) AS k
  FROM disc WHERE {_X} IS NOT NULL AND sector IS NOT NULL)
SELECT {d('date', 'date')}, entity, {r('y - avg(y) OVER (PARTITION BY date, sector)', 'resid')} FROM c WHERE k >= 20""")
def _(x: Data):
    f = P.residualize(x.discovery(_X), _X, ["sector"], bounded=True)
    return f.where(F.col("resid").isNotNull()).select("date", "entity", "resid")


# one control and sectors: the sector-demeaned regression has a closed form
_ONE = f"""c0 AS (SELECT date, entity, sector, {_centered(_X, 'date')} AS y, {_centered('dollar_adv', 'date')} AS z,
  count(*) OVER (PARTITION BY date) AS k FROM disc WHERE {_X} IS NOT NULL AND sector IS NOT NULL AND dollar_adv IS NOT NULL),
c1 AS (SELECT *, y - avg(y) OVER g AS yd, z - avg(z) OVER g AS zd FROM c0 WHERE k >= 20 WINDOW g AS (PARTITION BY date, sector)),
res AS (SELECT date, entity, yd - zd * sum(yd * zd) OVER (PARTITION BY date) / sum(zd * zd) OVER (PARTITION BY date) AS resid FROM c1)"""


@query("j12_residualize", f"WITH {_ONE} SELECT {d('date', 'date')}, entity, {r('resid', 'resid')} FROM res")
def _(x: Data):
    f = P.residualize(x.discovery(_X), _X, ["dollar_adv", "sector"], bounded=True)
    return f.where(F.col("resid").isNotNull()).select("date", "entity", "resid")


# five controls and sectors: each control in turn is projected out of the later ones and of the feature
_FIVE = ("size", "reversal", "momentum", "beta", "dollar_adv")


def _orthogonal() -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in (_X, "sector", *_FIVE))
    names = ["y", *(f"z{i}" for i in range(len(_FIVE)))]
    steps = [f"""g0 AS (SELECT date, entity, sector, count(*) OVER (PARTITION BY date) AS k,
  {", ".join(f"{_centered(c, 'date')} AS {v}" for c, v in zip((_X, *_FIVE), names, strict=True))} FROM disc WHERE {known}),
h0 AS (SELECT date, entity, {", ".join(f"{v} - avg({v}) OVER (PARTITION BY date, sector) AS {v}" for v in names)} FROM g0 WHERE k >= 20)"""]
    for i in range(len(_FIVE)):
        own = f"sum(z{i} * z{i}) OVER (PARTITION BY date)"
        out = [f"{v} - CASE WHEN {own} > 1e-9 THEN z{i} * sum({v} * z{i}) OVER (PARTITION BY date) / {own} ELSE 0 END AS {v}"
               for v in ("y", *(f"z{j}" for j in range(i + 1, len(_FIVE))))]
        steps.append(f"h{i + 1} AS (SELECT date, entity, {', '.join(out)} FROM h{i})")
    return ",\n".join(steps)


@query("j12_residualize_all", f"WITH {_orthogonal()} SELECT {d('date', 'date')}, entity, {r('y', 'resid')} FROM h{len(_FIVE)}")
def _(x: Data):
    f = P.residualize(x.discovery(_X), _X, ["size", "reversal", "momentum", "beta", "dollar_adv", "sector"], bounded=True)
    return f.where(F.col("resid").isNotNull()).select("date", "entity", "resid")


@query("j13_daily_ic", f"WITH {S.ic_sql('k', 'disc', _X, 'fwd_5')} SELECT {d('date', 'date')}, {n('n', 'n')}, {r('ic', 'ic')} FROM k")
def _(x: Data):
    return P.daily_ic(x.discovery(_X), _X, "fwd_5", bounded=True)


@query("j14_nw_t", f"""WITH {S.ic_sql('k', 'disc', _X, 'fwd_5')}, {S.nw_sql('t_', 'k', 'ic', '5')}
SELECT {n('n_dates', 'n_dates')}, {r('t', 't_nw')}, {r('mean', 'mean')} FROM t_""")
def _(x: Data):
    return P.nw_t(P.daily_ic(x.discovery(_X), _X, "fwd_5", bounded=True), "ic", F.lit(5))


_FULL = f"""{STATS}, {r('vol', 'ic_vol')}, {r('hit', 'hit_rate')}, {n('n_dates', 'n_dates')}, {n('nw_lag', 'nw_lag')},
{d('lo', 'first_date')}, {d('hi', 'last_date')}"""


@query("j15_ic_stats", f"WITH {S.stats_sql('k', 'disc', _X, 'fwd_10', '10')} SELECT {_FULL} FROM k")
def _(x: Data):
    return P.ic_stats(P.daily_ic(x.discovery(_X), _X, "fwd_10", bounded=True), 10)


@query("j15_ic_by_year", f"""WITH {S.ic_sql('k', 'disc', _X, 'fwd_2')} SELECT {n('year(date)', 'year')}, {r('avg(ic)', 'mean_ic')},
{n('count(ic)', 'n_dates')} FROM k GROUP BY year(date)""")
def _(x: Data):
    return P.ic_by_year(P.daily_ic(x.discovery(_X), _X, "fwd_2", bounded=True))


_QUANT = f"""qp AS (SELECT date, entity, fwd_2 AS y, row_number() OVER (PARTITION BY date ORDER BY {_X}, entity) AS i,
  count(*) OVER (PARTITION BY date) AS c FROM disc WHERE {_X} IS NOT NULL AND fwd_2 IS NOT NULL),
qx AS (SELECT date, least(ceil(i / c * 5), 5) AS q, y - avg(y) OVER (PARTITION BY date) AS ex FROM qp WHERE c >= 20),
qd AS (SELECT date, q, avg(ex) AS ex FROM qx GROUP BY 1, 2),
qm AS (SELECT q, avg(ex) AS m, count(*) AS k FROM qd GROUP BY 1),
sp AS (SELECT date, max(ex) FILTER (q = 5) - max(ex) FILTER (q = 1) AS spread FROM qd GROUP BY 1)"""


@query("j16_quantile_means", f"WITH {_QUANT} SELECT {n('q', 'q')}, {r('m', 'mean_excess')}, {n('k', 'n_dates')} FROM qm")
def _(x: Data):
    return P.quantile_means(P.quantile_returns(x.discovery(_X), _X, "fwd_2", 5, bounded=True))


@query("j16_quantile_spread", f"""WITH {_QUANT}, {S.nw_sql('t_', 'sp', 'spread', '5')}
SELECT {r('mean', 'top_minus_bottom')}, {r('t', 't_nw')}, {n('n_dates', 'n_dates')},
(SELECT {r('corr(rk, q)', 'c')[:-5]} FROM (SELECT q, rank() OVER (ORDER BY m) AS rk FROM qm)) AS monotonicity FROM t_""")
def _(x: Data):
    return P.quantile_spread(x.discovery(_X), _X, "fwd_2", 5, 2, bounded=True)


@query("j17_hurdle", f"""SELECT {n('l_linenumber', 'line')}, {n('count(*)', 'n')},
{r('greatest(3.0::DOUBLE, sqrt(2 * ln(count(*))))', 'hurdle_t')},
CASE WHEN abs(sum(l_quantity) / count(*) / 7) >= greatest(3.0::DOUBLE, sqrt(2 * ln(count(*)))) THEN 'clears the hurdle'
WHEN abs(sum(l_quantity) / count(*) / 7) >= 2 THEN '|t| >= 2 but below the hurdle' ELSE 'not distinguishable from zero' END AS reading
FROM lineitem GROUP BY l_linenumber""")
def _(x: Data):
    g = x.t("lineitem", "l_linenumber", "l_quantity").groupBy(F.col("l_linenumber").alias("line")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("l_quantity") / F.count(F.lit(1)) / 7).alias("t"))
    bar = hurdle(F.col("n"))
    return g.select("line", "n", bar.alias("hurdle_t"), significance(F.col("t"), bar).alias("reading"))


@query("j18_ic_summary", f"""WITH {S.stats_sql('k', 'disc', _X, 'fwd_5', '5')}
SELECT '{_X}' AS feature, 5::BIGINT AS horizon, '' AS controls, {_FULL}, {r('3', 'hurdle_t')},
CASE WHEN t IS NULL THEN 'no estimate' WHEN abs(t) >= 3 THEN 'clears the hurdle' WHEN abs(t) >= 2 THEN '|t| >= 2 but below the hurdle'
ELSE 'not distinguishable from zero' END AS significance FROM k""")
def _(x: Data):
    return P.ic_summary(x.discovery(_X), _X, 5, bounded=True)


_DECAY = f"{_hl('hz', 'disc', ['date', 'entity', _X])}, {S.stats_sql('k', 'hz', _X, 'y', NW.format('horizon'), ['horizon'])}"


@query("j19_ic_decay", f"""WITH {_DECAY} SELECT {n('horizon', 'horizon')}, {STATS}, {n('n_dates', 'n_dates')},
row_number() OVER (ORDER BY abs(mean) DESC NULLS LAST, horizon) = 1 AS peak FROM k""")
def _(x: Data):
    return P.ic_decay(x.discovery(_X), _X, horizons=HORIZONS, bounded=True)


_TERCILE = f"""tp AS (SELECT *, CASE WHEN dollar_adv IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY dollar_adv NULLS LAST)
  + (count(*) OVER (PARTITION BY date, dollar_adv) - 1) / 2) / count(dollar_adv) OVER (PARTITION BY date) END AS ap,
  CASE WHEN size IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY size NULLS LAST)
  + (count(*) OVER (PARTITION BY date, size) - 1) / 2) / count(size) OVER (PARTITION BY date) END AS sp FROM disc)"""


def _conditional(by: str, bucket: str) -> str:
    return f"""WITH {_TERCILE}, bk AS (SELECT *, {bucket} AS bucket FROM tp),
{S.stats_sql('k', "bk", _X, 'fwd_2', '5', ['bucket'], 10)}
SELECT bucket, {STATS}, {n('n_dates', 'n_dates')} FROM k WHERE bucket IS NOT NULL"""


_TERCILE_OF = "CASE WHEN ap <= 1 / 3 THEN 'low' WHEN ap <= 2 / 3 THEN 'mid' WHEN ap IS NOT NULL THEN 'high' END"


@query("j20_conditional_ic", _conditional("dollar_adv", _TERCILE_OF))
def _(x: Data):
    return P.conditional_ic(x.discovery(_X), _X, 2, "dollar_adv", 10, bounded=True)


@query("j20_conditional_ic_sector", _conditional("sector", "coalesce(sector, 'Unknown')"))
def _(x: Data):
    return P.conditional_ic(x.discovery(_X), _X, 2, "sector", 10, bounded=True)


@query("j20_conditional_ic_year", _conditional("year", "CAST(year(date) AS VARCHAR)"))
def _(x: Data):
    return P.conditional_ic(x.discovery(_X), _X, 2, "year", 10, bounded=True)


# ---------------------------------------------------------------- robustness
_PERIOD = SPLIT.discovery
_BATTERY = B.standard_battery(_PERIOD)
_CRITIC = (RobustnessTest("no_asia", "restrict_universe", "exclude_sector", sector="ASIA"),
           RobustnessTest("large_caps", "restrict_universe", "large_caps", target="raw_2"))
_FINDINGS = (Finding("raw_2", "qty_surprise", 2, 1, (), 0.02), Finding("raw_5", "qty_surprise", 5, -1, (), -0.01),
             Finding("rel_2", "price_rel", 2, -1, ("sector",), -0.05))
_KEPT = {"no_illiquid_third": "ap > 1 / 3", "price_ge_5": "price >= 5",
         "half_1": f"date BETWEEN DATE '{_BATTERY[2].period[0]}' AND DATE '{_BATTERY[2].period[1]}'",
         "half_2": f"date BETWEEN DATE '{_BATTERY[3].period[0]}' AND DATE '{_BATTERY[3].period[1]}'",
         "no_asia": "coalesce(sector <> 'ASIA', TRUE)", "large_caps": "sp > 2 / 3"}


@query("j21_subset", f"WITH {_TERCILE} " + "\nUNION ALL ".join(
    f"SELECT '{t}' AS test, {n(f'count(*) FILTER ({c})', 'rows')} FROM tp" for t, c in _KEPT.items()))
def _(x: Data):
    d_ = B.with_universe_ranks(x.discovery(_X), bounded=True)
    tests = [*_BATTERY, *_CRITIC]
    cells = F.array(*[F.struct(F.lit(t.name).alias("test"), F.count(F.when(B.kept(t), 1)).alias("rows")) for t in tests])
    return d_.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def _tested(pairs) -> str:
    """CTE ts: (test_id, horizon, date, entity, signal, y) for (id, feature, horizon, sector-controlled?, condition)."""
    parts = []
    for pid, f, h, sector, cond in pairs:
        if sector:
            parts.append(f"""SELECT '{pid}' AS test_id, {h} AS horizon, date, entity, round(y0 - avg(y0) OVER (PARTITION BY date, sector), 12) AS signal,
  y FROM (SELECT date, entity, sector, fwd_{h} AS y, {_centered(f, 'date')} AS y0, count(*) OVER (PARTITION BY date) AS k
  FROM tp WHERE {f} IS NOT NULL AND sector IS NOT NULL AND ({cond})) WHERE k >= 20""")
        else:
            parts.append(f"SELECT '{pid}' AS test_id, {h} AS horizon, date, entity, {f} AS signal, fwd_{h} AS y FROM tp WHERE ({cond})")
    return f"ts AS ({' UNION ALL '.join(parts)})"


def _robust_sql() -> str:
    pairs, meta = [], []
    for t in [*_BATTERY, *_CRITIC]:
        for f in _FINDINGS:
            source = "standard" if t.standard else "critic"
            if t.target and t.target != f.name:
                if f.feature != next(g.feature for g in _FINDINGS if g.name == t.target):
                    continue
                source = "propagated"
            pid = f"{f.name}|{t.name}"
            pairs.append((pid, f.feature, f.horizon, bool(f.controls), _KEPT[t.name]))
            meta.append(f"('{pid}', '{f.name}', '{f.feature}', '{t.name}', '{source}', '{','.join(f.controls)}', {f.claimed_ic}::DOUBLE)")
    return f"""WITH {_TERCILE}, {_tested(pairs)},
{S.stats_sql('k', 'ts', 'signal', 'y', NW.format('horizon'), ['test_id', 'horizon'])},
nm_ AS (SELECT test_id, count(DISTINCT entity) AS names FROM ts WHERE signal IS NOT NULL AND y IS NOT NULL GROUP BY 1),
mt(test_id, finding, feature, test, source, controls, claimed) AS (VALUES {', '.join(meta)}),
j AS (SELECT mt.*, coalesce(names, 0) AS names, mean, t, n_dates, mean / claimed AS ret FROM mt LEFT JOIN k USING (test_id) LEFT JOIN nm_ USING (test_id)),
o AS (SELECT *, CASE WHEN ret IS NULL OR t IS NULL THEN 'inconclusive' WHEN (ret < 0 AND abs(t) >= 2) OR ret < 0.25 THEN 'refuted'
  WHEN ret >= 0.5 AND abs(t) >= 2 THEN 'survived' ELSE 'inconclusive' END AS outcome FROM j)
SELECT finding, feature, test, source, controls, {n('names', 'names')}, {STATS}, {n('n_dates', 'n_dates')}, {r('ret', 'retention')}, outcome FROM o
WHERE source <> 'propagated' OR test IN (SELECT test FROM o WHERE source = 'critic' AND outcome = 'refuted')"""


@query("j22_robustness", _robust_sql())
def _(x: Data):
    return B.robustness(x.discovery("qty_surprise", "price_rel"), _FINDINGS, [*_BATTERY, *_CRITIC], bounded=True)


@query("j23_verdict", f"""WITH v AS (SELECT l_linenumber AS line, l_returnflag AS flag, (avg(l_discount) - 0.05) AS ic,
  (avg(l_tax) - 0.04) * 2000 AS t FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, ic / 0.0004::DOUBLE AS ret FROM v)
SELECT {n('line', 'line')}, flag, {r('ret', 'retention', 3)}, CASE WHEN (ret < 0 AND abs(t) >= 2) OR ret < 0.25 THEN 'refuted'
WHEN ret >= 0.5 AND abs(t) >= 2 THEN 'survived' ELSE 'inconclusive' END AS outcome FROM w""", digits=3)
def _(x: Data):
    g = x.t("lineitem", "l_linenumber", "l_returnflag", "l_discount", "l_tax").groupBy(
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag")).agg(
        (F.avg("l_discount") - 0.05).alias("ic"), ((F.avg("l_tax") - 0.04) * 2000).alias("t"))
    retention, outcome = B.verdict(F.col("ic"), F.col("t"), F.lit(0.0004))
    return g.select("line", "flag", retention.alias("retention"), outcome.alias("outcome"))


def _retest_sql() -> str:
    pairs = [(f.name, f.feature, f.horizon, bool(f.controls), "TRUE") for f in _FINDINGS]
    meta = ", ".join(f"('{f.name}', '{f.feature}', {f.sign})" for f in _FINDINGS)
    return f"""WITH {_TERCILE.replace('FROM disc', 'FROM vali')}, {_tested(pairs)},
{S.stats_sql('k', 'ts', 'signal', 'y', NW.format('horizon'), ['test_id', 'horizon'])},
mt(test_id, feature, sgn) AS (VALUES {meta})
SELECT mt.test_id AS finding, feature, {n('sgn', 'sign')}, {STATS}, {n('n_dates', 'n_dates')},
coalesce(sign(mean) = sgn AND abs(t) >= 2, FALSE) AS validated FROM mt LEFT JOIN k USING (test_id)"""


@query("j24_retest", _retest_sql())
def _(x: Data):
    return P.retest(_FINDINGS, x.segment("validation", "qty_surprise", "price_rel"), bounded=True)


_SCREENED = ("qty_surprise", "price_rel", "n_rank")
_SCREEN_H = (2, 5)


def _screen_sql() -> str:
    raw = [(f"{f}|{h}|", f, h, False, "TRUE") for f in _SCREENED for h in _SCREEN_H]
    net = [(f"{f}|{h}|sector", f, h, True, "TRUE") for f in _SCREENED for h in _SCREEN_H]
    buckets = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {h} AS horizon, {_TERCILE_OF} AS bucket, date, entity, {f} AS signal, fwd_{h} AS y FROM tp"
        for f in _SCREENED for h in _SCREEN_H)
    meta = ", ".join(f"('{p[0]}', '{p[1]}', {p[2]}, '{'sector' if p[3] else ''}')" for p in raw + net)
    return f"""WITH {_TERCILE}, {_tested(raw + net)},
{S.stats_sql('k', 'ts', 'signal', 'y', NW.format('horizon'), ['test_id', 'horizon'])},
bs AS (SELECT * FROM ({buckets}) WHERE bucket IS NOT NULL),
{S.stats_sql('c', 'bs', 'signal', 'y', NW.format('horizon'), ['feature', 'horizon', 'bucket'])},
fl AS (SELECT feature, horizon, coalesce(bool_or(t >= 2), FALSE) AND coalesce(bool_or(t <= -2), FALSE) AS flips FROM c GROUP BY 1, 2),
mt(test_id, feature, horizon, controls) AS (VALUES {meta}),
j AS (SELECT mt.*, k.mean, k.t, k.n_dates, fl.flips, (SELECT count(*) FROM mt) + (SELECT count(*) FROM c) AS nt FROM mt
  LEFT JOIN k ON k.test_id = mt.test_id LEFT JOIN fl ON fl.feature = mt.feature AND fl.horizon = mt.horizon),
h AS (SELECT j.*, greatest(3.0::DOUBLE, sqrt(2 * ln(nt))) AS bar, b.t AS raw_t FROM j
  JOIN (SELECT feature, horizon, t FROM j WHERE controls = '') b ON b.feature = j.feature AND b.horizon = j.horizon)
SELECT feature, {n('horizon', 'horizon')}, controls, {STATS}, {n('n_dates', 'n_dates')}, {n('nt', 'n_tests')}, {r('bar', 'hurdle_t')},
CASE WHEN t IS NULL THEN 'inconclusive' WHEN flips THEN 'unstable' WHEN abs(t) >= bar THEN 'informative'
WHEN controls <> '' AND abs(raw_t) >= bar THEN 'explained_by_control' ELSE 'not_informative' END AS label FROM h"""


@query("j25_screen", _screen_sql())
def _(x: Data):
    return P.screen(x.discovery(*_SCREENED), _SCREENED, _SCREEN_H, [(), ("sector",)], by="dollar_adv", bounded=True)


# ---------------------------------------------------------------- costs
def _legs_sql(source: str, sig: str, h: int, sign: int, spread: str = "half_spread") -> str:
    top, bottom = (5, 1) if sign > 0 else (1, 5)
    return f"""rb AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM {source}))
  WHERE i % {h} = 0),
lr AS (SELECT *, least(greatest(ceil(i / c * 5), 1), 5) AS q FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {sig}, entity) AS i,
  count(*) OVER (PARTITION BY date) AS c FROM {source} WHERE date IN (SELECT date FROM rb) AND {sig} IS NOT NULL)),
lg0 AS (SELECT *, CASE q WHEN {top} THEN 1 ELSE -1 END AS leg, fwd_{h} AS fwd FROM lr WHERE q IN ({top}, {bottom})),
lg1 AS (SELECT * FROM lg0 WHERE fwd IS NOT NULL),
lt AS (SELECT *, coalesce(CAST(floor(least(CASE WHEN dollar_adv IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY dollar_adv NULLS LAST)
  + (count(*) OVER (PARTITION BY date, dollar_adv) - 1) / 2) / count(dollar_adv) OVER (PARTITION BY date) END * 3, 2.999)) AS INT), 1) AS terc FROM lg1),
ls AS (SELECT *, least(greatest(coalesce({spread}, quantile_cont({spread}, 0.5) OVER (PARTITION BY date, terc),
  (SELECT quantile_cont({spread}, 0.5) FROM lt)), 0.0001), 0.02) AS hs, dense_rank() OVER (ORDER BY date) AS period FROM lt)"""


_LEGS = _legs_sql("disc", _X, 2, 1)


def _cost_rows(x: Data, h: int = 2):
    return x.discovery(_X).select(
        "date", "entity", F.col(_X).alias("sig"), F.lit(1).alias("sign"), F.lit(h).alias("h"), F.col(f"fwd_{h}").alias("fwd"),
        "half_spread", "dollar_adv", "vol20", "spread_quoted")


@query("k1_legs", f"WITH {_LEGS} SELECT {d('date', 'date')}, entity, {n('leg', 'leg')} FROM lg0")
def _(x: Data):
    return K.legs(_cost_rows(x), bounded=True).select("date", "entity", "leg")


@query("k2_fill_half_spread", f"WITH {_LEGS} SELECT {d('date', 'date')}, entity, {r('hs', 'hs')} FROM ls")
def _(x: Data):
    rows = K.legs(_cost_rows(x), bounded=True).where(F.col("fwd").isNotNull())
    return K.fill_half_spread(rows, bounded=True).select("date", "entity", "hs")


_PERIODS = f"""{_LEGS},
en AS (SELECT l.*, p.entity IS NULL AS entered FROM ls l LEFT JOIN ls p ON p.period = l.period - 1 AND p.leg = l.leg AND p.entity = l.entity),
gl AS (SELECT period, date, leg, avg(fwd) AS ret, avg(hs) AS hs, count(*) AS k, count(*) FILTER (entered) AS nw,
  coalesce(sum(hs) FILTER (entered), 0) AS nhs FROM en GROUP BY 1, 2, 3),
pr_ AS (SELECT period, date, max(ret) FILTER (leg = 1) - max(ret) FILTER (leg = -1) AS gross, 2 * sum(hs) AS rt, sum(2 * nhs / k) AS ch,
  CASE WHEN period > 1 THEN coalesce(max(nw / k) FILTER (leg = 1), 0) END AS turn FROM gl GROUP BY 1, 2)"""


def _period_columns(x: Data, *cols: str):
    rows = _cost_rows(x).withColumn("key", F.lit("a"))
    return K.period_returns(rows, ["key"], bounded=True).select("date", *cols)


@query("k3_period_returns", f"WITH {_PERIODS} SELECT {d('date', 'date')}, {r('gross', 'gross')}, {r('rt', 'cost_round_trip')} FROM pr_")
def _(x: Data):
    return _period_columns(x, "gross", "cost_round_trip")


@query("k4_changes_only", f"WITH {_PERIODS} SELECT {d('date', 'date')}, {r('ch', 'cost_changes_only')} FROM pr_")
def _(x: Data):
    return _period_columns(x, "cost_changes_only")


@query("k5_turnover", f"WITH {_PERIODS} SELECT {d('date', 'date')}, {r('turn', 'turnover')} FROM pr_")
def _(x: Data):
    return _period_columns(x, "turnover")


def _stat(c: str, name: str, h: int) -> str:
    py = 252 / h
    return ", ".join([r(f"avg({c}) * 1e4", f"{name}_mean_bp", 4), r(f"avg({c}) * {py}", f"{name}_ann_return", 4),
                      r(f"CASE WHEN stddev_samp({c}) > 0 THEN avg({c}) / stddev_samp({c}) * sqrt({py}) END", f"{name}_ann_sharpe", 4)])


# what a key of few periods has as null
_TOLD = (*(f"{a}_{b}" for a in ("gross", "net_round_trip", "net_changes_only") for b in ("mean_bp", "ann_return", "ann_sharpe")),
         "cost_round_trip_bp", "cost_changes_only_bp", "break_even_half_spread_bp", "turnover_long_leg", "names_per_leg",
         "median_half_spread_bp", "spread_source", "capacity_per_leg_usd")


def _portfolio_sql(h: int) -> str:
    return f"""g AS (SELECT *, gross - rt AS nrt, gross - ch AS nch FROM pr_ WHERE gross IS NOT NULL),
u AS (SELECT avg(coalesce(vol20, (SELECT quantile_cont(vol20, 0.5) FROM ls)) / sqrt(exp(dollar_adv))) AS unit FROM ls),
sz AS (SELECT avg(c) AS c FROM (SELECT count(*) AS c FROM ls GROUP BY date, leg)),
al AS (SELECT {{keys}}{n('count(*)', 'periods')}, {h}::BIGINT AS rebalance_every_sessions, {_stat('gross', 'gross', h)}, {_stat('nrt', 'net_round_trip', h)},
{_stat('nch', 'net_changes_only', h)}, (SELECT {r('avg(rt) * 1e4', 'c', 4)[:-5]} FROM pr_) AS cost_round_trip_bp,
{r('avg(ch) * 1e4', 'cost_changes_only_bp', 4)}, {r('avg(gross) / 4 * 1e4', 'break_even_half_spread_bp', 4)},
(SELECT {r('avg(turn)', 'c', 4)[:-5]} FROM pr_) AS turnover_long_leg, (SELECT {r('c', 'c', 4)[:-5]} FROM sz) AS names_per_leg,
(SELECT {r('quantile_cont(hs, 0.5) * 1e4', 'c', 4)[:-5]} FROM ls) AS median_half_spread_bp, 'roll' AS spread_source,
{{cap}}, (SELECT count(DISTINCT date) FROM ls) >= 10 AS ok FROM g)
SELECT * EXCLUDE (ok) REPLACE ({', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for c in _TOLD)}) FROM al"""


_CAP = "CASE WHEN avg(nrt) > 0 THEN greatest(least((SELECT c FROM sz) * pow(avg(nrt) / (4 * (SELECT unit FROM u)), 2), 1e11), 1e3) END"


@query("k6_portfolio", f"WITH {_PERIODS}, " + _portfolio_sql(2).format(keys="", cap=r(_CAP, "capacity_per_leg_usd", 4)), digits=4)
def _(x: Data):
    return K.portfolio(_cost_rows(x), bounded=True)


# sorted by the return itself and with costs at the floor, so that an edge is left to trade on
_CHEAP = _PERIODS.replace(_LEGS, _legs_sql("disc", "fwd_2", 2, 1, "half_spread * 0.0"))


@query("k7_capacity", f"WITH {_CHEAP}, " + _portfolio_sql(2).split(",\nal AS (")[0]
       + f" SELECT {r('avg(nrt) * 1e4', 'edge_bp', 4)}, {r(_CAP, 'capacity_per_leg_usd', 2)} FROM g", digits=4)
def _(x: Data):
    rows = _cost_rows(x).withColumns({"sig": F.col("fwd"), "half_spread": F.col("half_spread") * 0.0})
    p = K.portfolio(rows, bounded=True)
    return p.select(F.col("net_round_trip_mean_bp").alias("edge_bp"),
                    F.round("capacity_per_leg_usd", 2).alias("capacity_per_leg_usd"))


def _check_sql(segment: str, source: str, f: Finding) -> str:
    head, rows, sig = "", source, f.feature
    if f.controls:   # sectors: the signal is what they leave of the rank
        head, rows, sig = f"""sg AS (SELECT t.*, signal FROM {source} t JOIN (SELECT date, entity, round(y0 - avg(y0) OVER (PARTITION BY date, sector), 12) AS signal
  FROM (SELECT date, entity, sector, {_centered(sig, 'date')} AS y0, count(*) OVER (PARTITION BY date) AS k FROM {source}
    WHERE {sig} IS NOT NULL AND sector IS NOT NULL) WHERE k >= 20) USING (date, entity)), """, "sg", "signal"
    periods = _PERIODS.replace(_LEGS, _legs_sql(rows, sig, f.horizon, f.sign))
    keys = f"'{f.name}' AS finding, '{segment}' AS segment, "
    return f"""(WITH {head}{periods}, {_portfolio_sql(f.horizon).format(keys=keys, cap=r(_CAP, 'capacity_per_leg_usd', 4))})"""


@query("k8_cost_check", "\nUNION ALL ".join(f"SELECT * FROM {_check_sql(s, t, f)}" for f in _FINDINGS
                                            for s, t in (("discovery", "disc"), ("validation", "vali"))), digits=4)
def _(x: Data):
    segments = {s: x.segment(s, "qty_surprise", "price_rel") for s in ("discovery", "validation")}
    return K.cost_check(_FINDINGS, segments, bounded=True)
