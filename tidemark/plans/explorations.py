"""Queries of inventory C: exploration, breaks, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import period
from tidemark.operators import breaks as B
from tidemark.operators import explore as X
from tidemark.operators import flags as G
from tidemark.plans import statsql
from tidemark.plans.bindings import Data
from tidemark.plans.registry import d, n, query, r

_UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


@query("c1_period", "\nUNION ALL ".join(
    f"SELECT '{f}' AS freq, {d(f'date_trunc({chr(39)}{u}{chr(39)}, o_orderdate)', 'period')}, {n('count(*)', 'n')} "
    "FROM orders GROUP BY 2" for f, u in _UNITS.items()))
def _(x: Data):
    o = x.t("orders", "o_orderdate")
    freqs = F.explode(F.array(*[F.struct(F.lit(f).alias("freq"), period(F.col("o_orderdate"), f).alias("period"))
                                for f in _UNITS]))
    return o.select(freqs.alias("p")).groupBy("p.freq", "p.period").agg(F.count(F.lit(1)).alias("n"))


_COVERAGE = """o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS p, o_custkey AS e FROM orders),
per AS (SELECT p, count(*) AS k, count(DISTINCT e) AS ents FROM o GROUP BY 1),
sp AS (SELECT e, min(p) AS a, max(p) AS b FROM o GROUP BY 1),
cov AS (SELECT per.*, coalesce(x.c, 0) AS new, coalesce(y.c, 0) AS lost FROM per
  LEFT JOIN (SELECT a, count(*) AS c FROM sp GROUP BY 1) x ON p = a
  LEFT JOIN (SELECT b, count(*) AS c FROM sp GROUP BY 1) y ON p = b)"""


@query("c2_coverage", f"""WITH {_COVERAGE} SELECT {d('p', 'period')}, {n('k', 'rows')}, {n('ents', 'entities')},
{n('new', 'new')}, {n('lost', 'lost')} FROM cov""")
def _(x: Data):
    return X.coverage(x.t("orders"), "o_orderdate", "o_custkey", "M")


@query("c2_coverage_summary", f"""WITH {_COVERAGE} SELECT {n('count(*)', 'n_periods')}, {d('min(p)', 'first_period')},
{d('max(p)', 'last_period')}, {n('sum(k)', 'n_rows')}, {n('min(ents)', 'min_value')},
{r('median(ents)', 'median_value')}, {n('max(ents)', 'max_value')},
(SELECT {d('p', 'm')[:-5]} FROM cov ORDER BY ents, p LIMIT 1) AS min_at,
(SELECT {d('p', 'm')[:-5]} FROM cov ORDER BY ents DESC, p LIMIT 1) AS max_at,
{r('stddev_samp(ents) / avg(ents)', 'cv')},
{r('median(new) FILTER (p <> (SELECT min(p) FROM cov))', 'median_new')},
{r('median(lost) FILTER (p <> (SELECT max(p) FROM cov))', 'median_lost')} FROM cov""")
def _(x: Data):
    return X.coverage_summary(X.coverage(x.t("orders"), "o_orderdate", "o_custkey", "M"))


_DIPS = """per AS (SELECT CAST(o_orderdate AS DATE) AS p, count(DISTINCT o_custkey) AS v FROM orders GROUP BY 1),
ix AS (SELECT *, row_number() OVER (ORDER BY p) AS i, greatest(3, least(60, count(*) OVER () // 10)) AS w FROM per),
ar AS (SELECT a.p, a.v, quantile_cont(b.v, 0.5) AS typ FROM ix a JOIN ix b ON abs(a.i - b.i) <= a.w
  GROUP BY 1, 2 HAVING count(*) >= 3),
dips AS (SELECT * FROM ar WHERE v < 0.8 * typ)"""


def _dips(x: Data):
    return X.coverage_dips(X.coverage(x.t("orders"), "o_orderdate", "o_custkey", "D"))


@query("c3_coverage_dips", f"WITH {_DIPS} SELECT {d('p', 'period')}, {r('v', 'value')}, {r('typ', 'typical')} FROM dips")
def _(x: Data):
    return _dips(x)


def _quantity_series(x: Data):
    li = x.t("lineitem", "l_shipdate", "l_quantity", "l_returnflag")
    return li.groupBy(F.col("l_returnflag").alias("series"), period(F.col("l_shipdate"), "M").alias("period")).agg(
        F.sum("l_quantity").alias("value"))


@query("c4_shift_scores", f"""WITH s AS (SELECT l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS p,
  sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY p) - 1 AS pos, count(*) OVER (PARTITION BY series) AS c,
  list(v) OVER (PARTITION BY series ORDER BY p ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS b,
  list(v) OVER (PARTITION BY series ORDER BY p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS a FROM s),
m AS (SELECT *, list_median(b) AS mb, list_median(a) AS ma FROM w WHERE pos >= 6 AND pos <= c - 6),
z AS (SELECT *, list_median(list_concat(list_transform(b, lambda t: abs(t - mb)), list_transform(a, lambda t: abs(t - ma))))
  AS mad FROM m)
SELECT series, {d('p', 'period')}, {n('pos', 'pos')}, {r('mb', 'before_median')}, {r('ma', 'after_median')},
{r('abs(ma - mb) / greatest(1.4826::DOUBLE * mad, 1e-9 + 0.01::DOUBLE * abs(mb))', 'score')} FROM z""")
def _(x: Data):
    return B.shift_scores(_quantity_series(x), 6)


_QUANTITY = """sv AS (SELECT l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS p, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"""
_BREAKS = f"""{r('before_median', 'before_median')}, {r('after_median', 'after_median')}, {r('change_pct', 'change_pct')}, {r('score', 'score')} FROM br"""


@query("c5_level_shifts", f"WITH RECURSIVE {_QUANTITY}, {statsql.shifts_sql(6, 1.0)} SELECT series, {d('period', 'period')}, {_BREAKS}")
def _(x: Data):
    return B.level_shifts(_quantity_series(x), 6, min_score=1.0)


_GAPPY = """g AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS p, nullif(l_discount, 0.05) AS disc,
  CASE WHEN year(l_shipdate) >= 1997 THEN nullif(l_tax, 0.02) ELSE l_tax END AS tax, l_quantity AS qty,
  CASE l_returnflag WHEN 'N' THEN ' ' WHEN 'A' THEN NULL ELSE l_returnflag END AS code FROM lineitem)"""


def _gappy(x: Data):
    li = x.t("lineitem")
    tax = F.when(F.year("l_shipdate") >= 1997, F.nullif(F.col("l_tax"), F.lit(0.02))).otherwise(F.col("l_tax"))
    code = F.when(F.col("l_returnflag") == "N", " ").when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    return li.select("l_shipdate", "l_suppkey", F.nullif(F.col("l_discount"), F.lit(0.05)).alias("disc"),
                     tax.alias("tax"), F.col("l_quantity").alias("qty"), code.alias("code"))


def _missing_sql(f: str, kind: str) -> str:
    zero = f"count(*) FILTER ({f} = 0)" if kind == "num" else "NULL"
    empty = f"count(*) FILTER (trim({f}) = '')" if kind == "text" else "NULL"
    return f"""SELECT '{f}' AS field, {n('count(*)', 'n_rows')}, {n(f'count(*) - count({f})', 'null_count')},
{n(zero, 'zero_count')}, {n(empty, 'empty_count')}, {r(f'(count(*) - count({f})) / count(*)', 'null_share')},
{r(f'{zero} / count(*)', 'zero_share')}, {r(f'{empty} / count(*)', 'empty_share')} FROM g"""


_MISSING = "\nUNION ALL ".join(_missing_sql(f, k) for f, k in (("disc", "num"), ("tax", "num"), ("qty", "num"),
                                                             ("code", "text")))


@query("c6_missingness", f"WITH {_GAPPY} {_MISSING}")
def _(x: Data):
    return X.missingness(_gappy(x), ["disc", "tax", "qty", "code"])


def _over_time_sql(f: str, num: bool) -> str:
    z = f"avg(coalesce({f} = 0, FALSE)::INT)" if num else "NULL::DOUBLE"
    return f"""SELECT '{f}' AS field, {r('max(nu)', 'null_max')},
CASE WHEN max(nu) > 0 THEN {d('arg_max(p, ROW(nu, -epoch(p)))', 'm')[:-5]} END AS null_max_at,
{r('max(ze)', 'zero_max')}, CASE WHEN max(ze) > 0 THEN {d('arg_max(p, ROW(ze, -epoch(p)))', 'm')[:-5]} END AS zero_max_at,
{r('median(ze)', 'zero_median')}
FROM (SELECT p, avg(({f} IS NULL)::INT) AS nu, {z} AS ze FROM g GROUP BY 1)"""


_OVER_TIME = "\nUNION ALL ".join(_over_time_sql(f, k) for f, k in (("disc", True), ("tax", True), ("code", False)))


@query("c7_missingness_over_time", f"WITH {_GAPPY} {_OVER_TIME}")
def _(x: Data):
    return X.missingness_over_time(_gappy(x), ["disc", "tax", "code"], "l_shipdate", "M")


_PRESENCE = """pr0 AS (SELECT DISTINCT l_suppkey AS e, CAST(l_shipdate AS DATE) AS day FROM lineitem),
pc AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM pr0)),
pe AS (SELECT e, count(*) AS k, max(i) - min(i) + 1 AS span FROM pr0 JOIN pc USING (day) GROUP BY 1)"""
_PRESENCE_ROW = f"""SELECT (SELECT {n('count(*)', 'c')[:-5]} FROM pc) AS calendar_dates, {n('count(*)', 'entities')},
{r('sum(span - k) / sum(span)', 'absent_inside_span_share')}, {r('avg((k = span)::INT)', 'always_present_share')},
{r('avg((span = (SELECT count(*) FROM pc))::INT)', 'whole_calendar_share')},
{r('quantile_cont(k / span, 0.5)', 'median_presence')} FROM pe"""


@query("c8_presence", f"WITH {_PRESENCE} {_PRESENCE_ROW}")
def _(x: Data):
    return X.presence(x.t("lineitem", "l_shipdate", "l_suppkey"), "l_shipdate", "l_suppkey")


def _distribution_sql(rows: str) -> str:
    q = ", ".join(r(f"quantile_cont(x, {p})", name) for name, p in X.DISTRIBUTION_PROBS.items())
    return f"""v AS ({rows}), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, min(x) AS lo,
  max(x) AS hi, skewness(x) AS sk FROM v),
s AS (SELECT count(x) AS n, count(*) - count(x) AS nn, count(*) FILTER (x = 0) / count(x) AS z,
  count(*) FILTER (x < 0) / count(x) AS neg, count(*) FILTER (x = hi) / count(x) AS mx, count(*) FILTER (x = lo) / count(x)
  AS mn, CASE WHEN any_value(b - a) > 0 THEN count(*) FILTER (x > b + 3 * (b - a) OR x < a - 3 * (b - a)) / count(x)
  ELSE 0 END AS far, any_value(hi <> lo) AS spread, any_value(sk) AS sk FROM v, q)
SELECT {q}, {n('any_value(s.n)', 'n')}, {n('any_value(nn)', 'n_null')}, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')},
{r('skewness(x)', 'skew')}, {r('kurtosis(x)', 'kurtosis')}, {n('count(*) FILTER (x = 0)', 'zero_count')},
bool_and(x % 1 = 0) AS integer_valued, {r('any_value(z)', 'zero_share')}, {r('any_value(neg)', 'negative_share')},
{r('any_value(mx)', 'share_at_max')}, {r('any_value(mn)', 'share_at_min')}, {r('any_value(far)', 'far_outlier_share')},
any_value(neg = 0 AND sk > 2) AS hint_right_skewed, any_value(z > 0.05) AS hint_zero_mass,
any_value(mx > 0.01 AND spread) AS hint_capped, any_value(far > 0.01) AS hint_heavy_tails,
any_value(mx >= 0.01 AND spread) AS mass_at_max FROM v, s"""


@query("c9_distribution", f"WITH {_distribution_sql('SELECT l_quantity AS x FROM lineitem')}")
def _(x: Data):
    return X.distribution(x.t("lineitem", "l_quantity"), "l_quantity")


@query("c9_distribution_ratio",
       f"WITH {_distribution_sql('SELECT l_extendedprice / nullif(l_discount, 0) AS x FROM lineitem')}")
def _(x: Data):
    return X.distribution(x.t("lineitem", "l_extendedprice", "l_discount"), "l_extendedprice", "l_discount")


@query("c10_distribution_by_period", f"""SELECT {d("date_trunc('year', l_shipdate)", 'period')}, {n('count(l_extendedprice)', 'n')},
{r('quantile_cont(l_extendedprice, 0.1)', 'p10')}, {r('quantile_cont(l_extendedprice, 0.5)', 'median')},
{r('quantile_cont(l_extendedprice, 0.9)', 'p90')} FROM lineitem GROUP BY 1""")
def _(x: Data):
    return X.distribution_by_period(x.t("lineitem", "l_shipdate", "l_extendedprice"), "l_extendedprice", "l_shipdate")


@query("c11_histogram", f"""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi,
  (max(o_totalprice) - min(o_totalprice)) / 60 AS w FROM orders),
h AS (SELECT lo, hi, w, least(floor((o_totalprice - lo) / w), 59) AS bin FROM orders, b)
SELECT {n('bin', 'bin')}, {r('any_value(lo + bin * w)', 'lo')}, {r('any_value(lo + (bin + 1) * w)', 'hi')},
{n('count(*)', 'n')} FROM h GROUP BY bin""")
def _(x: Data):
    return X.histogram(x.t("orders", "o_totalprice"), "o_totalprice", 60)


@query("c11_histogram_clipped", f"""WITH v0 AS (SELECT CASE WHEN s.l THEN CASE WHEN x > 0 THEN log10(x) END ELSE x END AS x
  FROM (SELECT l_extendedprice / nullif(l_discount, 0) AS x FROM lineitem),
  (SELECT min(x) >= 0 AND skewness(x) > 2 AS l FROM (SELECT l_extendedprice / nullif(l_discount, 0) AS x FROM lineitem)) s),
q AS (SELECT quantile_cont(x, 0.005) AS a, quantile_cont(x, 0.995) AS b FROM v0),
v AS (SELECT greatest(least(x, b), a) AS x FROM v0, q WHERE x IS NOT NULL),
b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM v),
h AS (SELECT lo, w, least(floor((x - lo) / w), 19) AS bin FROM v, b)
SELECT {n('bin', 'bin')}, {r('any_value(lo + bin * w)', 'lo')}, {r('any_value(lo + (bin + 1) * w)', 'hi')},
{n('count(*)', 'n')} FROM h GROUP BY bin""")
def _(x: Data):
    return X.histogram(x.t("lineitem", "l_extendedprice", "l_discount"), "l_extendedprice", 20, "l_discount",
                       clip=(.005, .995))


@query("c11_ecdf", f"""SELECT {r('l_quantity', 'x')}, {n('sum(count(*)) OVER (ORDER BY l_quantity)', 'n_at_or_below')},
{r('sum(count(*)) OVER (ORDER BY l_quantity) / sum(count(*)) OVER ()', 'share')} FROM lineitem GROUP BY l_quantity""")
def _(x: Data):
    return X.ecdf(x.t("lineitem", "l_quantity"), "l_quantity")


@query("c12_part_exceeds_whole", f"""SELECT {n('count(*) FILTER (l_discount <> 0 AND l_tax / nullif(l_discount, 0) > 1)', 'n_rows_over')},
{n('count(*)', 'n_rows')}, 'l_tax' AS remedy_column, '>col' AS remedy_op, 'l_discount' AS remedy_value FROM lineitem""")
def _(x: Data):
    return X.part_exceeds_whole(x.t("lineitem", "l_tax", "l_discount"), "l_tax", "l_discount")


_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


@query("c13_update_dynamics", f"""WITH o AS (SELECT l_suppkey AS e, CAST(l_shipdate AS DATE) AS t, l_quantity AS v,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, {', '.join(_TIE)}) AS i FROM lineitem),
p AS (SELECT *, lag(v) OVER w AS v1, lag(v, 5) OVER w AS v5, lag(v, 20) OVER w AS v20, t - lag(t) OVER w AS gap FROM o
  WINDOW w AS (PARTITION BY e ORDER BY i)),
ch AS (SELECT t - lag(t) OVER (PARTITION BY e ORDER BY i) AS gap FROM p WHERE v1 IS NOT NULL AND v <> v1)
SELECT {n('count(*)', 'n_obs')}, {r('count(*) FILTER (v = v1) / count(v1)', 'share_unchanged')},
{r('corr(v, v1)', 'acf_lag1')}, {r('corr(v, v5)', 'acf_lag5')}, {r('corr(v, v20)', 'acf_lag20')},
{n('count(DISTINCT e)', 'n_entities')}, {r('min(gap)', 'days_between_obs_min')}, {r('median(gap)', 'days_between_obs_median')},
{r('max(gap)', 'days_between_obs_max')}, (SELECT {r('min(gap)', 'g')[:-5]} FROM ch) AS days_between_changes_min,
(SELECT {r('median(gap)', 'g')[:-5]} FROM ch) AS days_between_changes_median,
(SELECT {r('max(gap)', 'g')[:-5]} FROM ch) AS days_between_changes_max FROM p""")
def _(x: Data):
    li = x.t("lineitem", "l_suppkey", "l_shipdate", *_TIE)
    return X.update_dynamics(li, "l_suppkey", "l_shipdate", "l_quantity", tie=_TIE)


@query("c14_variance_split", f"""WITH v AS (SELECT l_suppkey AS e, l_shipdate AS t,
  ln(1 + greatest(l_extendedprice / nullif(l_quantity, 0), 0)) AS x FROM lineitem),
m AS (SELECT x, avg(x) OVER (PARTITION BY e) AS em, avg(x) OVER (PARTITION BY t) AS tm FROM v)
SELECT {n('count(*)', 'n_obs')}, {r('var_samp(x)', 'total_variance')}, {r('var_samp(em) / var_samp(x)', 'share_between_entities')},
{r('var_samp(x - em) / var_samp(x)', 'share_within_entities')}, {r('var_samp(tm) / var_samp(x)', 'share_common_over_time')},
CASE WHEN var_samp(em) > var_samp(x - em) THEN 'mostly differs across entities (cross-sectional)'
ELSE 'mostly moves within entities over time' END AS reading FROM m""")
def _(x: Data):
    li = x.t("lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return X.variance_split(li, "l_suppkey", "l_shipdate", "l_extendedprice", log1p=True, denominator="l_quantity")


_STATS = """ps AS (UNPIVOT (SELECT p AS period, CAST(count(*) AS DOUBLE) AS "rows", median(tax) AS median,
  quantile_cont(tax, 0.9) AS p90, CAST((count(*) - count(tax)) / count(*) AS DOUBLE) AS null_share,
  CAST(count(DISTINCT e) AS DOUBLE) AS entities
  FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS p, l_suppkey AS e,
    CASE WHEN year(l_shipdate) >= 1999 THEN nullif(l_tax, 0.02) ELSE l_tax END AS tax FROM lineitem) GROUP BY 1)
  ON "rows", median, p90, null_share, entities INTO NAME series VALUE value)"""


def _late_gaps(x: Data):
    li = x.t("lineitem", "l_shipdate", "l_suppkey", "l_tax")
    tax = F.when(F.year("l_shipdate") >= 1999, F.nullif(F.col("l_tax"), F.lit(0.02))).otherwise(F.col("l_tax"))
    return li.select("l_shipdate", "l_suppkey", tax.alias("tax"))


def _late_stats(x: Data):
    return B.period_stats(_late_gaps(x), "l_shipdate", "tax", "l_suppkey", "M")


@query("c15_period_stats", f"WITH {_STATS} SELECT series, {d('period', 'period')}, {r('value', 'value')} FROM ps")
def _(x: Data):
    return _late_stats(x)


@query("c15_structural_breaks", f"""WITH RECURSIVE {_STATS}, sv AS (SELECT series, period AS p, value AS v FROM ps),
{statsql.shifts_sql(5, 4.0)} SELECT series, {d('period', 'period')}, {_BREAKS}""")
def _(x: Data):
    return B.structural_breaks(_late_gaps(x), "l_shipdate", "tax", "l_suppkey", "M", window=5)


_ZERO = """zx AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period) - 1 AS i,
  count(*) OVER (PARTITION BY series) AS c FROM ps),
zu AS (SELECT series, min(period) FILTER (value > 0) AS starts FROM zx GROUP BY 1
  HAVING bool_and(i >= floor(c / 2) OR value = 0) AND min(period) FILTER (value > 0) IS NOT NULL)"""


@query("c16_zero_until", f"WITH {_STATS}, {_ZERO} SELECT series, {d('starts', 'starts')} FROM zu")
def _(x: Data):
    return B.zero_until(_late_stats(x))


@query("c16_break_clusters", f"""WITH RECURSIVE {_QUANTITY}, {statsql.shifts_sql(6, 1.0)},
dd AS (SELECT period, sum(CASE WHEN gap <= 62 THEN 0 ELSE 1 END) OVER (ORDER BY period) AS cluster
  FROM (SELECT period, period - lag(period) OVER (ORDER BY period) AS gap FROM (SELECT DISTINCT period FROM br))),
nc AS (SELECT br.series, period, cluster, min(period) OVER (PARTITION BY cluster) AS start FROM br JOIN dd USING (period))
SELECT {n('cluster', 'cluster')}, {d('min(period)', 'first_date')}, {d('max(period)', 'last_date')},
string_agg(DISTINCT series, ', ' ORDER BY series) FILTER (period - start <= 62) AS statistics,
string_agg(DISTINCT strftime(period, '%Y-%m'), ', ' ORDER BY strftime(period, '%Y-%m')) AS months FROM nc GROUP BY cluster""")
def _(x: Data):
    return B.break_clusters(B.level_shifts(_quantity_series(x), 6, min_score=1.0))


_KEY = ["l_orderkey", "l_linenumber"]
@query("c17_key_check", f"""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2),
dup AS (SELECT sum(c) AS c FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate HAVING count(*) > 1))
SELECT {n('sum(c)', 'n_rows')}, {n('count(*)', 'n_distinct_keys')},
{n('coalesce(sum(c) FILTER (c > 1), 0)', 'rows_with_duplicated_key')},
{n('coalesce(sum(c) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0)', 'null_in_key_rows')},
(SELECT {n('coalesce(c, 0)', 'e')[:-5]} FROM dup) AS exact_duplicate_rows, max(c) <= 1 AS key_is_unique FROM k""")
def _(x: Data):
    return X.key_check(x.t("lineitem"), _KEY)


@query("c17_duplicate_examples", f"""SELECT {n('l_orderkey', 'l_orderkey')}, {n('l_linenumber', 'l_linenumber')},
{n('l_partkey', 'l_partkey')} FROM (SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
  SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 8)""")
def _(x: Data):
    return X.duplicate_examples(x.t("lineitem", "l_orderkey", "l_linenumber", "l_partkey"), _KEY)


@query("c18_redundant_key_columns", """SELECT 'o_orderkey' AS "column", TRUE AS key_is_unique,
(SELECT max(c) <= 1 FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)) AS redundant
UNION ALL SELECT 'o_custkey', TRUE, (SELECT max(c) <= 1 FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey))""")
def _(x: Data):
    return X.redundant_key_columns(x.t("orders", "o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])


_LIFE = """lf AS (SELECT o_custkey AS e, count(*) AS k,
  date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25::DOUBLE AS yr
  FROM orders GROUP BY 1), lo AS (SELECT *, k / greatest(yr, 1 / 12) AS f FROM lf),
ey AS (SELECT year(o_orderdate) AS y, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1),
h AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b, count(*) AS k,
  count(DISTINCT CAST(o_orderdate AS DATE)) AS dd,
  round(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25::DOUBLE, 2) AS hy
  FROM orders)"""


@query("c19_breadth", f"""WITH {_LIFE} SELECT {n('count(*)', 'n_entities')}, {r('avg((yr < 1)::INT)', 'under_1y_share')},
(SELECT {d('a', 'a')[:-5]} FROM h) AS history_start, (SELECT {d('b', 'b')[:-5]} FROM h) AS history_end,
(SELECT {r('hy', 'y')[:-5]} FROM h) AS history_years, (SELECT {n('k', 'k')[:-5]} FROM h) AS n_rows,
(SELECT {n('dd', 'k')[:-5]} FROM h) AS distinct_dates,
(SELECT {r('median(c)', 'k')[:-5]} FROM ey) AS entities_per_year_median,
{r('min(yr)', 'lifetime_years_min')}, {r('quantile_cont(yr, 0.5)', 'lifetime_years_median')}, {r('max(yr)', 'lifetime_years_max')},
{r('min(f)', 'obs_per_entity_year_min')}, {r('quantile_cont(f, 0.5)', 'obs_per_entity_year_median')},
{r('max(f)', 'obs_per_entity_year_max')},
(SELECT CASE WHEN hy < 2 THEN 'weak' WHEN hy <= 5 THEN 'moderate' ELSE 'strong' END FROM h) AS history_reading,
(SELECT CASE WHEN median(c) < 100 THEN 'weak' WHEN median(c) <= 1000 THEN 'moderate' ELSE 'strong' END FROM ey)
AS breadth_reading FROM lo""")
def _(x: Data):
    return X.breadth(x.t("orders", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")


@query("c19_entities_per_year", f"""SELECT {n('year(o_orderdate)', 'year')}, {n('count(DISTINCT o_custkey)', 'entities')}
FROM orders GROUP BY year(o_orderdate)""")
def _(x: Data):
    return X.entities_per_year(x.t("orders", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")


@query("c20_concentration", f"""WITH w AS (SELECT CAST(o_custkey AS VARCHAR) AS e, round(sum(o_totalprice), 2) AS w FROM orders
  GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY w DESC, e) AS i, sum(w) OVER () AS t FROM w)
SELECT {r('sum(w) FILTER (i <= 10) / any_value(t)', 'top10_share')}, {r('sum(w) FILTER (i <= 100) / any_value(t)', 'top100_share')},
{r('sum(w * w) / (any_value(t) * any_value(t))', 'hhi')}, string_agg(e, ', ' ORDER BY i) FILTER (i <= 10) AS top_names FROM k""")
def _(x: Data):
    return X.concentration(x.t("orders", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice")


# multi-valued cells: the words of a part's name, shipped by month; blue parts only exist from 1997 on
_WORDS = """cells AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS p,
  CASE WHEN year(l_shipdate) < 1997 THEN replace(p_name, 'blue', 'grey') ELSE p_name END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey),
rw AS (SELECT p, count(*) AS k FROM cells GROUP BY 1),
cw AS (SELECT p, trim(v) AS v, count(*) AS c FROM (SELECT p, unnest(string_split(name, ' ')) AS v FROM cells) GROUP BY 1, 2),
sh AS (SELECT cw.p, v, c, c / k AS s FROM cw JOIN rw USING (p)),
mix AS (SELECT v AS value, sum(s) / (SELECT count(DISTINCT p) FROM sh) AS m, min(p) AS a, max(p) AS b,
  min(p) <> (SELECT min(p) FROM sh) AS late, max(p) <> (SELECT max(p) FROM sh) AS gone FROM sh GROUP BY 1)"""


def _named_lines(x: Data):
    li = x.t("lineitem", "l_partkey", "l_shipdate").join(
        x.t("part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.year("l_shipdate") < 1997, F.replace("p_name", F.lit("blue"), F.lit("grey"))).otherwise(
        F.col("p_name"))
    return li.select("l_shipdate", name.alias("name"))


@query("c21_category_shares", f"""WITH {_WORDS} SELECT {d('p', 'period')}, v AS value, {n('c', 'n')}, {r('s', 'share')} FROM sh""")
def _(x: Data):
    return X.category_shares(_named_lines(x), "l_shipdate", "name", "Q", " ")


@query("c21_category_mix", f"""WITH {_WORDS} SELECT value, {r('m', 'mean_share')}, {d('a', 'first_seen')}, {d('b', 'last_seen')},
late AS appears_after_start, gone AS gone_before_end, regexp_matches(value, '[,;|]') AS multi_valued FROM mix""")
def _(x: Data):
    return X.category_mix(_named_lines(x), "l_shipdate", "name", "Q", " ")


_PCT = "CAST(CAST(round(100 * {0}, 0) AS INTEGER) AS VARCHAR)"


@query("c22_flags", f"""WITH {_DIPS}, {_GAPPY}, {_PRESENCE}, {_WORDS}, {_STATS}, {_ZERO},
mi AS ({_MISSING}), ot AS ({_OVER_TIME}),
pz AS ({_PRESENCE_ROW}),
pw AS (SELECT count(*) FILTER (l_discount <> 0 AND l_tax / nullif(l_discount, 0) > 1) AS c FROM lineitem),
dk AS (SELECT count(*) AS keys, sum(c) AS c FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber
  HAVING count(*) > 1))
SELECT 'coverage_dip_' || strftime(p, '%Y-%m') AS id, 'coverage in the period starting ' || strftime(p, '%Y-%m-%d') || ' is '
  || {_PCT.format('(1 - v / typ)')} || '% below its typical level' AS fact, NULL AS remedy
  FROM dips
UNION ALL SELECT 'zeros_' || field, field || ' is zero in ' || {_PCT.format('zero_share')} || '% of rows', NULL FROM mi
  WHERE zero_share >= 0.2
UNION ALL SELECT 'zero_spike_' || field, field || ' is zero in ' || {_PCT.format('zero_max')}
  || '% of rows in the period starting ' || zero_max_at, NULL FROM ot WHERE zero_max >= greatest(0.05, 3 * zero_median)
UNION ALL SELECT 'absent_rows', 'entities have no row on ' || CAST(CAST(round(100 * absent_inside_span_share, 1)
  AS DECIMAL(12, 1)) AS VARCHAR) || '% of dates inside their own history', NULL FROM pz
  WHERE absent_inside_span_share >= 0.02
UNION ALL SELECT 'part_exceeds_whole', 'l_tax exceeds l_discount in ' || c || ' rows',
  'flag_rows or drop_rows where l_tax >col l_discount' FROM pw WHERE c > 0
UNION ALL SELECT 'duplicate_keys', CAST(c AS BIGINT) || ' rows share a key (0 exact duplicates)', NULL FROM dk WHERE c > 0
UNION ALL SELECT 'starts_' || series, series || ' is zero until ' || strftime(starts, '%Y-%m-%d') || ', then non-zero', NULL FROM zu
UNION ALL SELECT 'new_name_' || value, 'name value ' || value || ' first appears ' || strftime(a, '%Y-%m-%d'), NULL FROM mix
  WHERE late AND NOT regexp_matches(value, '[,;|]')""")
def _(x: Data):
    gappy, li = _gappy(x), x.t("lineitem")
    return G.all_flags(
        G.coverage_flags(_dips(x)),
        G.missing_flags(X.missingness(gappy, ["disc", "tax", "qty", "code"]),
                        X.missingness_over_time(gappy, ["disc", "tax", "code"], "l_shipdate", "M"),
                        X.presence(li, "l_shipdate", "l_suppkey")),
        G.part_flags(X.part_exceeds_whole(li, "l_tax", "l_discount")), G.key_flags(X.key_check(li, _KEY)),
        G.break_flags(B.zero_until(_late_stats(x))),
        G.category_flags(X.category_mix(_named_lines(x), "l_shipdate", "name", "Q", " "), "name"))
