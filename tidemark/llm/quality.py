"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Every document gets a vector of transformed statistics.  For each (language, source) the location and scatter of the
vectors are those of the subset of a share ``SUBSET`` whose covariance determinant is smallest, found by concentration
steps: distances to the present estimate, their SUBSET quantile, mean and covariance of the documents within it, and again,
from two starts, each until the determinant falls no more; the smaller one of the two holds.
A document whose squared Mahalanobis distance exceeds the chi-square quantile ``1 - TAIL`` is rejected.  Everything is
DataFrame expressions and mergeable aggregates: a group of any size is combined on the map side and never gathered.

Defined results: a null text is empty; a document without words has base_failed true; a null language or source is a value
of its own; a group with fewer than ``LEAST`` documents is judged by its language's estimate, a small language by the
estimate of all; with too few documents in all, the method rejects nothing.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import BLANKS, broadcast_checked, fresh, text_of, words_of
from tidemark.session import cut

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5
#: The rule that comes before the estimate.
FEWEST_WORDS, REPEAT_PERCENT = 10, 20
#: Share of a group in the concentrated subset, tail beyond which a document is an outlier, fall of half the logarithm of the
#: determinant from which a step counts (the quantile is a sketch), smallest group.
SUBSET, TAIL, FALL, LEAST = 0.75, 1e-7, 1e-3, 50
#: Components of the vector: log of the mean word length, root of the symbol, repeated-word and repeated-line shares, with
#: the standard deviation that is added to each (a statistic that is constant within a group must not reject a small change).
#: Beside a constant, about 14 % of repeated words and 24 % of repeated lines are too many; 20 % of words is the rule before.
VECTOR = {"x_length": 0.10, "x_symbols": 0.035, "x_repeats": 0.06, "x_lines": 0.08}
XS = list(VECTOR)


def _covered(marked: Column) -> Column:
    """How many words lie in a window that occurs more than once; marked: a column with the (hash, place) of the windows, sorted."""
    again = F.filter(marked, lambda x, k: (x["h"] == F.get(marked, k - 1)["h"]) | (x["h"] == F.get(marked, k + 1)["h"]))
    # a missing neighbour compares as null; null or true is true, null or false is no match
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(at, start, step, lambda a: a["n"])


def statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of the documents with the base statistics and the vector; one pass, no shuffle."""
    t = docs.select(*keep, text_of().alias("q_text"))
    t = t.withColumn("q_words", words_of(F.col("q_text")))
    t = t.withColumn("q_lines", F.filter(F.split("q_text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    t = t.withColumn("q_hashes", F.transform("q_words", lambda w: F.xxhash64(w)))
    h = F.col("q_hashes")
    window = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))
    t = t.withColumn("q_windows", F.slice(window, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))
    ordered = F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.withColumn("q_marked", F.when(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), ordered))
    t = t.select(
        *keep,
        F.size("q_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        (F.char_length("q_text") - F.char_length(F.regexp_replace("q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.size("q_lines").cast("long").alias("n_full_lines"),
        F.coalesce(_covered(F.col("q_marked")), F.lit(0)).cast("long").alias("n_repeat_words"))
    # no row has a partition below 0; the expression keeps a later filter from being moved below this point, where the
    # statistics would be computed again inside it
    here = F.spark_partition_id() < 0
    share = lambda a, b: F.sqrt(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)))
    return t.select(
        "*",
        ((F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")) | here).alias("base_failed"),
        F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)).alias("x_length"), share("n_symbols", "word_chars").alias("x_symbols"),
        share("n_repeat_words", "n_words").alias("x_repeats"), share("n_dup_lines", "n_full_lines").alias("x_lines"))


def chi_square_quantile(tail: float, dims: int = len(XS)) -> float:
    """The point beyond which a chi-square variable of an even number of degrees lies with probability ``tail``."""
    low, high = 0.0, 1e4
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if _above(mid, dims) > tail else (low, mid)
    return low


def _above(x: float, dims: int) -> float:
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))


def _keys(lang: str, source: str) -> list[Column]:
    """The group of a document on each level: its language and source, its language, all."""
    a, b = F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{source}`").cast("string").alias("s")
    return [F.to_json(F.struct(F.lit(0).alias("v"), a, b)), F.to_json(F.struct(F.lit(1).alias("v"), a)), F.lit('{"v":2}')]


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector to the estimate in m_i and the triangular factor l_i_j."""
    ys: list[Column] = []
    for i, x in enumerate(XS):
        y = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * ys[j]
        ys.append(y / F.col(f"l_{i}_{i}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def _factor(params: DataFrame, *more: str) -> DataFrame:
    """Adds the Cholesky factor of the covariances c_i_j, one column each; a row per group."""
    for i in range(len(XS)):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    params = params.withColumn("q_det", sum((F.log(f"l_{i}_{i}") for i in range(len(XS))), F.lit(0.0)))
    return params.select("q_key", "q_start", "q_n", "q_det", *more, *(f"m_{i}" for i in range(len(XS))), *(f"l_{i}_{j}" for i in range(len(XS)) for j in range(i + 1)))


def estimates(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A row per group (q_key) with its size, location m_i and factor l_i_j of the scatter, for all three levels."""
    rows = (stats.where(~F.col("base_failed")).withColumn("q_key", F.explode(F.array(*_keys(lang, source))))
            .select("q_key", *XS))
    floor = list(VECTOR.values())
    pairs = [(i, j) for i in range(len(XS)) for j in range(i + 1)]
    # the starts: medians and quartiles; mean and covariance of all
    quart = rows.groupBy("q_key").agg(
        F.count(F.lit(1)).alias("q_n"), *(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"p_{i}") for i, x in enumerate(XS)),
        *(F.avg(x).alias(f"a_{i}") for i, x in enumerate(XS)), *(F.covar_pop(XS[i], XS[j]).alias(f"v_{i}_{j}") for i, j in pairs))
    spread = lambda i: F.pow((F.col(f"p_{i}")[2] - F.col(f"p_{i}")[0]) / 1.349, F.lit(2)) + floor[i] ** 2
    quart = cut(quart)
    middle = quart.select("q_key", F.lit(0).alias("q_start"), "q_n", *(F.col(f"p_{i}")[1].cast("double").alias(f"m_{i}") for i in range(len(XS))),
                          *((spread(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs))
    whole = quart.select("q_key", F.lit(1).alias("q_start"), "q_n", *(F.col(f"a_{i}").alias(f"m_{i}") for i in range(len(XS))),
                         *((F.col(f"v_{i}_{j}") + (floor[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in pairs))
    # a start's own determinant is of no subset, so that any step from it counts
    params = cut(_factor(middle.unionByName(whole)).withColumn("q_det", F.lit(math.inf)))
    # the subset holds less than the whole spread of a normal sample; this makes up for it
    half = chi_square_quantile(1 - SUBSET)
    wide = SUBSET / (1 - _above(half, len(XS) + 2))
    ends: list[DataFrame] = []
    while True:
        far = rows.join(broadcast_checked(params, 400), "q_key").select("q_key", "q_start", "q_n", *XS, F.col("q_det").alias("q_was"), _distance().alias("d"))
        edge = cut(far.groupBy("q_key", "q_start").agg(F.percentile_approx("d", SUBSET, 1000).alias("edge")))
        near = far.join(broadcast_checked(edge, 100), ["q_key", "q_start"]).where(F.col("d") <= F.col("edge"))
        moments = near.groupBy("q_key", "q_start").agg(
            F.max("q_n").alias("q_n"), F.max("q_was").alias("q_was"), *(F.avg(x).alias(f"m_{i}") for i, x in enumerate(XS)),
            *((wide * F.covar_pop(XS[i], XS[j]) + (floor[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in pairs))
        step = cut(_factor(moments, "q_was"))
        on = step.where(F.col("q_det") < F.col("q_was") - FALL)
        ends.append(params.join(on.select("q_key", "q_start"), ["q_key", "q_start"], "left_anti"))
        params = cut(on.drop("q_was"))
        if params.isEmpty():
            break
    found = functools.reduce(DataFrame.unionByName, ends)
    cols = [c for c in found.columns if c not in ("q_key", "q_start")]
    return cut(found.groupBy("q_key").agg(F.min_by(F.struct(*cols), F.struct("q_det", "q_start")).alias("q_best")).select("q_key", "q_best.*").drop("q_det"))


def judged(stats: DataFrame, params: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The statistics with ``distance`` (squared; null where no estimate holds) and ``kept``.  The estimates, a row per group,
    join three times."""
    params = broadcast_checked(params.where(F.col("q_n") >= LEAST), 400)
    names = [c for c in params.columns if c not in ("q_key", "q_n")]
    out = stats
    for v, key in enumerate(_keys(lang, source)):
        level = params.select(F.col("q_key").alias(f"q_key_{v}"), F.struct(*names).alias(f"q_at_{v}"))
        out = out.withColumn(f"q_k_{v}", key).join(level, F.col(f"q_k_{v}") == F.col(f"q_key_{v}"), "left")
    out = out.withColumn("q_at", F.coalesce("q_at_0", "q_at_1", "q_at_2"))
    out = out.select(*stats.columns, *(F.col("q_at")[n].alias(n) for n in names)).withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_quantile(TAIL), F.lit(True))
    return out.withColumn("kept", kept).drop(*names)


def document_quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source of every document with its statistics, squared distance and verdict."""
    stats = cut(statistics(docs, ("doc_id", "lang", "source")))
    return judged(stats, estimates(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is kept, with their own columns.  Statistics are computed once to estimate and once more
    to judge, so texts are never shuffled."""
    whole = fresh(docs, "q_row")
    stats = statistics(docs, ("lang", "source"))
    params = estimates(cut(stats))
    again = statistics(docs.select("text", F.struct(*(f"`{c}`" for c in docs.columns)).alias(whole), F.col("lang").alias("q_lang"), F.col("source").alias("q_source")),
                       (whole, "q_lang", "q_source"))
    return judged(again, params, "q_lang", "q_source").where("kept").select(f"`{whole}`.*")
