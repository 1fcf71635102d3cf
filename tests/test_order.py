"""Order statistics and as-of joins against pandas, with every group forced to be split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidemark.operators import order as O
from tidemark.operators import scan
from tidemark.operators.scan import running_totals
from tidemark.session import cut


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values are tied, missing and negative."""
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)),
                        "x": np.where(rng.random(n) < 0.3, 0.0, np.round(rng.normal(0, 5, n), 1)), "i": range(n)})
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()
    return pdf, df


@pytest.mark.parametrize("split", [1, 7, None])
def test_quantiles_equal_pandas(skewed, split):
    pdf, df = skewed
    got = O.quantiles(df, ["k"], "x", {"lo": .1, "mid": .5, "hi": .93}, ranges=split).toPandas().set_index("k")
    want = pdf.groupby("k").x.quantile([.1, .5, .93]).unstack()
    for name, q in (("lo", .1), ("mid", .5), ("hi", .93)):
        np.testing.assert_allclose(got[name].sort_index(), want[q].sort_index())
    assert got.n.to_dict() == pdf.groupby("k").x.count().to_dict()


@pytest.mark.parametrize("split,bounded", [(9, False), (None, False), (None, True)])
def test_percentile_rank_equals_pandas(skewed, split, bounded):
    pdf, df = skewed
    got = O.with_rank(df, ["k"], "x", "r", ranges=split, bounded=bounded).toPandas().set_index("i").r.sort_index()
    want = pdf.groupby("k").x.rank(pct=True)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float))


def test_rank_columns_in_one_pass(skewed):
    pdf, df = skewed
    d = df.select(F.col("k").alias("date"), F.col("i").alias("entity"), "x", (F.col("x") * F.col("i")).alias("y"))
    got = O.rank_columns(d, ["date"], ["x", "y"], ranges=6).toPandas().set_index("entity").sort_index()
    np.testing.assert_allclose(got.x_rank.to_numpy(float), pdf.groupby("k").x.rank(pct=True).to_numpy(float))
    np.testing.assert_allclose(got.y_rank.to_numpy(float), (pdf.x * pdf.i).groupby(pdf.k).rank(pct=True).to_numpy(float))


@pytest.mark.parametrize("split", [9, None])
def test_positions_are_a_permutation(skewed, split):
    pdf, df = skewed
    got = O.positions(df.where("x is not null"), ["k"], ["x", "i"], ranges=split).toPandas()
    want = pdf.dropna().sort_values(["k", "x", "i"])
    want["pos"] = want.groupby("k").cumcount()
    m = got.merge(want[["i", "pos"]], on="i")
    assert (m.pos_x == m.pos_y).all() and len(m) == len(want)


def test_positions_without_keys(skewed):
    pdf, df = skewed
    got = O.positions(df, [], ["i"], ranges=5).toPandas()
    assert (got.pos == got.i).all() and (got.group_n == len(pdf)).all()


@pytest.mark.parametrize("chunk", [7, 1000])
def test_record_chunks_see_across_boundaries(skewed, chunk):
    pdf, df = skewed
    d, w, own = O.record_chunks(df, ["k"], ["i"], 5, chunk_rows=chunk, ranges=5)
    got = d.withColumns({"l1": F.lag("i", 1).over(w), "l5": F.lag("i", 5).over(w)}).where(own).toPandas()
    assert len(got) == len(pdf)
    g = pdf.groupby("k").i
    m = got.set_index("i").sort_index()
    np.testing.assert_allclose(m.l1.to_numpy(float), g.shift(1).to_numpy(float))
    np.testing.assert_allclose(m.l5.to_numpy(float), g.shift(5).to_numpy(float))


@pytest.mark.parametrize(("unit", "ranges"), [("D", None), ("min", None), ("min", 1), ("min", 13)])
def test_asof_join_equals_merge_asof(spark, unit, ranges):
    rng = np.random.default_rng(3)
    def times(n):
        return pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60 if unit == "D" else 60 * 1440, n), unit=unit)
    left = pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "a", "none"], 900), "t": times(900), "i": range(900)})
    right = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 400), "u": times(400), "v": range(400)})
    ls, rs = spark.createDataFrame(left), spark.createDataFrame(right)
    if unit == "D":
        ls, rs = ls.withColumn("t", F.to_date("t")), rs.withColumn("u", F.to_date("u"))
    got = O.asof_join(ls, rs, "k", "t", "u", ["v"], ["v"], ranges=ranges).toPandas().set_index("i").v.sort_index()
    want = pd.merge_asof(left.sort_values("t"), right.sort_values(["u", "v"]), left_on="t", right_on="u", by="k")
    np.testing.assert_allclose(got.to_numpy(float), want.set_index("i").v.sort_index().to_numpy(float))


def test_asof_plan_has_no_pairwise_join(spark):
    ls = spark.range(10).select(F.col("id").alias("k"), F.current_date().alias("t"))
    rs = spark.range(10).select(F.col("id").alias("k"), F.current_date().alias("u"), F.lit(1).alias("v"))
    plan = plan_of(O.asof_join(ls, rs, "k", "t", "u", ["v"]))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_brackets_leave_most_values_out(spark):
    """Nearly all values fall into the gaps between brackets; results equal numpy's, ties and extremes included."""
    rng = np.random.default_rng(2)
    for x in (rng.lognormal(0, 3, 60_000), np.round(rng.normal(0, 1, 60_000), 1), np.r_[np.zeros(50_000), rng.normal(0, 1, 10_000)], np.full(5_000, 3.5)):
        d = spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("k", F.lit("a")).repartition(6)
        probs = {"p0": 0.0, "p1": .01, "p25": .25, "mid": .5, "p99": .99, "p100": 1.0}
        kept = O._bracketed(d.withColumnRenamed("x", "__v"), ["k"], sorted(probs.values()), 5).where("__v is not null").count()
        assert kept <= min(len(np.unique(x)), 0.03 * len(x) + 10)
        got = O.quantiles(d, ["k"], "x", probs, ranges=5).first()
        np.testing.assert_allclose([got[n] for n in probs], np.quantile(x, list(probs.values())))
        assert got["n"] == len(x)


def test_same_cuts_on_every_evaluation(skewed):
    _, df = skewed
    q = O.quantiles(df.repartition(7), ["k"], "x", {"mid": .5}, ranges=11)
    assert sorted(q.collect()) == sorted(q.collect())


def test_one_key_and_day_over_many_ranges(spark):
    """All of one key's points on one day, its only facts in the first range, an odd key before and after."""
    start = pd.Timestamp("2024-03-01")
    left = pd.DataFrame({"k": ["hot"] * 500 + ["z"] * 5, "t": [start + pd.Timedelta(seconds=i + 2) for i in range(500)] + [start] * 5, "i": range(505)})
    right = pd.DataFrame({"k": ["a", "hot", "hot"], "u": [start, start, start + pd.Timedelta(seconds=1)], "v": [None, 1.0, 2.0], "w": ["x", "y", None]})
    ls, rs = spark.createDataFrame(left), spark.createDataFrame(right)
    got = O.asof_join(ls, rs, "k", "t", "u", ["v", "w"], ["v"], ranges=16).toPandas().set_index("i").sort_index()
    assert (got.v[:500] == 2.0).all() and got.v[500:].isna().all() and got.w.isna().all()


def test_running_totals_over_empty_and_extreme_ranges(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 0), ("b", 1, 7), (None, 1, 9)], "k string, o int, w int")
    for ranges in (1, 2, 50):
        got = {(r["k"], r["o"]): (r["before"], r["total"]) for r in running_totals(d, ["k"], ["o"], F.col("w"), ranges).collect()}
        assert got == {("a", 1): (0, 5), ("a", 2): (5, 5), ("b", 1): (0, 7)}
    assert running_totals(d.limit(0), ["k"], ["o"]).collect() == []


def test_ranges_follow_the_bytes(spark, tmp_path, monkeypatch):
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    d = spark.read.parquet(f"{tmp_path}/t")
    few = scan.range_count(d)
    monkeypatch.setattr(scan, "RANGE_BYTES", 10_000)
    assert few == 4 and scan.range_count(d) > 50


def test_tasks_do_not_grow_with_the_table(spark):
    """What a task reads is bounded by its bytes, not by a fixed number of partitions; little stays in few tasks."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = spark.range(2_000_000).groupBy(F.sha2(F.col("id").cast("string"), 256).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert large.rdd.getNumPartitions() > max(parts, 8)
    assert spark.range(100).groupBy("id").count().rdd.getNumPartitions() <= max(parts, 8)


def test_ranges_of_a_cut_join_follow_its_rows(spark, tmp_path):
    """Spark estimates a join by the product of its sides, and a frame keeps that estimate when its lineage is cut."""
    for name in "ab":
        spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias(name)).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    both = spark.read.parquet(f"{tmp_path}/a").hint("merge").join(spark.read.parquet(f"{tmp_path}/b"), "id")
    joined = cut(both)
    assert scan.input_bytes(joined) < 1 << 30
    assert scan.range_count(joined) == 4
