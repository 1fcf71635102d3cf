"""Profiles, exploration, breaks and cleaning on frames with known answers."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidemark.functions.scalars import PERIOD_UNITS, period
from tidemark.operators import breaks, clean, explore, flags, profile
from tidemark.specs import CleaningStep, Predicate

DAYS = pd.bdate_range("2022-01-03", periods=200)


@pytest.fixture(scope="module")
def panel_pdf():
    rng = np.random.default_rng(0)
    return pd.DataFrame([(d.date(), f"E{i}", i + rng.normal(0, .01)) for d in DAYS for i in range(10)],
                        columns=["t", "id", "x"])


@pytest.fixture(scope="module")
def panel(spark, panel_pdf):
    return spark.createDataFrame(panel_pdf).cache()


def test_variance_is_between_entities(panel):
    row = explore.variance_split(panel, "id", "t", "x").first()
    assert row.share_between_entities > 0.99 and row.reading.startswith("mostly differs")


def test_a_column_of_many_values_is_many_tasks(spark):
    """Counts meet what is known of their columns where they lie; no join gathers the values of a column."""
    rows = [(i, f"v{i % 3}", None, i % 41, float(i % 40)) for i in range(300)]
    got = profile.profile_table(spark.createDataFrame(rows, "key long, code string, none string, most int, few double"), 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:   # as where the counts are too large to be sent
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = got.select("column", "top", "examples")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [column" in plan and "LeftSemi" not in plan and "LeftAnti" not in plan
    r = {x.column: x for x in got.collect()}
    assert (r["key"].is_unique, r["key"].n_distinct, r["key"].top, r["key"].examples) == (True, 300, None, "0, 1")
    assert (r["code"].top, r["code"].examples, r["none"].n_distinct, r["none"].null_rate, r["none"].top) == ("v0=100, v1=100", None, 0, 1, None)
    assert (r["most"].n_distinct, r["most"].top, r["most"].examples, r["few"].top) == (41, None, "0, 1", "0.0=8, 1.0=8")


def test_coverage_counts_entries_and_exits(spark, panel_pdf):
    p = panel_pdf[~((panel_pdf.id == "E3") & (panel_pdf.t > DAYS[150].date()))]
    p = p[~((p.id == "E4") & (p.t < DAYS[60].date()))]
    per = explore.coverage(spark.createDataFrame(p), "t", "id", "D").toPandas()
    assert per.new.sum() == 10 and per.lost.sum() == 10
    assert per.set_index("period").new[DAYS[60].date()] == 1 and per.set_index("period").lost[DAYS[150].date()] == 1


def _series(spark, values):
    rows = [("s", d.date(), float(v)) for d, v in zip(pd.bdate_range("2020-01-01", periods=len(values)), values)]
    return spark.createDataFrame(rows, "series string, period date, value double")


def test_break_is_found_on_its_date_and_noise_has_none(spark):
    rng = np.random.default_rng(1)
    v = np.r_[rng.normal(10, .5, 100), rng.normal(20, .5, 100)]
    got = breaks.level_shifts(_series(spark, v), 20).collect()
    assert len(got) == 1 and got[0].period == pd.bdate_range("2020-01-01", periods=200)[100].date()
    assert got[0].change_pct > 80
    assert breaks.level_shifts(_series(spark, rng.normal(10, .5, 200)), 20).count() == 0


def _brute_shifts(v, w, k=3, least=4.0):
    """Positions by definition, one candidate at a time."""
    score = {}
    for i in range(w, len(v) - w + 1):
        b, a = [x for x in v[i - w:i] if x == x], [x for x in v[i:i + w] if x == x]
        if len(b) >= w // 2 and len(a) >= w // 2:
            mb, ma = np.median(b), np.median(a)
            mad = np.median([abs(x - mb) for x in b] + [abs(x - ma) for x in a])
            score[i] = abs(ma - mb) / max(1.4826 * mad, 1e-9 + .01 * abs(mb))
    kept = []
    while score and len(kept) < k:
        i = max(score, key=lambda j: (score[j], j))
        if score[i] < least:
            break
        kept.append((i, score[i]))
        score = {j: s for j, s in score.items() if abs(j - i) >= w}
    return kept


@pytest.mark.parametrize("seed", [2, 3])
def test_shift_choice_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    v = np.r_[rng.normal(5, 1, 60), rng.normal(9, 1, 50), rng.normal(2, 1, 70)]
    v[rng.random(180) < .1] = np.nan
    s = _series(spark, v).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    want = _brute_shifts(list(v), 12)
    got = sorted(r.score for r in breaks.level_shifts(s, 12).collect())
    np.testing.assert_allclose(got, sorted(x for _, x in want))


def test_zero_until_and_clusters(spark):
    s = _series(spark, [0] * 60 + [3] * 40)
    assert breaks.zero_until(s).first().starts == pd.bdate_range("2020-01-01", periods=100)[60].date()
    b = spark.createDataFrame([("rows", dt.date(2020, 1, 1)), ("p90", dt.date(2020, 2, 20)), ("rows", dt.date(2020, 4, 10)),
                               ("rows", dt.date(2021, 1, 1))], "series string, period date")
    got = breaks.break_clusters(b).orderBy("cluster").collect()
    assert [r.months for r in got] == ["2020-01, 2020-02, 2020-04", "2021-01"] and got[0].statistics == "p90, rows"
    late = b.replace({"rows": "median"}, subset=["series"]).where("period <> date'2020-01-01'").unionByName(
        spark.createDataFrame([("p90", dt.date(2020, 1, 1))], "series string, period date"))
    # the third date is within 62 days of the second, but not of the first
    assert breaks.break_clusters(late).orderBy("cluster").first().statistics == "p90"
    assert flags.break_flags(breaks.zero_until(s), breaks.break_clusters(b)).count() == 3


def test_missingness_and_presence(spark, panel_pdf):
    p = panel_pdf[panel_pdf.id.isin(["E0", "E1", "E2", "E3"])].reset_index(drop=True)
    p = p[~((p.id == "E2") & p.t.isin([d.date() for d in DAYS[50:60]]))].reset_index(drop=True)
    df = spark.createDataFrame(p.reset_index()).withColumn(
        "x", F.when(F.col("index") < 10, None).when(F.col("index") < 30, 0.0).otherwise(F.col("x") + 1))
    m = explore.missingness(df, ["x"]).first()
    assert (m.null_count, m.zero_count) == (10, 20)
    got = explore.presence(df, "t", "id").first()
    assert got.absent_inside_span_share == pytest.approx(10 / 800) and got.calendar_dates == 200
    assert explore.entity_presence(df, "t", "id").where("entity = 'E2'").first().presence == pytest.approx(190 / 200)


def test_distribution_hints(spark):
    rng = np.random.default_rng(0)
    skewed = spark.createDataFrame([(float(v),) for v in np.r_[rng.lognormal(0, 1, 9000), np.zeros(1000)]], "x double")
    r = explore.distribution(skewed, "x").first()
    assert r.zero_share == pytest.approx(.1) and r.skew > 2 and r.hint_right_skewed and r.hint_zero_mass
    capped = spark.createDataFrame([(float(v),) for v in np.r_[rng.uniform(0, .99, 900), np.ones(100)]], "x double")
    r = explore.distribution(capped, "x").first()
    assert r.share_at_max == pytest.approx(.1) and r.hint_capped and flags.distribution_flags(
        explore.distribution(capped, "x")).count() == 1


def test_update_dynamics_equals_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"e": rng.choice(["hot", "hot", "b"], 600), "d": rng.integers(0, 300, 600)}).drop_duplicates()
    pdf["t"] = [dt.date(2020, 1, 1) + dt.timedelta(int(x)) for x in pdf.d]
    pdf["x"] = rng.integers(0, 4, len(pdf)).astype(float)
    got = explore.update_dynamics(spark.createDataFrame(pdf[["e", "t", "x"]]), "e", "t", "x", (1, 5)).first()
    s = pdf.sort_values(["e", "t"])
    prev = s.groupby("e").x.shift(1)
    assert got.share_unchanged == pytest.approx((s.x == prev)[prev.notna()].mean())
    lag5 = s.groupby("e").x.shift(5)
    assert got.acf_lag5 == pytest.approx(s.x[lag5.notna()].corr(lag5.dropna()))
    ch = s[prev.notna() & (s.x != prev)]
    gaps = pd.to_datetime(ch.t).groupby(ch.e).diff().dt.days.dropna()
    assert got.days_between_changes_median == pytest.approx(gaps.median())


def test_keys(spark, panel_pdf):
    p = pd.concat([panel_pdf, panel_pdf.head(3)])
    r = explore.key_check(spark.createDataFrame(p), ["t", "id"]).first()
    assert (r.rows_with_duplicated_key, r.exact_duplicate_rows, r.key_is_unique) == (6, 6, False)


def test_whole_rows_are_dealt_only_where_some_may_be_equal(spark, panel_pdf):
    """Shared keys without equal rows need no deal of whole rows; equal rows, nulls and zeros of both signs among them, are counted."""
    key, shape = ["t", "id"], "t int, id string, x double"
    differ = explore.key_check(spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "a", None), (None, "b", 0.0)], shape), key)
    assert "hashpartitioning(t#" in plan_of(differ) and not re.search(r"hashpartitioning\([^)]*x#", plan_of(differ))
    r = differ.first()
    assert (r.n_rows, r.n_distinct_keys, r.rows_with_duplicated_key, r.null_in_key_rows, r.exact_duplicate_rows) == (4, 3, 2, 1, 0)
    same = [(1, "a", 0.0), (1, "a", -0.0), (None, None, None), (None, None, None), (3, "a", 1.0), (3, "a", 2.0)]
    r = explore.key_check(spark.createDataFrame(same, shape), key).first()
    assert (r.rows_with_duplicated_key, r.exact_duplicate_rows) == (6, 4)
    r = explore.key_check(spark.createDataFrame([], shape), key).first()
    assert (r.n_distinct_keys, r.exact_duplicate_rows, r.key_is_unique) == (0, 0, True)


def test_presence_reads_its_table_once(spark, tmp_path, monkeypatch):
    """The entities' spans are written once and only they are read for the statistics; dates of unknown entities count in the calendar only."""
    rows = [(dt.date(2024, 1, d), e) for e, days in (("a", (1, 2, 5)), ("b", (2, 5)), (None, (3, 9))) for d in days] + [(None, "a")]
    spark.createDataFrame(rows, "t date, id string").write.parquet(str(tmp_path / "t"))
    got = explore.presence(spark.read.parquet(str(tmp_path / "t")), "t", "id")
    assert "FileScan" not in plan_of(got)
    r = got.first()
    assert (r.calendar_dates, r.entities, r.absent_inside_span_share, r.always_present_share, r.median_presence) == (5, 2, 0, 1, 1)


@pytest.mark.parametrize("unit", list(PERIOD_UNITS))
def test_periods_of_dates_times_and_texts(spark, unit):
    days = ["1899-12-31", "1969-12-29", "2000-02-29", "2023-01-01", "2024-12-30", None]
    d = spark.createDataFrame([(x and f"{x} 23:59:59.999999",) for x in days], "s string").select(
        "s", F.col("s").cast("timestamp").alias("t"), F.col("s").cast("date").alias("d"))
    for c in ("s", "t", "d"):
        got = d.select(period(F.col(c), unit).alias("p"), F.to_date(F.date_trunc(PERIOD_UNITS[unit], c)).alias("q"))
        assert all(r.p == r.q for r in got.collect())


def test_new_code_is_seen_when_it_appears(spark):
    rows = [(d.date(), "Q,N" if i < 100 else "Q,N,B") for i, d in enumerate(DAYS)]
    m = explore.category_mix(spark.createDataFrame(rows, "t date, c string"), "t", "c", "D", ",").toPandas().set_index("value")
    assert m.first_seen["B"] == DAYS[100].date() and m.mean_share["Q"] == 1 and m.appears_after_start["B"]


def test_comparison_predicates(spark):
    df = spark.createDataFrame([(1, 2), (5, 2), (3, 3)], "a long, b long")
    got = df.select(clean.predicate(df, [Predicate("a", ">", "b")]).alias("p")).collect()
    assert [r.p for r in got] == [False, True, False]
    with pytest.raises(ValueError, match="neither a number nor a column"):
        clean.predicate(df, [Predicate("a", ">", "many")])


def test_missing_values_in_predicates(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "a double")
    def run(p):
        return [r.p for r in df.select(clean.predicate(df, [p]).alias("p")).collect()]
    assert run(Predicate("a", "==", 1)) == [False, True] and run(Predicate("a", "!=", 2)) == [True, True]
    assert run(Predicate("a", "notin", [1.0])) == [True, False] and run(Predicate("a", "<", 5)) == [False, True]


def test_recipe_refuses_bad_and_idle_steps(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, None)], "a long, b long")
    good = CleaningStep("drop_duplicates", "t", ("a",), order_by=("b",))
    out, eff = clean.run_recipe({"t": df}, [good, CleaningStep("missing_indicator", "t", ("b",), flag_name="gap")])
    assert out["t"].count() == 2 and [r.rows_affected for r in eff.orderBy("step").collect()] == [1, 1]
    with pytest.raises(ValueError, match="no column"):
        clean.run_recipe({"t": df}, [CleaningStep("drop_duplicates", "t", ("z",))])
    with pytest.raises(ValueError, match="change no rows"):
        clean.run_recipe({"t": df}, [CleaningStep("drop_rows", "t", where=(Predicate("a", ">", 9),))], refuse_noop=True)
    ex = clean.preview_examples(df, good)
    assert [tuple(r) for r in ex.collect()] == [(1, 2)]


def test_lag_distribution_equals_pairs(spark):
    rng = np.random.default_rng(5)
    def frame(n):
        return pd.DataFrame({"k": rng.choice([1, 1, 1, 2, 3], n), "d": rng.integers(0, 40, n)})
    a, b = frame(300), frame(200)
    def sp(p):
        return spark.createDataFrame([(int(k), dt.date(2024, 1, 1) + dt.timedelta(int(d))) for k, d in p.values],
                                     "k long, t date")
    got = profile.lag_distribution(sp(a), "t", sp(b), "t", "k").first()
    lag = a.merge(b, on="k").eval("d_y - d_x")
    assert got.n_pairs == len(lag) and got.p25 == lag.quantile(.25) and got.share_negative == pytest.approx((lag < 0).mean())
