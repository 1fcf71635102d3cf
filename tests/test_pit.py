"""Calendar, rules, as-of views, look-ahead, vintages and the leak matrix."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidemark.operators import calendar as K
from tidemark.operators import panel as N
from tidemark.operators import pit, signals, vintages
from tidemark.sources import bitemporal, tables
from tidemark.specs import AvailabilityRule, PanelSpec, ViewRoles

# Good Friday 2024-03-29 and New Year's Day are closed
CLOSED = {dt.date(2024, 3, 29), dt.date(2024, 1, 1), dt.date(2024, 5, 27)}
SESSIONS = [d.date() for d in pd.bdate_range("2023-11-01", "2024-12-31") if d.date() not in CLOSED]


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(d,) for d in SESSIONS], "session date")


@pytest.fixture(scope="module")
def cal(sessions):
    return K.date_dimension(sessions).cache()


D = dt.date


@pytest.mark.parametrize("ts,want", [
    ("2024-03-28 08:00:00", D(2024, 3, 28)), ("2024-03-28 09:30:00", D(2024, 4, 1)), ("2024-03-28 12:00:00", D(2024, 4, 1)),
    ("2024-03-28 17:00:00", D(2024, 4, 1)), ("2024-03-29 08:00:00", D(2024, 4, 1)), ("2024-03-30 12:00:00", D(2024, 4, 1)),
    ("2024-05-24 16:30:00", D(2024, 5, 28)), ("2025-02-01 00:00:00", None)])
def test_first_open(spark, cal, ts, want):
    df = spark.sql(f"select timestamp '{ts}' as t")
    assert K.first_open_after(df, "t", cal).first().first_open == want


@pytest.mark.parametrize("text,hour", [("2024-01-10T15:00:00.000Z", 10), ("2024-07-10T15:00:00.000Z", 11)])
def test_daylight_saving(spark, text, hour):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.hour(K.parse_exchange_time(F.col("t"), "UTC"))).first()[0] == hour
    assert df.select(F.hour(K.parse_exchange_time(F.col("t"), "America/New_York"))).first()[0] == 15


def test_rules_on_dates(spark, cal):
    df = spark.createDataFrame([(D(2024, 3, 28),), (D(2024, 3, 30),), (D(2024, 12, 31),)], "d date")
    def run(at, lag=0):
        return [r.first_tradable for r in K.apply_rule(df, AvailabilityRule("d", at, extra_lag=lag), cal).orderBy("d").collect()]
    assert run("same_date_open") == run("next_open_after") == [D(2024, 3, 28), D(2024, 4, 1), D(2024, 12, 31)]
    assert run("next_trading_day_open") == [D(2024, 4, 1), D(2024, 4, 1), None]
    assert run("same_date_open", 2) == [D(2024, 4, 2), D(2024, 4, 3), None]


def test_pit_join_takes_what_was_available(spark):
    left = spark.createDataFrame([(1, D(2024, 1, 10)), (2, D(2024, 1, 10))], "k long, asof date")
    right = spark.createDataFrame([(1, D(2024, 1, 1), 5.0, D(2024, 1, 9)), (2, D(2024, 1, 1), 6.0, D(2024, 1, 11))],
                                  "k long, event date, x double, available_at date")
    got = {r.k: r.x for r in pit.pit_join(left, right, "k", "available_at", "asof").collect()}
    assert got == {1: 5.0, 2: None}
    lagged = pit.pit_join(left, right, "k", "available_at", "asof", dt.timedelta(days=2))
    assert {r.k: r.x for r in lagged.collect()} == {1: None, 2: None}
    with pytest.raises(ValueError, match="availability_col"):
        pit.pit_join(left, right, "k", None, "asof")
    bad = right.withColumn("available_at", F.when(F.col("k") == 1, F.col("available_at")))
    with pytest.raises(PySparkException, match="has nulls"):
        pit.pit_join(left, bad, "k", "available_at", "asof").collect()


@pytest.fixture(scope="module")
def view(spark, cal):
    rows = [(e, d, i, e == "B" and i == 1) for e in "AB" for i, d in enumerate([D(2024, 3, 26), D(2024, 3, 27), D(2024, 3, 28)])]
    df = spark.createDataFrame(rows, "sym string, day date, v long, bad boolean")
    return pit.pit_view(df, ViewRoles("sym", "day", ("v",), ("bad",)), AvailabilityRule("day", "next_trading_day_open"), cal)


def test_snapshot_around_a_holiday(view, cal):
    got = pit.asof_snapshot(view, ["2024-03-28", "2024-04-01", "2024-03-26"], cal).where("entity = 'A'").orderBy("date").collect()
    assert [(r.source_time, r.feature_age) for r in got] == [(D(2024, 3, 27), 0), (D(2024, 3, 28), 0)]


def test_later_records_do_not_change_earlier_snapshots(spark, view, cal):
    early = view.where("decision_time <= '2024-03-28'")
    key = lambda df: sorted(tuple(r) for r in pit.asof_snapshot(df, ["2024-03-28"], cal).collect())
    assert key(view) == key(early)


def _vint(spark):
    rows = []
    for s in "PQ":
        for m in range(1, 7):
            base = D(2024, m, 1)
            first = D(2024, m + 1, 5)
            rows += [(s, base, first, float(100 + m)), (s, base, first + dt.timedelta(days=30), 100.0 + m + (0.5 if s == "P" else 0))]
    return vintages.with_realtime_end(spark.createDataFrame(rows, "series_id string, date date, realtime_start date, value double"))


GOLD = AvailabilityRule("realtime_start", "same_date_open", value_vintage="as_of_date")


def test_macro_leak_matrix(spark, cal):
    v = _vint(spark)
    out = {x: pit.lookahead_stats_vintage(signals.macro_features(v, cal, x), v, GOLD, cal).first() for x in signals.MACRO_VARIANTS}
    assert out["clean"].share_before_tradable == 0
    assert out["latest"].share_value_not_published == 0.5 and out["latest"].share_used_before_release == 0
    assert out["obsdate"].share_used_before_release == 1 and out["periodend"].share_used_before_release == 1
    r = vintages.revision_stats(v).orderBy("series_id").collect()
    assert [x.share_revised for x in r] == [1.0, 0.0] and r[0].median_vintages == 2


def test_macro_variants_in_one_job(spark, cal):
    """All variants meet the vintages once, and say what each says alone."""
    v = _vint(spark)
    alone = {x: pit.lookahead_stats_vintage(signals.macro_features(v, cal, x), v, GOLD, cal).first() for x in signals.MACRO_VARIANTS}
    together = pit.lookahead_stats_vintage(signals.macro_variants(v, cal), v, GOLD, cal, keys=["variant"])
    assert {r["variant"]: tuple(r)[1:] for r in together.collect()} == {x: tuple(r) for x, r in alone.items()}


@pytest.fixture(scope="module")
def short_volume(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    days = [d for d in SESSIONS if d >= D(2023, 11, 1) and d <= D(2024, 6, 28)]
    rows = [(s, d, float(rng.integers(10, 90)), 100.0) for s in ("AAA", "BBB") for d in days if rng.random() > .05]
    return spark.createDataFrame(rows, "symbol string, date date, short_volume double, total_volume double")


def test_pressure_leak_matrix(short_volume, sessions, cal):
    span = dict(formation=("2023-11-01", "2023-12-01"), start="2023-12-01", end="2024-06-28")
    ref = signals.pressure_reference(short_volume, sessions, **span)
    rule = AvailabilityRule("date", "next_trading_day_open")
    def run(variant):
        ev = signals.pressure_signal(short_volume, sessions, cal, signal_start="2024-01-02", variant=variant, **span)
        return pit.lookahead_stats_signal(ev, ref, rule, cal).first()
    assert run("clean").share_before_tradable == 0
    same = run("sameday")
    assert same.share_used_before_release == 1 and same.early_median == 1
    for v in ("centered", "fullmean"):
        r = run(v)
        assert r.share_value_not_public > .9 and r.share_used_before_release == 0


def test_pressure_equals_pandas(short_volume, sessions):
    span = dict(formation=("2023-11-01", "2023-12-01"), start="2023-12-01", end="2024-06-28")
    got = signals.pressure_reference(short_volume, sessions, **span).toPandas().set_index(["symbol", "date"]).value.sort_index()
    p = short_volume.toPandas()
    p["ratio"] = p.short_volume / p.total_volume
    days = [d for d in SESSIONS if D(2023, 12, 1) <= d <= D(2024, 6, 28)]
    for s in ("AAA", "BBB"):
        x = p[p.symbol == s].set_index("date").ratio.reindex(days).ffill()
        avg = x.rolling(5, min_periods=5).mean()
        want = avg - avg.expanding(min_periods=20).mean()
        pd.testing.assert_series_equal(got[s], want, check_names=False, check_dtype=False)


def test_facts_are_usable_the_day_after_filing(spark):
    facts = spark.createDataFrame([(1, "public_float", 10.0, D(2023, 6, 30), D(2023, 8, 1)),
                                   (1, "public_float", 20.0, D(2023, 12, 31), D(2024, 2, 14)),
                                   (1, "public_float", 15.0, D(2023, 9, 30), D(2024, 2, 14))],
                                  "cik long, item string, val double, end date, filed date")
    panel = spark.createDataFrame([(D(2024, 2, 14), "A", 1), (D(2024, 2, 15), "A", 1)], "date date, entity string, cik long")
    got = {r.date: r.s for r in N.asof_value(panel, facts, "public_float", "s").collect()}
    assert got == {D(2024, 2, 14): 10.0, D(2024, 2, 15): 20.0}


def test_universe_ignores_the_panel_period(spark, cal):
    rows = [(e, d, size) for e, size in (("BIG", 100.0), ("MID", 50.0), ("LATE", 1.0)) for d in SESSIONS[:60]]
    rows += [(e, d, 1e6 if e == "LATE" else 1.0) for e in ("BIG", "MID", "LATE") for d in SESSIONS[60:90]]
    df = spark.createDataFrame(rows, "e string, d date, x double")
    v = pit.pit_view(df, ViewRoles("e", "d", ("x",)), AvailabilityRule("d", "next_trading_day_open"), cal)
    spec = PanelSpec((str(SESSIONS[0]), str(SESSIONS[55])), str(SESSIONS[62]), str(SESSIONS[85]), "x", 2, 20, 5)
    sym = spark.createDataFrame([("BIG", 1, "Energy")], "entity string, cik long, sector string")
    p = N.build_panel(v, spec, ("x",), sym).toPandas()
    assert set(p.entity) == {"BIG", "MID"} and set(p[p.entity == "MID"].sector) == {"Unknown"}
    b = N.build_panel(v, spec, ("x",), sym, bounded=True).toPandas()
    key = ["date", "entity"]
    pd.testing.assert_frame_equal(p.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))


def test_dated_link(spark):
    day = D(2024, 1, 2)
    daily = spark.createDataFrame([(day, "BF/B", "BF", "B", 1, 11), (day, "MA/A", "MA", "A", 3, 11), (day, "MA/C", "MA", "C", 2, 11)],
                                  "date date, key string, ticker string, shrcls string, id long, shrcd int")
    names = spark.createDataFrame([(2, "XYZ", D(2020, 1, 1), D(2025, 1, 1)), (9, "OLD", D(2020, 1, 1), D(2021, 1, 1))],
                                  "id long, key string, start date, end date")
    pairs = spark.createDataFrame([(day, s) for s in ("BF/B", "MA", "XYZ", "OLD", "NOPE")], "date date, entity string")
    got = {r.entity: r.rid for r in pit.dated_link(pairs, daily, names).collect()}
    assert got == {"BF/B": "1", "MA": "3", "XYZ": "2", "OLD": None, "NOPE": None}


def test_dates_outside_the_calendar(spark):
    days = [dt.date(1890, 5, 2), dt.date(1995, 3, 1), dt.date(2150, 7, 9)]
    dim = K.date_dimension(spark.createDataFrame([(x,) for x in days], "session date")).cache()
    asked = [dt.date(1492, 1, 1), dt.date(1890, 5, 1), *days, dt.date(2150, 7, 10), dt.date(2999, 1, 1), None]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, d date")
    at = lambda f, c: [r[c] for r in f.orderBy("i").collect()]
    a, b, c = days
    assert at(K.roll_forward(df, "d", dim), "session") == [a, a, a, b, c, None, None, None]
    assert at(K.next_session(df, "d", dim), "session") == [a, a, b, c, None, None, None, None]
    assert at(K.session_index(df, "d", dim), "idx") == [0, 0, 0, 1, 2, 3, 3, None]
    assert at(K.shift_sessions(df, "d", 1, dim), "session") == [b, b, b, c, None, None, None, None]
    none = K.date_dimension(spark.createDataFrame([], "session date"))
    assert at(K.roll_forward(df, "d", none), "session") == [None] * 8


_ARRIVED = "series_id string, date date, realtime_start date, value double"


def _kept(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*vintages.VINTAGE).collect()), key=key)


def test_merging_in_batches_equals_one_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = {(f"s{rng.randint(0, 30)}", D(2024, rng.randint(1, 3), 1), D(2024, 5, rng.randint(1, 28))): float(i) for i in range(400)}
    rows = [(*k, v) for k, v in rows.items()]
    rng.shuffle(rows)   # late vintages split intervals
    for name, step in (("one", len(rows)), ("many", 90)):
        for i in range(0, len(rows), step):
            bitemporal.merge_vintages(spark.createDataFrame(rows[i:i + step], _ARRIVED), str(tmp_path / name), f"batch-{i}", 8)
    one, many = (bitemporal.read_vintage_table(spark, str(tmp_path / n)) for n in ("one", "many"))
    assert _kept(one) == _kept(many) == _kept(vintages.with_realtime_end(spark.createDataFrame(rows, _ARRIVED)))


def test_a_merge_touches_only_its_series_and_runs_once(spark, tmp_path):
    path = str(tmp_path)
    put = lambda rows, key: bitemporal.merge_vintages(spark.createDataFrame(rows, _ARRIVED), path, key, 16).first()
    m, a, b, c = D(2024, 1, 1), D(2024, 2, 1), D(2024, 2, 10), D(2024, 2, 20)
    assert bitemporal.read_vintage_table(spark, path).count() == 0
    put([("A", m, a, 1.0), ("A", m, c, 3.0), ("B", m, a, 5.0), (None, None, None, None), ("B", m, b, None), ("B", m, b, 6.0)], "k1")
    before, _ = bitemporal._current(spark, path)
    second = put([("A", m, b, 2.0), ("A", m, c, 9.0)], "k2")
    after, _ = bitemporal._current(spark, path)
    assert sum(before[k] != after[k] for k in before) == 1 and len(second.sources) == 1
    end = D(9999, 12, 31)
    want = [("A", m, a, b, 1.0), ("A", m, b, c, 2.0), ("A", m, c, end, 9.0), ("B", m, a, b, 5.0), ("B", m, b, end, 6.0), (None, None, None, end, None)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert _kept(bitemporal.read_vintage_table(spark, path)) == sorted(want, key=key)
    assert put([("A", m, b, 77.0)], "k2") == second and _kept(bitemporal.read_vintage_table(spark, path)) == sorted(want, key=key)
    put([], "k3")
    assert _kept(bitemporal.read_vintage_table(spark, path)) == sorted(want, key=key)


def test_a_merge_is_one_shuffle_of_parts_by_rows(spark, tmp_path, monkeypatch):
    """Rows are dealt once for the merge and its writing, a bucket of many rows to several parts; equal starts keep one of them."""
    monkeypatch.setattr(bitemporal, "PART_ROWS", 20)
    day = lambda i: D(2024, 5, 1 + i % 25)
    first = [("hot", D(2024, 1 + i % 12, 1), day(i), float(i % 7)) for i in range(300)] + [("cold", D(2024, 1, 1), day(3), None)]
    late = [("hot", D(2024, 1 + i % 12, 1), day(i * 7 + 1), float(i)) for i in range(60)] + [("hot", None, None, 1.0), ("hot", None, None, None)]
    path, frame = str(tmp_path), lambda rows: spark.createDataFrame(rows, _ARRIVED)
    bitemporal.merge_vintages(frame(first), path, "first", 4)
    with monkeypatch.context() as m:
        m.setattr(bitemporal, "publish", lambda rows, *more: rows)
        rows = bitemporal.merge_vintages(frame(late), path, "late")
        rows.collect()
        assert plan_of(rows).split("Initial Plan")[0].count(" Exchange ") == 1 and rows.columns == [*vintages.VINTAGE, "bucket"]
    bitemporal.merge_vintages(frame(late), path, "late")
    held = {}
    for some in (first, late):
        new = {}
        for *k, v in some:
            new[tuple(k)] = v if new.get(tuple(k)) is None else max(new[tuple(k)], v if v is not None else new[tuple(k)])
        held |= new
    want = vintages.with_realtime_end(frame([(*k, v) for k, v in held.items()]))
    assert _kept(bitemporal.read_vintage_table(spark, path)) == _kept(want)


def test_fingerprint_is_the_sum_of_hashes(spark):
    rows = [(i, f"t{i % 3}", None if i % 4 else i / 3) for i in range(500)]
    d = spark.createDataFrame(rows, "a long, b string, c double")
    got = d.agg(tables.content_hash(d).cast("string")).first()[0]
    each = d.select(F.pmod(F.xxhash64("a", "b", "c"), F.lit((1 << 61) - 1))).collect()
    assert got == str(sum(r[0] for r in each)) and spark.range(0).agg(tables.content_hash(spark.range(0))).first()[0] is None
