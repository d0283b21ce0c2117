"""Trading sessions: closed hours are neither missing nor a gap, and horizons count open bars."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from tailward.operators import sessions

FRIDAY = date(2024, 1, 5)
STEP = timedelta(minutes=15)


def at(day: int, hour: int, minute: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, minute)


@pytest.fixture(scope="module")
def calendar(spark):
    """Mornings and afternoons of Friday and Monday, a night that runs past midnight on Friday for variety 0."""
    week = [(v, d, a, b) for v in (0, 1) for d in (1, 5) for a, b in ((540, 690), (810, 900))] + [(0, 5, 1380, 1500)]
    plan = spark.createDataFrame(week, "variety int, weekday int, open_minute int, close_minute int")
    days = spark.createDataFrame([(v, FRIDAY + timedelta(days=k)) for v in (0, 1) for k in range(4)], "variety int, day date")
    return sessions.open_bars(sessions.weekly_sessions(days, plan))


def open_of(calendar, variety):
    return [r.bar for r in calendar.where(f"variety = {variety}").orderBy("ordinal").collect()]


def test_open_bars_count_on_over_closed_hours(calendar):
    bars = open_of(calendar, 0)
    assert len(bars) == 16 + 8 + 16 and bars[0] == at(5, 9) and bars[9] == at(5, 11, 15) and bars[10] == at(5, 13, 30)
    assert bars[16] == at(5, 23) and bars[23] == at(6, 0, 45) and bars[24] == at(8, 9)
    assert [r.ordinal for r in calendar.where("variety = 1").orderBy("bar").collect()] == list(range(32))


def test_overlapping_and_empty_sessions(spark):
    rows = [(0, at(5, 9, 5), at(5, 9, 40)), (0, at(5, 9, 30), at(5, 10)), (0, at(5, 12), at(5, 12))]
    got = sessions.open_bars(spark.createDataFrame(rows, "variety int, open_ts timestamp_ntz, close_ts timestamp_ntz"))
    assert [(r.bar, r.ordinal) for r in got.orderBy("bar").collect()] == [(at(5, 9) + k * STEP, k) for k in range(4)]


def test_coverage_leaves_closed_hours_out(spark, calendar):
    rows = [(0, at(5, 9, 3)), (0, at(5, 9, 14)), (0, at(5, 12)), (0, at(6, 0, 50)), (0, at(7, 10)), (1, None)]
    quotes = spark.createDataFrame(rows, "variety int, ts timestamp_ntz")
    got = {(r.variety, r.day.day): (r.n_present, r.n_missing, r.n_outside) for r in sessions.session_coverage(quotes, calendar).collect()}
    assert got == {(0, 5): (1, 19, 1), (0, 6): (1, 3, 0), (0, 7): (0, 0, 1), (0, 8): (0, 16, 0), (1, 5): (0, 16, 0), (1, 8): (0, 16, 0)}
    missing = sessions.missing_open_bars(quotes, calendar).where("variety = 0").collect()
    assert len(missing) == 38 and not any(r.bar == at(5, 9) for r in missing)


def test_episodes_span_lunch_and_weekend(spark, calendar):
    bars = open_of(calendar, 1)
    levels = [0] * 32
    for k in (8, 9, 10, 15, 16, 20):  # 9 is the last before lunch, 10 the first after it, 15 Friday's last, 16 Monday's first
        levels[k] = 1
    rows = [(1, b, n) for b, n in zip(bars, levels, strict=True)] + [(1, at(5, 12), 3), (1, at(6, 12), 3)]
    df = spark.createDataFrame(rows, "variety int, bar timestamp_ntz, level int")
    got = [(r.start_bar, r.end_bar, r.n_bars, r.peak_level) for r in sessions.session_episodes(df, calendar).orderBy("start_bar").collect()]
    assert got == [(bars[8], bars[10], 3, 1), (bars[15], bars[16], 2, 1), (bars[20], bars[20], 1, 1)]


@pytest.mark.parametrize("horizon", [1, 4, 16, 100])
def test_labels_match_brute_force(spark, calendar, horizon):
    rng = random.Random(horizon)
    bars, rows, starts = {v: open_of(calendar, v) for v in (0, 1)}, [], []
    for v in (0, 1):
        rows += [(v, b) for b in bars[v]] + [(v, at(5, 12)), (v, at(7, 3))]
        starts += [(v, at(rng.randrange(5, 9), rng.randrange(24), rng.choice([0, 7, 15, 30]))) for _ in range(3)]
        starts.append((v, bars[v][9]))  # at a bar's start: not that bar's, but at the end of a horizon
    events = spark.createDataFrame(starts * 2, "variety int, start_ts timestamp_ntz")
    df = spark.createDataFrame(rows, "variety int, bar timestamp_ntz")
    got = {(r.variety, r.bar): r.label for r in sessions.session_labels(df, events, calendar, horizon).collect()}
    for v, b in rows:
        wanted = None
        if b in bars[v]:
            k = bars[v].index(b) + horizon
            end = bars[v][k] if k < len(bars[v]) else datetime.max
            wanted = int(any(w == v and b < s <= end for w, s in starts))
        assert got[v, b] == wanted, (v, b)
