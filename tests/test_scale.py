"""The distributed forms against brute force, with settings small enough that every branch runs."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailward.functions.quantile import weighted_quantiles
from tailward.operators.asof import asof_join
from tailward.operators.events import fuse_events, label_bars
from tailward.operators.neighbours import CellIndex, similar_history
from tailward.operators.profiling import dedup_latest, profile
from tailward.operators.tailrisk import block_weights, bootstrap_improvement, cvar
from tailward.operators.warnings import listed_windows, match_events

T0 = datetime(2024, 1, 1)


def test_weighted_quantiles_match_numpy(spark):
    rng = random.Random(1)
    # Group 0 holds most rows, and one value holds a third of them.
    data = {0: [rng.choice([7.0, rng.gauss(0, 1), rng.gauss(50, 9)]) for _ in range(900)], 1: [3.0], 2: [1.0, 2.0]}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    counts = spark.createDataFrame(rows, "g int, v double").groupBy("g", "v").count()
    qs = [0.0, 0.01, 0.3, 0.5, 0.95, 1.0]
    got = {(r.g, r.q): r.quantile for r in weighted_quantiles(counts, ["g"], "v", "count", qs).collect()}
    assert len(got) == len(data) * len(qs)
    for g, vs in data.items():
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(vs, q), abs=1e-12)


def test_cvar_over_range_partitions(spark):
    losses = [float(x) for x in range(1, 101)] + [None]
    df = spark.createDataFrame([("a", x) for x in losses], "side string, loss double")
    row = cvar(df, by=["side"]).first()
    assert row["var"] == pytest.approx(np.quantile(range(1, 101), 0.95))
    assert (row.n_losses, row.n_tail) == (100, 5)
    assert row.cvar == pytest.approx(98.0) and row.cvar >= row["var"]


def brute_islands(rows):
    out = {}
    for key in {r[0] for r in rows}:
        merged = []
        for s, e, src in sorted((r[1], r[2], r[3]) for r in rows if r[0] == key):
            if merged and s <= merged[-1][1]:
                last = merged[-1]
                merged[-1] = [last[0], max(last[1], e), last[2] + 1, last[3] | {src}]
            else:
                merged.append([s, e, 1, {src}])
        out[key] = [(s, e, n, sorted(x)) for s, e, n, x in merged]
    return out


@pytest.mark.parametrize("seed,chunk,salts", [(1, "1 hour", 1), (2, "1 hour", 4), (3, "10 minutes", 3), (4, "1 day", 16)])
def test_fusing_matches_brute_force(spark, seed, chunk, salts):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        start = T0 + timedelta(minutes=rng.randrange(0, 4000))
        length = rng.choice([0, 1, 5, 30, 300])  # points, touching, nested and chunk-crossing intervals
        rows.append((rng.choice([0, 0, 0, 1]), start, start + timedelta(minutes=length), rng.choice(["named", "market"])))
    rows += rows[:40]  # copies
    df = spark.createDataFrame(rows, "variety int, start_ts timestamp_ntz, end_ts timestamp_ntz, source string")
    got = {}
    for r in fuse_events(df, chunk=chunk, salts=salts).orderBy("variety", "start_ts").collect():
        got.setdefault(r.variety, []).append((r.start_ts, r.end_ts, r.n_events, list(r.sources)))
    assert got == brute_islands(rows)


def test_labels_match_brute_force(spark):
    rng = random.Random(5)
    bars = [(v, T0 + timedelta(minutes=15 * i)) for v in (0, 1) for i in range(120)]
    starts = [(rng.choice([0, 1]), T0 + timedelta(minutes=rng.randrange(0, 1800), seconds=rng.choice([0, 0, 7]))) for _ in range(12)]
    starts.append((0, bars[50][1] + timedelta(hours=4)))  # exactly at the horizon: counts
    starts.append((1, bars[170][1]))  # exactly at the bar: does not count for that bar
    got = {
        (r.variety, r.bar): r.label
        for r in label_bars(
            spark.createDataFrame(bars, "variety int, bar timestamp_ntz"),
            spark.createDataFrame(starts, "variety int, start_ts timestamp_ntz"),
        ).collect()
    }
    for v, bar in bars:
        assert got[v, bar] == int(any(k == v and bar < s <= bar + timedelta(hours=4) for k, s in starts)), (v, bar)


@pytest.mark.parametrize("cell", [4, 16, 1000])
def test_neighbours_match_brute_force(spark, cell):
    rng = random.Random(6)
    points = [(0 if i < 90 else 1, i, float(rng.randrange(0, 5)), rng.choice([None, float(rng.randrange(0, 3))])) for i in range(100)]
    df = spark.createDataFrame(points, "variety int, bar int, x double, y double")
    got = {}
    for r in similar_history(df, ["x", "y"], k=3, cell=cell).orderBy("variety", "bar", "nth").collect():
        got.setdefault((r.variety, r.bar), []).append((round(r.distance, 9), r.match_bar))
    expected = {}
    for v, t, x, y in points:
        earlier = [
            (round(float(np.hypot(x - a, (y or 0.0) - (b or 0.0))), 9), s) for w, s, a, b in points if w == v and s < t
        ]
        if earlier:
            expected[v, t] = sorted(earlier)[:3]
    assert got == expected


def computed(df, vec, cell, k=5):
    """Pairs whose distance the index computes, and pairs of a row and an earlier one."""
    index = CellIndex(df, vec, k, "variety", "bar", cell)
    offered = index.offered.select("variety", F.col("_unit").alias("_to"), F.col("_t").alias("_earlier"), "_apart")
    queries = index.points.select("variety", F.col("_unit").alias("_to"), "_t")
    inside = queries.join(offered, ["variety", "_to"]).where("_earlier < _t").count()
    routed = index.routed(index.own()).select("variety", "_to", "_t", "_far", "_limit")
    ring = F.col("_limit").isNull() | (F.abs(F.col("_far") - F.col("_apart")) <= F.col("_limit"))
    across = routed.join(offered, ["variety", "_to"]).where("_earlier < _t").where(ring).count()
    every = df.groupBy("variety").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    return inside + across, every


def test_neighbours_skip_units_out_of_reach(spark):
    """Two far clusters: rows of one never need the units of the other."""
    points = [(0, i, 0.0 if i % 8 < 4 else 1000.0 + i % 3) for i in range(64)]
    df = spark.createDataFrame(points, "variety int, bar int, x double")
    rows = similar_history(df, ["x"], k=2, cell=8).collect()
    late = [r for r in rows if r.bar >= 16]
    assert all(r.distance < 10 for r in late)


def test_equal_rows_take_the_earliest_and_are_offered_k_times(spark):
    points = [(0, i, 1.0 if i % 3 else float(i)) for i in range(300)]
    df = spark.createDataFrame(points, "variety int, bar int, x double")
    got = {}
    for r in similar_history(df, ["x"], k=2, cell=16).collect():
        got.setdefault(r.bar, []).append((r.nth, r.match_bar, r.distance))
    for _, i, x in points:
        wanted = sorted((abs(x - y), j) for _, j, y in points[:i])[:2]
        assert sorted(got.get(i, [])) == [(n, j, d) for n, (d, j) in enumerate(wanted, 1)]
    done, every = computed(df, ["x"], 16, k=2)
    assert done < every / 4


def test_neighbours_of_heavy_tails_compute_few_pairs(spark):
    """Shocks of a few factors, as in a surface that moves as a whole: equal to brute force, with a fifth of the pairs at most."""
    rng = np.random.default_rng(2)
    n, vec = 2500, [f"f{j}" for j in range(11)]
    x = rng.standard_t(1.5, (n, 3)) @ rng.normal(size=(3, 11)) + 0.05 * rng.standard_t(2, (n, 11))
    df = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(x)], "variety int, bar int, " + ", ".join(f"{c} double" for c in vec))
    done, every = computed(df, vec, 32)
    assert done < 0.2 * every
    got = {}
    for r in similar_history(df, vec, cell=32).collect():
        got.setdefault(r.bar, []).append((r.nth, r.match_bar))
    for i in range(1, n):
        d = np.zeros(i)
        for j in range(11):
            d += (x[i, j] - x[:i, j]) ** 2
        assert [m for _, m in sorted(got[i])] == np.lexsort((np.arange(i), np.sqrt(d)))[:5].tolist()


def test_profile_exact_and_sketch(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1.0, 2.0, rng.random() * 100]), i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b int")
    exact = {r.column: r for r in profile(df, ["a", "b"]).collect()}
    known = [a for a, _ in rows if a is not None]
    a = exact["a"]
    assert (a.n_values, a.n_null, a.n_distinct) == (len(known), 500 - len(known), len(set(known)))
    assert a.p50 == pytest.approx(np.median(known)) and a.mean_value == pytest.approx(np.mean(known))
    sketch = {r.column: r for r in profile(df, ["a", "b"], approx=True).collect()}
    assert sketch["b"].n_distinct == 7 and sketch["a"].n_null == a.n_null


def test_profile_of_an_empty_column(spark):
    row = profile(spark.createDataFrame([(None,), (None,)], "a double"), ["a"]).first()
    assert (row.n_values, row.n_null, row.n_distinct, row.p50) == (0, 2, 0, None)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limit_applies_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert plan(dedup_latest(df, ["k"], [F.col("id").desc()])).count("WindowGroupLimit") == 2


def test_features_scan_only_what_they_need(spark, tmp_path, sf_dir):
    from tailward.operators.features import build_features, feat_signed_flow
    from tailward.sources.fixture import quotes

    path = str(tmp_path / "quotes")
    quotes(spark, sf_dir).write.parquet(path)
    stored = spark.read.parquet(path)
    text = plan(feat_signed_flow(stored))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "open_interest" not in schema and "fwd" not in schema and "volume" in schema
    full = plan(build_features(stored))
    assert full.count("FileScan") == 1 and "CartesianProduct" not in full and "NestedLoop" not in full
    assert "Python" not in full


def test_bootstrap_equals_numpy_with_the_same_weights(spark):
    rng = np.random.default_rng(4)
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(40)]
    rows = [(v, d, None if k == 0 else float(r), int(e)) for v in (0, 1) for k, (d, r, e) in enumerate(zip(days, rng.standard_t(2, 40) / 50, rng.random(40) < 0.7, strict=True))]
    exposed = spark.createDataFrame(rows, "variety int, day date, ret double, exposure int").withColumn("strategy_ret", F.col("ret") * F.col("exposure"))
    weights = {(r.block, r.draw): r.weight for r in block_weights(exposed, 300, 5).collect()}
    counts = np.array([weights.get((b, d), 0) for b in {b for b, _ in weights} for d in range(300)])
    assert abs(counts.mean() - 1) < 0.1 and abs(counts.var() - 1) < 0.2
    got = {(r.convention, r.side): r for r in bootstrap_improvement(exposed, 300, 5).collect()}

    def cvar_of(losses):
        var = np.round(np.quantile(np.round(losses, 9), 0.95), 12)
        return losses[np.round(losses, 9) >= var].mean()

    for convention, side, sign in (("method", "long", -1), ("competition", "long", -1), ("competition", "short", 1)):
        found = []
        for draw in range(300):
            base, kept = [], []
            for _, d, r, e in rows:
                if r is not None:
                    n = weights.get(((d - date(1970, 1, 1)).days // 5, draw), 0)
                    base += [sign * r] * n
                    kept += [sign * r * e] * n
            if base:
                found.append(1 - cvar_of(np.array(kept)) / cvar_of(np.array(base)))
        row = got[convention, side]
        assert row.n_draws == len(found)
        assert (row.low, row.median, row.high) == pytest.approx(tuple(np.quantile(found, [0.05, 0.5, 0.95])), abs=1e-9)
        assert row.share_above == pytest.approx(np.mean(np.round(found, 9) > 0.1))
    assert bootstrap_improvement(exposed.where("false"), 10).count() == 0


def test_events_of_any_length_are_listed_twice_at_most(spark):
    """Windows from minutes to years, warnings at their edges: equal to brute force over all pairs."""
    rng = random.Random(12)
    spans = [timedelta(0), timedelta(minutes=7), timedelta(hours=4), timedelta(days=3), timedelta(days=90), timedelta(days=2000)]
    events = [(v, (s := T0 + timedelta(minutes=rng.randrange(0, 600_000))), s + rng.choice(spans)) for v in (0, 1) for _ in range(40)]
    events += [(0, T0, None), (0, T0 + timedelta(days=1), T0), (1, T0 + timedelta(hours=4), T0 + timedelta(hours=4))]
    asked = [(v, T0 + timedelta(minutes=rng.randrange(0, 600_000))) for v in (0, 1) for _ in range(80)]
    asked += [(v, at) for v, s, e in events[:20] for at in (s - timedelta(hours=4), s, e) if e is not None] + [(1, T0)]
    asked = sorted(set(asked))
    e = spark.createDataFrame(events, "variety int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    w = spark.createDataFrame(asked, "variety int, start_bar timestamp_ntz")
    listed = listed_windows(e, "4 hours")
    assert listed.groupBy("variety", "start_ts", "end_ts").count().agg(F.max("count")).first()[0] <= 2 * max(events.count(x) for x in events)
    assert listed.select("_class").distinct().count() > 4
    got = sorted((r.variety, r.warned_at, r.start_ts, r.end_ts) for r in match_events(w, e).collect())
    wanted = sorted((v, t, s, x) for v, t in asked for u, s, x in events if u == v and x is not None and s - timedelta(hours=4) <= t <= x)
    assert got == wanted and len(got) > 100
    assert match_events(w, e.where("false")).count() == 0


@pytest.mark.parametrize("strict", [True, False])
def test_asof_over_ranges_matches_brute_force(spark, strict):
    """Ticks of several series, one holding most, with ties, nulls and gaps wider than a range."""
    rng = random.Random(8)
    ticks = [(rng.choice([0, 0, 0, 1, 2]), rng.choice([rng.randrange(0, 400), rng.randrange(5000, 5400)]), rng.choice([None, rng.randrange(9)])) for _ in range(800)]
    ticks += [(3, None, 1), (None, 5, 1)]
    asked = [(k, rng.choice([0, 1, 2, 3, 4]), rng.choice([rng.randrange(-5, 420), rng.randrange(4000, 5500), None])) for k in range(600)] + [(600, None, 10)]
    right = spark.createDataFrame(ticks, "s int, at int, v int")
    left = spark.createDataFrame(asked, "id int, s int, t int")
    joined = asof_join(left, right, "t", "at", ["s"], strict)
    assert joined.columns == ["id", "s", "t", "at", "v"]
    got = {r.id: (r.at, r.v) for r in joined.collect()}
    size = lambda v: -1 if v is None else v
    for k, s, t in asked:
        earlier = [(at, v) for u, at, v in ticks if u == s and None not in (s, at, t) and (at < t or (at == t and not strict))]
        assert got[k] == (max(earlier, key=lambda x: (x[0], size(x[1]))) if earlier else (None, None)), (k, s, t)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\((?:_at|_side|_part)", plan)  # every window has the series and its range as key, or the series
    assert asof_join(left, right.where("false"), "t", "at", ["s"]).where("at is not null").count() == 0


def test_asof_without_a_key_has_no_window_over_all_rows(spark):
    left = spark.createDataFrame([(k, float(k)) for k in range(200)], "t int, x double")
    right = spark.createDataFrame([(k, float(k)) for k in range(0, 200, 7)], "at int, v double")
    got = {r.t: r["at"] for r in asof_join(left, right, "t", "at", [], strict=True).collect()}
    assert got == {k: (k - 1) // 7 * 7 if k else None for k in range(200)}
