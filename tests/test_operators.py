"""Hand-made rows: nulls, ties, single-row groups, zero denominators and boundaries."""

from __future__ import annotations

import math
import re
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailward import schemas
from tailward.functions.normal import norm_cdf
from tailward.operators import adaptive, bars, events, features, graph, greeks, pricing, profiling, tailrisk, views, warnings
from tailward.plans.catalog import QUERIES, rules
from tailward.plans.products import Products
from tailward.sources import archive, fixture

T0 = datetime(2024, 1, 1, 9)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def quote(quote_id, minutes, cp="C", mny=0, tenor=30, iv=0.2, volume=10, oi=100, bid=5, ask=5, side=0, variety=0, fwd=100.0):
    return (quote_id, at(minutes), variety, fwd, tenor, cp, mny, fwd * (1 + mny / 20), iv, volume, oi, bid, ask, side)


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schemas.QUOTES)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# Sources


def test_archive_takes_the_exchange_from_the_path(spark, tmp_path, table):
    for i, code in enumerate(["SF", "INE"]):
        table(quote(i, 0)).write.parquet(str(tmp_path / code / "2024"))
    table(quote(9, 0)).write.parquet(str(tmp_path / "exchange=GF"))
    df = archive.read_archive(spark, str(tmp_path), schemas.QUOTES)
    assert {(r.quote_id, r.exchange) for r in df.collect()} == {(0, "SF"), (1, "INE"), (9, "GF")}


def test_archive_is_written_by_exchange_without_a_sort(spark, tmp_path, table):
    df = table(quote(1, 0), quote(2, 0, variety=1)).withColumn("exchange", F.when(F.col("variety") == 0, "SF").otherwise("INE"))
    archive.write_archive(df, str(tmp_path / "a"), ["SF", "INE"])
    back = archive.read_archive(spark, str(tmp_path / "a"), schemas.QUOTES)
    assert {(r.quote_id, r.exchange) for r in back.collect()} == {(1, "SF"), (2, "INE")}
    for k, wrong in enumerate((F.lit("XX"), F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="is not one of"):
            archive.write_archive(df.withColumn("exchange", wrong), str(tmp_path / f"b{k}"), ["SF", "INE"])


def test_ids_count_once_and_neighbours_share_a_row(spark):
    ids = [0, 1, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63), 1, 1]
    df = spark.createDataFrame([(1, i) for i in ids] + [(2, None)], "k int, id bigint")
    out = profiling.count_ids(df, ["k"], "id", n=(F.count(F.lit(1)), F.sum), least=(F.min("id"), F.min))
    assert {(r.k, r.n_distinct, r.n, r.least) for r in out.collect()} == {(1, 9, 11, -(2**63)), (2, 0, 1, None)}
    dense = profiling.count_ids(spark.range(0, 64_000, 1, 1), [], "id")
    assert one(dense).n_distinct == 64_000
    quotes = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    text = profiling.count_ids(quotes, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "partial_bit_or" in text


def test_archive_refuses_what_it_cannot_place(spark, tmp_path, table):
    table(quote(1, 0)).write.parquet(str(tmp_path / "a" / "2024" / "01"))
    with pytest.raises(ValueError, match="no exchange"):
        archive.read_archive(spark, str(tmp_path / "a"), schemas.QUOTES)
    table(quote(1, 0)).drop("iv").write.parquet(str(tmp_path / "b" / "SF"))
    with pytest.raises(ValueError, match="iv"):
        archive.read_archive(spark, str(tmp_path / "b"), schemas.QUOTES)


def test_schema_check(table):
    archive.check_schema(table(quote(1, 0)), schemas.QUOTES)
    with pytest.raises(ValueError, match="iv"):
        archive.check_schema(table(quote(1, 0)).drop("iv"), schemas.QUOTES)


def test_fixtures_follow_their_schemas(spark, sf_dir):
    archive.check_schema(fixture.quotes(spark, sf_dir), schemas.QUOTES)
    archive.check_schema(fixture.uneven_quotes(spark, sf_dir), schemas.QUOTES)
    archive.check_schema(fixture.exo_events(spark, sf_dir), schemas.EVENTS)
    archive.check_schema(fixture.macro(spark, sf_dir), schemas.MACRO)


# Quality


def test_coverage_shows_days_without_any_row(table):
    df = table(quote(1, 0), quote(2, 2 * 24 * 60))
    rows = {r.day: (r.n_present, r.n_missing) for r in profiling.coverage(df, "variety", "ts").collect()}
    assert rows == {date(2024, 1, 1): (1, 95), date(2024, 1, 2): (0, 96), date(2024, 1, 3): (1, 95)}
    assert profiling.missing_bars(df, "variety", "ts").count() == 286


def test_null_rule_is_not_broken(table):
    df = table(quote(1, 0, iv=None), quote(2, 0, iv=-1.0), quote(3, 0))
    rules = {"iv_low": F.col("iv") < 0, "oi_zero": F.col("open_interest") == 0}
    bad, counts, kept = profiling.validate(df, rules)
    assert [(r.quote_id, r.rule) for r in bad.collect()] == [(2, "iv_low")]
    assert {r.rule: r.n_rows for r in counts.collect()} == {"iv_low": 1, "oi_zero": 0, "(clean)": 2}
    assert sorted(r.quote_id for r in kept.collect()) == [1, 3]


def test_latest_breaks_ties_by_id(table):
    df = table(quote(1, 0), quote(2, 5), quote(3, 5))
    assert one(profiling.dedup_latest(df, ["variety"], [F.col("ts").desc(), F.col("quote_id").desc()])).quote_id == 3


def test_align_counts_each_side(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, x double")
    right = spark.createDataFrame([(1, 1.05), (3, 3.0), (4, 4.0)], "k int, x double")
    r = one(profiling.align_quality(left, right, ["k"], ["x"], 0.1))
    assert (r.n_matched, r.n_left_only, r.n_right_only, r.n_compared, r.n_within) == (2, 1, 1, 1, 1)
    assert r.max_abs_diff == pytest.approx(0.05)


# Bars and pricing


def test_bars_order_equal_times_by_id(table):
    df = table(quote(2, 1, fwd=102.0), quote(1, 1, fwd=101.0), quote(3, 14.9, fwd=99.0), quote(4, 15, fwd=50.0))
    first, second = bars.to_bars(df, "variety", "ts", "fwd", "volume", "quote_id").orderBy("bar").collect()
    assert (first.open, first.high, first.low, first.close, first.volume, first.n_rows) == (101.0, 102.0, 99.0, 99.0, 30, 3)
    assert second.bar == at(15) and second.open == second.close == 50.0


def test_bars_keep_the_order_of_any_id_and_instant(spark):
    far, low = 2**63 - 1, -(2**63)
    rows = [(1, at(1), far, 1.0), (1, at(1), low, 2.0), (1, at(1), 0, 3.0), (2, at(1), low, 4.0), (2, at(1), None, 5.0), (3, at(1), far, 6.0)]
    rows += [(3, at(1) + timedelta(microseconds=1), low, 7.0), (None, at(2), 1, 8.0)]
    df = spark.createDataFrame(rows, "variety int, ts timestamp_ntz, quote_id bigint, fwd double").withColumn("volume", F.lit(1))
    by_time = {r.variety: (r.open, r.close) for r in bars.to_bars(df, "variety", "ts", "fwd", "volume", "quote_id").collect()}
    assert by_time == {1: (2.0, 1.0), 2: (5.0, 4.0), 3: (6.0, 7.0), None: (8.0, 8.0)}
    assert {r.variety: r.close for r in tailrisk.daily_closes(df).collect()} == {1: 1.0, 2: 4.0, 3: 7.0, None: 8.0}


def test_no_task_sorts_quotes_for_bars_or_greeks(table):
    df = table(quote(1, 0))
    for out in (bars.to_bars(df, "variety", "ts", "fwd", "volume", "quote_id"), tailrisk.daily_closes(df), greeks.build_greeks(df)):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_parity_and_round_trip(spark, sf_dir):
    quotes = fixture.quotes(spark, sf_dir)
    priced = pricing.black76_price(quotes.withColumn("iv", F.lit(0.3)))
    sides = priced.groupBy("ts", "variety", "tenor_days", "mny_idx", "fwd", "strike").pivot("cp", ["C", "P"]).agg(F.first("price"))
    gap = sides.select(F.max(F.abs(pricing.put_call_gap(F.col("C"), F.col("P"), F.col("fwd"), F.col("strike"))))).first()[0]
    assert gap < 1e-9
    back = pricing.implied_vol(pricing.black76_price(quotes))
    assert back.select(F.max(F.abs(F.col("implied_vol") - F.col("iv")))).first()[0] < 1e-9


def test_price_is_close_to_the_closed_form(table):
    row = one(pricing.black76_price(table(quote(1, 0, mny=1, iv=0.25))))
    sd = 0.25 * math.sqrt(30 / 365)
    d1 = math.log(100 / 105) / sd + sd / 2
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    assert row.price == pytest.approx(100 * cdf(d1) - 105 * cdf(d1 - sd), abs=1e-12)


def test_normal_distribution_in_double_precision(spark):
    xs = [k / 8 for k in range(-80, 81)] + [7.07, 7.08, -7.07, -7.08, -20.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-9, abs=1e-15)


def test_volatility_takes_few_steps_and_equals_bisection():
    rng = np.random.default_rng(0)
    n = 20_000
    fwd, years = rng.uniform(80, 150, n), rng.uniform(0.02, 2, n)
    strike, vol = fwd * np.exp(rng.normal(0, 0.2, n)), np.exp(rng.uniform(np.log(0.05), np.log(3), n))

    def worth(iv):
        d1 = np.log(fwd / strike) / (iv * np.sqrt(years)) + iv * np.sqrt(years) / 2
        return fwd * pricing._cdf(d1) - strike * pricing._cdf(d1 - iv * np.sqrt(years))

    price = worth(vol)
    found, taken = pricing.call_volatility(price, fwd, strike, years, 1e-4, 5.0, 1e-11, 60)
    low, high = np.full(n, 1e-4), np.full(n, 5.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = worth(mid) < price
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    d1 = np.log(fwd / strike) / (vol * np.sqrt(years)) + vol * np.sqrt(years) / 2
    firm = fwd * np.sqrt(years) * np.exp(-d1 * d1 / 2) > 1e-2  # a price that says what the volatility is
    assert firm.mean() > 0.9 and np.abs(found - mid)[firm].max() < 1e-9
    assert taken[firm].mean() < 11 and np.quantile(taken[firm], 0.99) < 25


def test_price_methods_stay_below_the_compile_limit(spark, sf_dir):
    """The generated methods of pricing queries are small enough for the JVM to compile."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # only a plan that is final has its code
    try:
        for name in ("f2_black76_price", "p4_validate", "f3_implied_vol"):
            plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
            text = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000, (name, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_sketched_cuts_merge_by_day_within_their_rank_error(spark):
    rng = np.random.default_rng(5)
    n = 40_000
    size = rng.standard_t(1.5, n)
    rows = [(int(k % 3), T0 + timedelta(minutes=15 * (k // 3)), float(v), None) for k, v in enumerate(size)]
    df = spark.createDataFrame(rows, "variety int, bar timestamp_ntz, z_a double, z_b double")
    days = warnings.sketch_days(df, ["a", "b"], k=400)
    assert days.select("day").distinct().count() > 100
    merged = warnings.merge_sketches(days.where("day < '2024-02-01'")).unionByName(days.where("day >= '2024-02-01'").select("variety", "feature", "n", "sketch"))
    cuts = {(r.variety, r.feature): r for r in warnings.calibrate_sketched(merged).collect()}
    assert len(cuts) == 6
    for v in range(3):
        held = np.sort(np.abs(size[v::3]))
        row = cuts[v, "a"]
        for q, cut in zip(warnings.CUT_QUANTILES, (row.cut_1, row.cut_2, row.cut_3), strict=True):
            assert abs(np.searchsorted(held, cut, "right") / len(held) - q) < 2.5 / 400**0.94
        assert cuts[v, "b"].cut_1 is None
    whole = {(r.variety, r.feature): r for r in warnings.calibrate_sketched(warnings.sketch_days(df.where("bar < '2024-01-05'"), ["a"], k=4096)).collect()}
    for v in range(3):
        few = np.sort(np.round(np.abs(size[v::3][: 96 * 4 - 36]), 6))
        for q, cut in zip(warnings.CUT_QUANTILES, (whole[v, "a"].cut_1, whole[v, "a"].cut_2, whole[v, "a"].cut_3), strict=True):
            assert cut == few[int(np.ceil(q * len(few))) - 1]


def test_rows_without_a_price_are_null_and_counted(table):
    df = pricing.black76_price(table(quote(1, 0), quote(2, 0), quote(3, 0, iv=None)).withColumn("strike", F.when(F.col("quote_id") == 1, 0.0).otherwise(100.0)))
    got = {r.quote_id: r.price for r in df.collect()}
    assert got[1] is None and got[3] is None and got[2] > 0
    counts = {r.rule: r.n_rows for r in profiling.rule_counts(df, rules(priced=True)).collect()}
    assert counts["price_unknown"] == 2 and counts["price_not_positive"] == 0


def test_implied_vol_is_null_beyond_the_bracket(table):
    df = pricing.black76_price(table(quote(1, 0, iv=6.0), quote(2, 0, iv=0.00005), quote(3, 0, iv=0.3)))
    got = {r.quote_id: r.implied_vol for r in pricing.implied_vol(df).collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(0.3, abs=1e-9)


def test_near_and_far_are_the_nearest_listed_tenors(table):
    rows = [quote(k, 0, tenor=t, iv=iv) for k, (t, iv) in enumerate([(28, 0.9), (33, 0.2), (40, 0.8), (88, 0.7), (95, 0.26), (120, 0.5)])]
    row = one(features.build_features(table(*rows), only=["atm_iv", "term_slope"]))
    assert row.atm_iv == pytest.approx(0.2) and row.term_slope == pytest.approx(0.06)
    other = one(features.build_features(table(*rows), only=["atm_iv"], near=34))
    assert other.atm_iv == pytest.approx(0.8)
    assert one(features.build_features(table(*rows), only=["atm_iv"], near=121)).atm_iv is None


def test_uneven_quotes_exercise_every_feature_and_pattern(spark):
    p = Products.of_uneven_fixture(spark, "/root/testdata/sf0.01")
    distinct = p.features.agg(*[F.count_distinct(F.round(c, 6)).alias(c) for c in features.FEATURES]).first()
    assert all(distinct[c] > 1 for c in features.FEATURES)
    patterns = {r.pattern for r in graph.market_pattern(p.scored).select("pattern").distinct().collect()}
    assert patterns == {"skew_steep", "term_inverted", "wing_rich", "flow_shock", "calm"}


def test_implied_vol_is_null_outside_the_bounds(table):
    df = table(quote(1, 0, mny=-1), quote(2, 0, mny=-1), quote(3, 0, cp="P", mny=1), quote(4, 0), quote(5, 0))
    price = F.create_map(*[F.lit(x) for x in (1, 4.9, 2, 100.0, 3, 4.9, 4, None, 5, 2.0)])
    got = {r.quote_id: r.implied_vol for r in pricing.implied_vol(df.withColumn("price", price[F.col("quote_id").cast("int")])).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [None] * 4 and got[5] > 0


def test_greeks_of_call_and_put(table):
    call, put = pricing.greeks(table(quote(1, 0), quote(2, 0, cp="P"))).orderBy("quote_id").collect()
    assert call.delta - put.delta == pytest.approx(1.0)
    assert call.gamma == put.gamma > 0 and call.vega == put.vega > 0 and call.theta < 0


# Features


def surface(minutes, start, atm=0.2, **kw):
    rows, i = [], start
    for tenor in (30, 90):
        for mny in (-2, 0, 2):
            for cp in ("C", "P"):
                iv = atm + (0.01 if tenor == 90 else 0) + 0.02 * abs(mny) / 2 + (0.004 if cp == "P" else 0)
                rows.append(quote(i, minutes, cp, mny, tenor, iv, **kw))
                i += 1
    return rows


def test_structure_features(table):
    row = one(features.build_features(table(*surface(0, 0))))
    assert row.atm_iv == pytest.approx(0.202)
    assert row.skew == pytest.approx(0.004)
    assert row.curvature == pytest.approx(0.222 - 0.202)
    assert row.term_slope == pytest.approx(0.01)
    assert row.cp_gap == pytest.approx(0.004)
    assert row.iv_change is None and row.volume_surge is None and row.oi_change is None


def test_flow_features_and_lags(table):
    rows = [*surface(0, 0, volume=10, side=1), *surface(45, 100, atm=0.25, volume=30, oi=150, bid=9, ask=1)]
    first, second = features.build_features(table(*rows)).orderBy("bar").collect()
    assert first.signed_flow == 1.0 and second.signed_flow == 0.0
    assert second.depth_imbalance == pytest.approx(0.8) and second.pc_volume == 1.0
    assert second.iv_change == pytest.approx(0.05)
    assert second.volume_surge == pytest.approx(3.0) and second.oi_change == pytest.approx(0.5)


def test_features_of_a_bar_with_calls_only(table):
    row = one(features.build_features(table(quote(1, 0, "C", 0, 30, 0.3), quote(2, 0, "C", 0, 30, None))))
    assert row.atm_iv == pytest.approx(0.3) and row.pc_volume == 0.0
    assert row.skew is None and row.cp_gap is None and row.term_slope is None


def test_no_call_volume_gives_null(table):
    assert one(features.feat_pc_volume(table(quote(1, 0, "P")))).pc_volume is None


def test_single_features_equal_the_table(spark, sf_dir):
    quotes = fixture.quotes(spark, sf_dir).where(F.col("variety") == 2)
    whole = features.build_features(quotes)
    for name in features.FEATURES:
        alone = getattr(features, f"feat_{name}")(quotes).withColumnRenamed(name, "alone")
        unlike = whole.join(alone, ["variety", "bar"]).where(~F.col(name).eqNullSafe(F.col("alone")) & (F.abs(F.col(name) - F.col("alone")) > 1e-12))
        assert unlike.count() == 0, name


def test_zscore_waits_and_ignores_flat_series(spark):
    rows = [(0, at(15 * i), float(i % 3), 0.1 + 0.2) for i in range(6)]
    df = spark.createDataFrame(rows, "variety int, bar timestamp_ntz, x double, flat double")
    got = features.rolling_zscore(df, ["x", "flat"], n=3).orderBy("bar").collect()
    assert [r.z_x for r in got[:3]] == [None] * 3
    assert got[3].z_x == pytest.approx(-1.0)
    assert all(r.z_flat is None for r in got)


# Greeks


def test_atm_ties_go_to_the_lowest_id(table):
    picked = one(greeks.select_atm(table(quote(7, 1, mny=1), quote(5, 2, mny=-1), quote(9, 3, mny=2))))
    assert picked.quote_id == 5


def test_greeks_take_the_lowest_id_whole_and_keep_bars_without_a_pair(table):
    rows = [quote(7, 1, mny=1, iv=0.3), quote(5, 2, mny=-1, iv=0.5), quote(5, 3, mny=1, iv=0.7), quote(1, 1, mny=2)]  # an id that occurs twice
    rows += [quote(8, 1, tenor=29, variety=1), quote(9, 1, "P", tenor=45, variety=2), quote(10, 1, tenor=90, variety=2), quote(11, 1, variety=None)]
    got = {r.variety: r for r in greeks.build_greeks(table(*rows)).collect()}
    both = greeks.build_greeks(table(*rows[1:2])), greeks.build_greeks(table(*rows[2:3]))
    assert got[0].vega in [one(b).vega for b in both] and got[0].oi_hhi == pytest.approx(3 / 8)
    assert (got[1].oi_hhi, got[1].delta_call, got[1].vega) == (1.0, None, None)
    assert got[2].delta_call is None and got[2].delta_put < 0
    assert got[None].delta_call > 0


def test_hhi_bounds(table):
    df = table(quote(1, 0, mny=0, oi=50), quote(2, 0, mny=1, oi=50), quote(3, 0, mny=0, oi=0, variety=1))
    got = {r.variety: r.hhi for r in greeks.hhi(df, ["variety"], "strike", "open_interest").collect()}
    assert got == {0: 0.5, 1: None}


def test_unmatched_keys_are_kept(spark):
    f = spark.createDataFrame([(0, at(0), 1.0), (0, at(15), 2.0)], "variety int, bar timestamp_ntz, x double")
    g = spark.createDataFrame([(0, at(15), 3.0), (0, at(30), 4.0)], "variety int, bar timestamp_ntz, y double")
    rows = greeks.join_features(f, g).orderBy("bar").collect()
    assert [(r.has_features, r.has_greeks) for r in rows] == [(True, False), (True, True), (False, True)]


# Events


def test_coverage_shows_zero_cells(spark):
    e = spark.createDataFrame([(0, at(0), "named")], "variety int, start_ts timestamp_ntz, source string")
    keys = spark.createDataFrame([(0,), (1,)], "variety int")
    got = {(r.variety, r.source): r.n_events for r in events.event_coverage(e, keys, ["named", "market"]).collect()}
    assert got == {(0, "named"): 1, (0, "market"): 0, (1, "named"): 0, (1, "market"): 0}


def test_coverage_shows_unlisted_sources_and_keys(spark):
    e = spark.createDataFrame([(0, at(0), "regulator"), (9, at(0), "named")], "variety int, start_ts timestamp_ntz, source string")
    got = {(r.variety, r.source): r.n_events for r in events.event_coverage(e, spark.createDataFrame([(0,)], "variety int"), ["named"]).collect()}
    assert got == {(0, "named"): 0, (0, "regulator"): 1, (9, "named"): 1}


# Warnings


def levels(spark, *values, variety=0, step=15):
    rows = [(variety, at(step * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "variety int, bar timestamp_ntz, level int")


def test_levels_grow_with_every_feature(spark):
    cols = ["a", "b", "c"]
    cuts = spark.createDataFrame([(0, c, 1.0, 2.0, 3.0) for c in cols], "variety int, feature string, cut_1 double, cut_2 double, cut_3 double")
    rows = [(0, 0.5, 9.0, None), (0, 1.0, 9.0, None), (0, 1.1, 9.0, None), (0, -2.5, 9.0, 0.0), (0, 4.0, -9.0, 0.0)]
    df = spark.createDataFrame(rows, "variety int, z_a double, z_b double, z_c double")
    assert [r.level for r in warnings.score_levels(df, cuts, cols).collect()] == [0, 0, 1, 2, 3]
    stranger = one(warnings.score_levels(df.limit(1).withColumn("variety", F.lit(7)), cuts, cols))
    assert stranger.level is None and stranger.no_cuts
    assert one(warnings.debounce(levels(spark, None))).level is None


def test_debounce(spark):
    got = warnings.debounce(levels(spark, 3, 3, 0, 2, 1), 2).orderBy("bar").collect()
    assert [r.level for r in got] == [0, 3, 0, 0, 1]


def test_episodes_split_on_gaps(spark):
    df = levels(spark, 1, 2, 0, 1, 0, 0, 3)
    got = warnings.episodes(df, 1, "30 minutes").orderBy("start_bar").collect()
    assert [(r.start_bar, r.end_bar, r.n_bars, r.peak_level) for r in got] == [(at(0), at(45), 3, 2), (at(90), at(90), 1, 3)]


def test_systemic_needs_enough_varieties(spark):
    df = levels(spark, 1, 2).unionByName(levels(spark, 1, 0, variety=1))
    got = warnings.systemic(df, 1, 2).orderBy("bar").collect()
    assert [(r.n_varieties, r.is_systemic) for r in got] == [(2, True), (1, False)]


def test_matching_includes_both_ends_and_midnight(spark):
    night = datetime(2024, 1, 2, 1)
    w = spark.createDataFrame([(0, night - timedelta(hours=4)), (0, night - timedelta(hours=4, minutes=1)), (0, night + timedelta(hours=1)), (1, night)], "variety int, start_bar timestamp_ntz")
    e = spark.createDataFrame([(0, night, night + timedelta(hours=1))], "variety int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = warnings.match_events(w, e).orderBy("warned_at").collect()
    assert [(r.lead_minutes, r.first_lead_minutes) for r in got] == [(240.0, 240.0), (-60.0, 240.0)]


def test_backtest_counts_and_null_ratios(spark):
    lv = levels(spark, 1, 0, 0, 0, 0, 0, 0, 0, 1)
    ev = spark.createDataFrame([(0, at(60), at(70))], "variety int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = {(r.track, r.min_level): r for r in warnings.backtest(lv, warnings.for_both_tracks(ev), "1 hour").collect()}
    first = got["variety", 1]
    assert (first.n_warnings, first.n_matched_warnings, first.precision, first.recall, first.mean_lead_minutes) == (2, 1, 0.5, 1.0, 60.0)
    none = got["system", 3]
    assert (none.n_warnings, none.n_events, none.precision, none.recall, none.mean_lead_minutes) == (0, 1, None, 0.0, None)


def test_mean_lead_is_exact_in_any_order(spark):
    leads = [6533191989, 6650458215, 12934111386]  # microseconds; as doubles of minutes every order of addition rounds down
    lv = spark.createDataFrame([(k, at(0), 1) for k in range(3)], "variety int, bar timestamp_ntz, level int")
    starts = [at(0) + timedelta(microseconds=m) for m in leads]
    ev = spark.createDataFrame([(k, s, s + timedelta(hours=1)) for k, s in enumerate(starts)], "variety int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = warnings.backtest(lv, ev).where("track = 'variety' and min_level = 1").select("*", F.round("mean_lead_minutes", 6).alias("mean")).first()
    assert (got.n_matched_events, got.mean) == (3, 145.098676)


# Adaptive


def test_sweep_matches_direct_counts(spark):
    rows = [(0, 0.1, 0), (0, 0.5, 1), (0, 0.5, 0), (0, 0.9, 1), (0, 0.05, 1), (0, None, 1), (1, 0.2, 0)]
    df = spark.createDataFrame(rows, "variety int, score double, label int")
    grid = [0.1, 0.5, 0.95]
    got = {(r.variety, r.tau): (r.tp, r.fp, r.fn) for r in adaptive.tau_sweep(df, grid=grid).collect()}
    for v in (0, 1):
        for t in grid:
            mine = [(s, y) for k, s, y in rows if k == v]
            hit = [y for s, y in mine if s is not None and s >= t]
            assert got[v, t] == (sum(hit), len(hit) - sum(hit), sum(y for _, y in mine) - sum(hit))
    overall = {r.tau: (r.tp, r.fp) for r in adaptive.tau_sweep(df, grid=grid, by=()).collect()}
    assert overall == {0.1: (2, 3), 0.5: (2, 1), 0.95: (0, 0)}


def test_best_threshold_ties_go_to_the_lowest(spark):
    df = spark.createDataFrame([(0, 0.3, 0.5), (0, 0.2, 0.5), (0, 0.1, 0.4), (1, 0.2, None), (1, 0.1, None)], "variety int, tau double, f1 double")
    assert {r.variety: r.tau_star for r in adaptive.tau_star(df).collect()} == {0: 0.2, 1: 0.1}


def test_double_confirmation_needs_both(spark):
    scores = spark.createDataFrame([(0, at(0), 0.6), (0, at(15), 0.6), (0, at(30), 0.4), (0, at(45), 0.9)], "variety int, bar timestamp_ntz, score double")
    rules = levels(spark, 1, 0, 2)
    taus = spark.createDataFrame([(0, 0.6)], "variety int, tau_star double")
    assert [r.alert for r in adaptive.double_confirm(scores, rules, taus).orderBy("bar").collect()] == [True, False, False, False]


def test_f1_gain(spark):
    df = spark.createDataFrame([(0, 0.4, 1), (0, 0.6, 1), (0, 0.1, 0)], "variety int, score double, label int")
    row = one(adaptive.f1_gain(df, spark.createDataFrame([(0, 0.3)], "variety int, tau_star double")))
    assert (row.f1_adaptive, row.f1_fixed) == (1.0, pytest.approx(2 / 3)) and row.gain == pytest.approx(0.5)


# Tail risk


def daily(spark, *rets):
    rows = [(0, date(2024, 1, 1) + timedelta(days=i), r) for i, r in enumerate(rets)]
    return spark.createDataFrame(rows, "variety int, day date, ret double")


def test_returns(spark):
    df = spark.createDataFrame([(0, at(0), 100.0), (0, at(15), 110.0), (0, at(30), 0.0), (0, at(45), 5.0)], "variety int, bar timestamp_ntz, close double")
    rets = [r.ret for r in tailrisk.log_returns(df).orderBy("bar").collect()]
    assert rets[0] is None and rets[1] == pytest.approx(math.log(1.1)) and rets[3] is None


def test_loss_equal_to_var_is_in_the_tail(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "loss double")
    row = one(tailrisk.cvar(df, alphas=[0.75]))
    assert (row["var"], row.cvar, row.n_tail) == (4.0, 4.5, 2)


def test_exposure_ends_after_h_days(spark):
    alerts = spark.createDataFrame([(0, date(2024, 1, 2), 2), (0, date(2024, 1, 3), 1)], "variety int, day date, day_level int")
    got = tailrisk.de_expose(daily(spark, 0.1, 0.1, 0.1, 0.1, 0.1), alerts, h=2).orderBy("day").collect()
    assert [r.exposure for r in got] == [1, 1, 0, 0, 1]


def test_an_alert_on_a_day_without_a_price_counts(spark):
    alerts = spark.createDataFrame([(0, date(2024, 1, 6), 3)], "variety int, day date, day_level int")
    returns = spark.createDataFrame([(0, date(2024, 1, d), 0.1) for d in (5, 8, 9)], "variety int, day date, ret double")
    got = tailrisk.de_expose(returns, alerts, h=2).orderBy("day").collect()
    assert [(r.day.day, r.exposure) for r in got] == [(5, 1), (8, 0), (9, 1)]


def test_improvement_per_convention(spark):
    alerts = spark.createDataFrame([(0, date(2024, 1, 3), 3)], "variety int, day date, day_level int")
    exposed = tailrisk.de_expose(daily(spark, 0.01, -0.01, 0.0, -0.5, 0.02), alerts, h=1)
    got = {(r.convention, r.side): r for r in tailrisk.cvar_improvement(exposed).collect()}
    assert set(got) == {("method", "long"), ("competition", "long"), ("competition", "short")}
    assert got["method", "long"].improvement == pytest.approx(1 - 0.01 / 0.5) and got["method", "long"].meets_target
    assert got["competition", "short"].improvement == pytest.approx(0.0) and not got["competition", "short"].meets_target


def test_grid_cell_equals_the_single_run(spark):
    alerts = spark.createDataFrame([(0, date(2024, 1, 3), 2)], "variety int, day date, day_level int")
    rets = daily(spark, 0.01, -0.01, 0.0, -0.5, 0.02, -0.03)
    grid = tailrisk.robust_grid(rets, alerts, [1, 3], [0.95], [1, 2, 3])
    assert grid.count() == 2 * 3 * 3
    cell = one(grid.where("h = 3 and level = 2 and convention = 'method'"))
    alone = one(tailrisk.cvar_improvement(tailrisk.de_expose(rets, alerts, 3, 2)).where("convention = 'method'"))
    assert cell.improvement == pytest.approx(alone.improvement)


# Graph


def test_macro_of_the_same_date_is_not_before(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 0),), (datetime(2024, 1, 2, 23),), (datetime(2024, 1, 5),), (datetime(2024, 1, 1),)], "bar timestamp_ntz")
    macro = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 2), 2.0)], schemas.MACRO)
    got = {r.bar.day: r.macro_index for r in graph.macro_asof(df, macro).collect()}
    assert got == {2: 1.0, 5: 2.0, 1: None}


def test_pattern_takes_the_first_rule(spark):
    rows = [(3.0, -1.0, 3.0, 0.9), (None, -0.1, 3.0, 0.9), (0.0, 0.1, 2.5, 0.9), (0.0, 0.1, 0.0, -0.6), (2.0, 0.0, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "z_skew double, term_slope double, z_curvature double, signed_flow double")
    assert [r.pattern for r in graph.market_pattern(df).collect()] == ["skew_steep", "term_inverted", "wing_rich", "flow_shock", "calm"]


def test_conclusions(spark):
    df = spark.createDataFrame([(3, None), (2, True), (2, None), (1, True), (0, True)], "level int, macro_high boolean")
    assert [r.conclusion for r in graph.conclude(df).collect()] == ["tail_risk", "vol_up", "watch", "watch", "none"]


@pytest.fixture
def small_graph(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("lone", "y")], "id string, type string")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("c", "gone", 1)], "src string, dst string, weight long")
    return nodes, edges.withColumn("relation", F.lit("r"))


def test_audit_finds_both_problems(small_graph):
    got = {(r.problem, r.src, r.dst) for r in graph.kg_audit(*small_graph).collect()}
    assert got == {("missing_target", "c", "gone"), ("node_without_edge", "lone", None)}


def test_trace_grows_with_depth_and_survives_cycles(spark, small_graph):
    seeds = spark.createDataFrame([("a",)], "id string")
    reach = [{r.id: r.hops for r in graph.trace(small_graph[1], seeds, d).collect()} for d in range(4)]
    assert reach == [{"a": 0}, {"a": 0, "b": 1}, {"a": 0, "b": 1, "c": 2}, {"a": 0, "b": 1, "c": 2, "gone": 3}]


def test_routes_keep_the_smallest_predecessor_and_survive_cycles(spark):
    rows = [("a", "c", "r"), ("b", "c", "q"), ("a", "c", "p"), ("c", "d", "r"), ("d", "a", "r"), ("b", "d", "z"), ("d", "e", "r"), ("c", "e", "s")]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string")
    seeds = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    got = {r.id: (r.hops, [tuple(x) for x in r.route]) for r in graph.trace_routes(edges, seeds).collect()}
    assert got == {
        "a": (0, [(None, "a")]),
        "b": (0, [(None, "b")]),
        "c": (1, [(None, "a"), ("p", "c")]),
        "d": (1, [(None, "b"), ("z", "d")]),
        "e": (2, [(None, "a"), ("p", "c"), ("s", "e")]),
    }
    hops = {r.id: r.hops for r in graph.trace(edges, seeds).collect()}
    assert hops == {k: v for k, (v, _) in got.items()}
    assert graph.trace_routes(edges, seeds.where("false")).count() == 0


def test_stats_totals(small_graph):
    got = {(r.part, r.type): r for r in graph.kg_stats(*small_graph).collect()}
    assert got["node", "(all)"].n == 4 and got["node", "y"].max_out == 2
    assert got["edge", "(all)"].total_weight == 5


def test_sample_is_stable_and_per_stratum(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("s"), "id")
    pick = lambda d: sorted(r.id for r in graph.stratified_sample(d, ["s"], 2, F.col("id").cast("string")).collect())
    assert len(pick(df)) == 6 and pick(df) == pick(df.repartition(7))


# Tables behind the dashboard


def test_dashboard_tables(spark):
    df = levels(spark, 0, 2, 1).unionByName(levels(spark, 3, variety=1))
    assert {r.variety: (r.bar, r.level) for r in views.latest_status(df).collect()} == {0: (at(30), 1), 1: (at(0), 3)}
    assert {(r.variety, r.peak_level) for r in views.level_heatmap(df).collect()} == {(0, 2), (1, 3)}
    total = one(views.level_counts(df).where("grouping_level = 3"))
    assert total.n_bars == 4
    assert [r.peak_level for r in views.top_warnings(warnings.episodes(df), 1).collect()] == [3]
