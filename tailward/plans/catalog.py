"""One query per operator. Each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailward import schemas
from tailward.operators import adaptive, events, features, graph, greeks, pricing, profiling, sessions, tailrisk, views, warnings
from tailward.operators.asof import asof_join
from tailward.operators.features import FEATURES
from tailward.plans.products import SOURCES, Z_SCORES, Products
from tailward.session import scratch_path
from tailward.sources import archive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The four exchange codes; quotes are dealt to them by variety.
EXCHANGES = ["SF", "INE", "DF", "GF"]

NUMERIC = ["fwd", "strike", "iv", "volume", "open_interest", "bid_size", "ask_size"]
GREEKS = ["delta", "gamma", "vega", "theta"]


def query(name: str) -> Callable[[Callable[[Products], DataFrame]], Callable[[Products], DataFrame]]:
    def register(build: Callable[[Products], DataFrame]) -> Callable[[Products], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Products.of_fixture(spark, sf_dir))
        return build

    return register


def uneven_query(name: str) -> Callable[[Callable[[Products], DataFrame]], Callable[[Products], DataFrame]]:
    """The same over the second derived quote table."""

    def register(build: Callable[[Products], DataFrame]) -> Callable[[Products], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Products.of_uneven_fixture(spark, sf_dir))
        return build

    return register


def rules(priced: bool) -> dict[str, Column]:
    quoted = {
        "expired": F.col("tenor_days") <= 0,
        "thin_open_interest": F.col("open_interest") < 110,
        "thin_book": F.col("bid_size") + F.col("ask_size") < 6,
    }
    unknown = F.col("price").isNull() | F.isnan("price")
    return {"price_unknown": unknown, "price_not_positive": F.col("price") <= 0, **quoted} if priced else quoted


def rounded(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Sources and sinks


def _with_exchange(quotes: DataFrame) -> DataFrame:
    codes = F.array(*[F.lit(e) for e in EXCHANGES])
    return quotes.withColumn("exchange", F.get(codes, F.col("variety") % 4))


@query("s1_read_archive")
def _(p: Products) -> DataFrame:
    root = scratch_path(p.spark, "archive")
    archive.write_archive(_with_exchange(p.quotes), root, EXCHANGES)
    back = archive.read_archive(p.spark, root, schemas.QUOTES)
    return profiling.count_ids(
        back,
        ["exchange", "variety"],
        "quote_id",
        n_rows=(F.count(F.lit(1)), F.sum),
        volume=(F.sum("volume"), F.sum),
        first_ts=(F.min("ts"), F.min),
        last_ts=(F.max("ts"), F.max),
    ).withColumnRenamed("n_distinct", "n_ids")


@query("s2_write_features")
def _(p: Products) -> DataFrame:
    path = scratch_path(p.spark, "features")
    archive.write_features(p.features, path)
    back = p.spark.read.parquet(path).select("variety", "bar", *FEATURES)
    return rounded(back, FEATURES)


@query("s3_write_metrics")
def _(p: Products) -> DataFrame:
    metrics = rounded(tailrisk.cvar(tailrisk.dual_side(p.daily), by=["variety", "side"]), ["cvar"])
    path = scratch_path(p.spark, "metrics")
    archive.write_metrics(metrics, path)
    return p.spark.read.schema(metrics.schema).json(path)


@query("s4_write_graph")
def _(p: Products) -> DataFrame:
    path = scratch_path(p.spark, "graph")
    archive.write_graph(p.nodes, p.edges, path)
    nodes, edges = archive.read_graph(p.spark, path)
    return nodes.select(F.lit("node").alias("part"), "id", F.col("type").alias("kind"), F.lit(None).cast("string").alias("dst")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("relation").alias("kind"), "dst")
    )


# Profiling and quality


@query("p1_profile")
def _(p: Products) -> DataFrame:
    return rounded(profiling.profile(p.quotes, NUMERIC), ["min_value", "max_value", "mean_value", "p50"], 6)


@query("p2_coverage")
def _(p: Products) -> DataFrame:
    return profiling.coverage(p.quotes, "variety", "ts")


@query("p2_missing_bars")
def _(p: Products) -> DataFrame:
    return profiling.missing_bars(p.quotes, "variety", "ts")


@query("p2_session_coverage")
def _(p: Products) -> DataFrame:
    return sessions.session_coverage(p.quotes, p.calendar)


@query("p2_missing_open_bars")
def _(p: Products) -> DataFrame:
    return sessions.missing_open_bars(p.quotes, p.calendar)


@query("p3_align_quality")
def _(p: Products) -> DataFrame:
    kept = profiling.clean(p.quotes, rules(priced=False))
    compared = profiling.align_quality(p.features, features.build_features(kept), ["variety", "bar"], FEATURES, 1e-6)
    return rounded(compared, ["max_abs_diff"], 6)


@query("p4_validate")
def _(p: Products) -> DataFrame:
    return profiling.rule_counts(pricing.black76_price(p.quotes), rules(priced=True))


@query("p4_violations")
def _(p: Products) -> DataFrame:
    return profiling.violations(pricing.black76_price(p.quotes), rules(priced=True)).select("quote_id", "rule")


@query("p5_dedup_latest")
def _(p: Products) -> DataFrame:
    keys = ["variety", "tenor_days", "mny_idx", "cp", "bar"]
    barred = p.quotes.withColumn("bar", F.window("ts", "15 minutes")["start"])
    last = profiling.dedup_latest(barred, keys, [F.col("ts").desc(), F.col("quote_id").desc()])
    return last.select(*keys, "quote_id", "ts")


# Bars, volatility and features


@query("f1_to_bars")
def _(p: Products) -> DataFrame:
    return p.bars


@query("f2_black76_price")
def _(p: Products) -> DataFrame:
    return rounded(pricing.black76_price(p.quotes).select("quote_id", "price"), ["price"], 6)


@query("f3_implied_vol")
def _(p: Products) -> DataFrame:
    inverted = pricing.implied_vol(pricing.black76_price(p.quotes))
    return inverted.select("quote_id", F.round("implied_vol", 6).alias("iv"))


@query("f4_iv_surface")
def _(p: Products) -> DataFrame:
    return rounded(features.iv_surface(p.quotes), ["iv"])


def _feature_query(number: int, name: str) -> None:
    build = getattr(features, f"feat_{name}")
    query(f"f{number}_feat_{name}")(lambda p: rounded(build(p.quotes), [name]))


for _number, _name in enumerate(FEATURES, start=5):
    _feature_query(_number, _name)


@query("f16_build_features")
def _(p: Products) -> DataFrame:
    return rounded(p.features, FEATURES)


@query("f17_rolling_zscore")
def _(p: Products) -> DataFrame:
    scores = features.rolling_zscore(p.features, FEATURES)
    return rounded(scores.select("variety", "bar", *Z_SCORES), Z_SCORES, 6)


# Greeks


@query("g1_select_atm")
def _(p: Products) -> DataFrame:
    atm = greeks.select_atm(p.quotes)
    return rounded(atm.select(*greeks.ATM_GROUP, "quote_id", "distance", "iv"), ["distance", "iv"])


@query("g2_greeks")
def _(p: Products) -> DataFrame:
    return rounded(pricing.greeks(p.quotes).select("quote_id", *GREEKS), GREEKS, 6)


@query("g3_hhi")
def _(p: Products) -> DataFrame:
    barred = p.quotes.withColumn("bar", F.window("ts", "15 minutes")["start"])
    return rounded(greeks.hhi(barred, ["variety", "bar"], "strike", "open_interest"), ["hhi"])


GREEK_COLUMNS = ["oi_hhi", "delta_call", "delta_put", "gamma", "vega", "theta"]


@query("g4_build_greeks")
def _(p: Products) -> DataFrame:
    return rounded(p.greeks, GREEK_COLUMNS, 6)


@query("g5_join_features")
def _(p: Products) -> DataFrame:
    # Greeks of the table with gaps, so that some keys have features alone.
    uneven = Products.of_uneven_fixture(p.spark, p.sf_dir)
    joined = greeks.join_features(p.features, uneven.greeks)
    return rounded(joined, FEATURES + GREEK_COLUMNS, 6)


# Events


@query("e1_fuse_events")
def _(p: Products) -> DataFrame:
    named, market = (p.exo.where(F.col("source") == s) for s in SOURCES)
    return events.fuse_events(named, market).withColumn("sources", F.array_join("sources", ","))


@query("e2_label_bars")
def _(p: Products) -> DataFrame:
    return events.label_bars(p.bars.select("variety", "bar"), p.exo)


@query("e2_session_labels")
def _(p: Products) -> DataFrame:
    return sessions.session_labels(p.bars.select("variety", "bar"), p.exo, p.calendar)


@query("e3_event_coverage")
def _(p: Products) -> DataFrame:
    return events.event_coverage(p.exo, p.quotes, SOURCES)


# Rule warnings and backtest


@query("w1_calibrate")
def _(p: Products) -> DataFrame:
    return p.cuts


@query("w1_calibrate_sketched")
def _(p: Products) -> DataFrame:
    days = warnings.sketch_days(p.training(p.scored), features.FEATURES)
    return warnings.calibrate_sketched(days)


@query("w2_score_levels")
def _(p: Products) -> DataFrame:
    return p.raw_levels.select("variety", "bar", "hits_1", "hits_2", "hits_3", "level", "no_cuts")


@query("w3_debounce")
def _(p: Products) -> DataFrame:
    return p.levels.select("variety", "bar", "level")


@query("w4_episodes")
def _(p: Products) -> DataFrame:
    return p.episodes


@query("w4_session_episodes")
def _(p: Products) -> DataFrame:
    return sessions.session_episodes(p.levels, p.calendar)


@query("w5_systemic")
def _(p: Products) -> DataFrame:
    return warnings.systemic(p.levels)


@query("w6_match_events")
def _(p: Products) -> DataFrame:
    pairs = warnings.match_events(p.episodes, p.fused)
    return rounded(pairs, ["lead_minutes", "first_lead_minutes"], 6)


@query("w7_backtest")
def _(p: Products) -> DataFrame:
    table = warnings.backtest(p.later(p.levels).select("variety", "bar", "level"), p.later(p.fused_tracks, "start_ts"))
    return rounded(table, ["precision", "recall", "f1", "mean_lead_minutes"], 6)


# Adaptive warnings


@query("a1_bc_fit")
def _(p: Products) -> DataFrame:
    return rounded(adaptive.bc_coefficients(p.model, p.scored), ["weight"], 6)


@query("a2_bc_score")
def _(p: Products) -> DataFrame:
    scored = adaptive.bc_score(p.model, p.later(p.scored))
    return rounded(scored.select("variety", "bar", "score"), ["score"], 6)


@query("a1_tuning_sweep")
def _(p: Products) -> DataFrame:
    return rounded(adaptive.tuning_sweep(p.training(p.labelled), Z_SCORES), ["log_loss"], 6)


@query("a1_bc_gradient")
def _(p: Products) -> DataFrame:
    found = adaptive.bc_gradient(p.model, p.training(p.labelled))
    return found.select("feature", (F.abs("gradient") < 1e-4).alias("at_optimum"))


@query("a2_bc_score_by_weights")
def _(p: Products) -> DataFrame:
    both = adaptive.bc_score_by_weights(p.model, adaptive.bc_score(p.model, p.later(p.scored)), "written_out")
    return both.select("variety", "bar", (F.abs(F.col("score") - F.col("written_out")) < 1e-9).alias("agrees"))


@query("a5_adaptive_rule")
def _(p: Products) -> DataFrame:
    rule = (F.col("score") >= F.col("tau_star")) & (F.col("rule_level") >= 1)
    return p.adaptive_alerts.select("variety", "bar", "rule_level", (F.col("alert") == rule).alias("follows_rule"))


def _sweep(p: Products) -> DataFrame:
    return adaptive.tau_sweep(p.training(p.labelled).select("variety", "score", "label"))


@query("a3_tau_sweep")
def _(p: Products) -> DataFrame:
    return rounded(_sweep(p), ["precision", "recall", "f1"])


@query("a4_tau_star")
def _(p: Products) -> DataFrame:
    return rounded(adaptive.tau_star(_sweep(p)), ["best_f1"])


@query("a5_double_confirm")
def _(p: Products) -> DataFrame:
    later = p.later(p.labelled).select("variety", "bar", "score")
    return adaptive.double_confirm(later, p.levels, adaptive.tau_star(_sweep(p)))


@query("a5_adaptive_alerts")
def _(p: Products) -> DataFrame:
    return rounded(p.adaptive_alerts, ["score"], 6)


@query("a6_f1_gain")
def _(p: Products) -> DataFrame:
    later = p.later(p.labelled).select("variety", "bar", "score", "label")
    return rounded(adaptive.f1_gain(later, adaptive.tau_star(_sweep(p))), ["f1_adaptive", "f1_fixed", "gain"], 6)


# Tail risk


@query("c1_log_returns")
def _(p: Products) -> DataFrame:
    return rounded(tailrisk.log_returns(p.bars).select("variety", "bar", "close", "ret"), ["ret"])


@query("c2_cvar")
def _(p: Products) -> DataFrame:
    losses = tailrisk.log_returns(p.bars).withColumn("loss", -F.col("ret"))
    return rounded(tailrisk.cvar(losses, by=["variety"]), ["cvar"])


@query("c3_dual_side")
def _(p: Products) -> DataFrame:
    losses = tailrisk.dual_side(tailrisk.log_returns(p.bars))
    return rounded(tailrisk.cvar(losses, by=["side"]), ["cvar"])


@query("c4_de_expose")
def _(p: Products) -> DataFrame:
    out = p.exposed.select("variety", "day", "ret", "day_level", "exposure", "strategy_ret")
    return rounded(out, ["ret", "strategy_ret"])


IMPROVEMENT = ["cvar_base", "cvar_strategy", "improvement"]


@query("c5_cvar_improvement")
def _(p: Products) -> DataFrame:
    return rounded(tailrisk.cvar_improvement(p.exposed), IMPROVEMENT, 6)


@query("c6_robust_grid")
def _(p: Products) -> DataFrame:
    grid = tailrisk.robust_grid(p.daily, tailrisk.alert_days(p.levels), [1, 3, 5], [0.90, 0.95, 0.99], [1, 2, 3])
    return rounded(grid, IMPROVEMENT, 6)


@query("c6_block_bootstrap")
def _(p: Products) -> DataFrame:
    return rounded(tailrisk.bootstrap_improvement(p.exposed), ["low", "median", "high", "share_above"], 6)


@query("c7_robust_subperiod")
def _(p: Products) -> DataFrame:
    return rounded(tailrisk.robust_subperiod(p.exposed), IMPROVEMENT, 6)


# Knowledge graph


@query("k1_kg_nodes")
def _(p: Products) -> DataFrame:
    return p.nodes


@query("k2_trigger_edges")
def _(p: Products) -> DataFrame:
    return p.triggers


@query("k3_similar_history")
def _(p: Products) -> DataFrame:
    return rounded(p.analogues, ["distance"], 6)


@query("k4_macro_asof")
def _(p: Products) -> DataFrame:
    return graph.macro_asof(p.bars.select("variety", "bar"), p.macro)


@query("k4_quote_asof")
def _(p: Products) -> DataFrame:
    """The forward price last quoted at or before the start of each event."""
    quoted = p.quotes.select("variety", F.col("ts").alias("quoted_at"), "fwd")
    return asof_join(p.exo.select("src_id", "variety", "start_ts"), quoted, "start_ts", "quoted_at", ["variety"])


@query("k5_market_pattern")
def _(p: Products) -> DataFrame:
    return graph.market_pattern(p.scored).select("variety", "bar", "pattern")


@query("k6_conclude")
def _(p: Products) -> DataFrame:
    return graph.explain(p.levels, p.macro).select("variety", "bar", "level", "obs_date", "macro_high", "conclusion")


@query("k7_kg_edges")
def _(p: Products) -> DataFrame:
    return p.edges


@query("k8_attribution_path")
def _(p: Products) -> DataFrame:
    paths = graph.attribution_path(p.explained, p.triggers, p.analogues)
    flat = paths.select("variety", "bar", F.posexplode("path").alias("pos", "step"))
    return flat.select("variety", "bar", (F.col("pos") + 1).alias("step_no"), "step.layer", "step.kind", "step.item")


@query("k9_trace")
def _(p: Products) -> DataFrame:
    nodes, edges = p.graph
    severe = p.warned.where(F.col("level") == 3).select(graph.node_id(graph.WARNING, graph.moment_key()).alias("id"))
    return graph.trace(edges, severe).join(nodes, "id").select("id", "type", "hops")


@query("k9_trace_routes")
def _(p: Products) -> DataFrame:
    nodes, edges = p.graph
    severe = p.warned.where(F.col("level") == 3).select(graph.node_id(graph.WARNING, graph.moment_key()).alias("id"))
    said = F.transform("route", lambda s: F.concat(F.coalesce(F.concat(F.lit("-"), s["relation"], F.lit("> ")), F.lit("")), s["id"]))
    return graph.trace_routes(edges, severe).join(nodes, "id").select("id", "type", "hops", F.array_join(said, " ").alias("route"))


@query("k10_kg_stats")
def _(p: Products) -> DataFrame:
    return rounded(graph.kg_stats(*p.graph), ["mean_degree"], 6)


@query("k11_kg_audit")
def _(p: Products) -> DataFrame:
    # Edges whose triggers come from the other quote table: every kind of problem appears.
    uneven = Products.of_uneven_fixture(p.spark, p.sf_dir)
    explained, _, analogues = p.layers
    return graph.kg_audit(p.nodes, graph.kg_edges(explained, uneven.triggers, analogues))


@query("k12_stratified_sample")
def _(p: Products) -> DataFrame:
    sample = graph.stratified_sample(p.warned, ["variety", "level"], 2, graph.moment_key())
    return sample.select("variety", "level", "bar", "sample_no")


# Tables behind the dashboard


@query("v1_level_heatmap")
def _(p: Products) -> DataFrame:
    return views.level_heatmap(p.levels)


@query("v2_latest_status")
def _(p: Products) -> DataFrame:
    return views.latest_status(p.levels)


@query("v3_top_warnings")
def _(p: Products) -> DataFrame:
    return views.top_warnings(p.episodes)


@query("v4_level_counts")
def _(p: Products) -> DataFrame:
    return views.level_counts(p.levels)


# The same operators over quotes with irregular tenors, bent smiles, gaps, zero strikes and unknown volatilities


for _name in ("atm_iv", "skew", "curvature", "term_slope"):

    def _uneven_feature(name: str) -> None:
        build = getattr(features, f"feat_{name}")
        uneven_query(f"f{5 + FEATURES.index(name)}b_feat_{name}")(lambda p: rounded(build(p.quotes), [name]))

    _uneven_feature(_name)


@uneven_query("f2b_black76_price")
def _(p: Products) -> DataFrame:
    return rounded(pricing.black76_price(p.quotes).select("quote_id", "price"), ["price"], 6)


@uneven_query("f16b_build_features")
def _(p: Products) -> DataFrame:
    return rounded(p.features, FEATURES)


@uneven_query("f17b_rolling_zscore")
def _(p: Products) -> DataFrame:
    scores = features.rolling_zscore(p.features, FEATURES)
    return rounded(scores.select("variety", "bar", *Z_SCORES), Z_SCORES, 6)


@uneven_query("g4b_build_greeks")
def _(p: Products) -> DataFrame:
    return rounded(p.greeks, GREEK_COLUMNS, 6)


@uneven_query("k5b_market_pattern")
def _(p: Products) -> DataFrame:
    return graph.market_pattern(p.scored).select("variety", "bar", "pattern")


@uneven_query("p3b_align_quality")
def _(p: Products) -> DataFrame:
    even = Products.of_fixture(p.spark, p.sf_dir)
    return rounded(profiling.align_quality(even.features, p.features, ["variety", "bar"], FEATURES, 1e-6), ["max_abs_diff"], 6)


@uneven_query("p4b_validate")
def _(p: Products) -> DataFrame:
    return profiling.rule_counts(pricing.black76_price(p.quotes), rules(priced=True))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warning level of each variety in its latest 15-minute bar."""
    return QUERIES["v2_latest_status"](spark, sf_dir)
