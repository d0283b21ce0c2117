"""Build every product from stored tables and write it below one folder.

    spark-submit --conf spark.checkpoint.dir=<shared folder> tailward/plans/run.py \\
        --quotes <archive root> --events <parquet> --macro <parquet> --split '2024-01-22 00:00:00' --out <folder>
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tailward import schemas
from tailward.operators import adaptive, graph, profiling, tailrisk, views, warnings
from tailward.plans.products import Products
from tailward.sources import archive


# Days after an alert, tail shares and alert levels of the robustness grid.
GRID_DAYS, GRID_ALPHAS, GRID_LEVELS = [1, 3, 5], [0.90, 0.95, 0.99], [1, 2, 3]


def write_products(p: Products, out: str) -> None:
    """Features, Greeks, warnings, adaptive alerts, backtest, both CVaR conventions, graph, sample and status."""
    archive.write_features(p.features, f"{out}/features")
    p.features = p.spark.read.schema(p.features.schema).parquet(f"{out}/features")  # what follows reads the product, not the quotes
    archive.write_features(p.greeks, f"{out}/greeks")
    archive.write_features(p.levels.select("variety", "bar", "hits_1", "hits_2", "hits_3", "raw_level", "level", "no_cuts"), f"{out}/warnings")
    archive.write_features(p.adaptive_alerts, f"{out}/adaptive_alerts")
    archive.write_metrics(adaptive.f1_gain(p.later(p.model_scored), p.model_taus), f"{out}/f1_gain")
    backtest = warnings.backtest(p.later(p.levels).select("variety", "bar", "level"), p.later(p.fused_tracks, "start_ts"))
    archive.write_metrics(backtest, f"{out}/backtest")
    risk = tailrisk.cvar_improvement(p.exposed)
    for convention in (tailrisk.METHOD, tailrisk.COMPETITION):
        archive.write_metrics(risk.where(F.col("convention") == convention), f"{out}/cvar_{convention}")
    archive.write_metrics(tailrisk.robust_subperiod(p.exposed), f"{out}/robustness")
    archive.write_graph(p.nodes, p.edges, f"{out}/graph")
    paths = graph.attribution_path(*p.layers)
    sampled = graph.stratified_sample(p.warned.select("variety", "bar", "level"), ["variety", "level"], 2, graph.moment_key())
    archive.write_metrics(sampled.join(paths, ["variety", "bar"]), f"{out}/explanation_sample")
    archive.write_metrics(views.latest_status(p.levels), f"{out}/latest_status")
    archive.write_metrics(views.level_heatmap(p.levels), f"{out}/level_heatmap")
    archive.write_metrics(views.top_warnings(p.episodes), f"{out}/top_warnings")
    archive.write_metrics(views.level_counts(p.levels), f"{out}/level_counts")
    archive.write_metrics(adaptive.tau_sweep(p.training(p.model_scored)), f"{out}/tau_sweep")
    grid = tailrisk.robust_grid(p.daily, tailrisk.alert_days(p.levels), GRID_DAYS, GRID_ALPHAS, GRID_LEVELS)
    archive.write_metrics(grid, f"{out}/robust_grid")
    archive.write_metrics(profiling.coverage(p.quotes, "variety", "ts"), f"{out}/coverage")
    p.fused.write.parquet(f"{out}/fused_events")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("quotes", "events", "macro", "split", "out"):
        args.add_argument(f"--{name}", required=True)
    a = args.parse_args()
    spark = SparkSession.builder.appName("tailward").getOrCreate()
    quotes = archive.read_archive(spark, a.quotes, schemas.QUOTES)
    events = spark.read.schema(schemas.EVENTS).parquet(a.events)
    macro = spark.read.schema(schemas.MACRO).parquet(a.macro)
    write_products(Products(quotes, events, macro, a.split), a.out)


if __name__ == "__main__":
    main()
