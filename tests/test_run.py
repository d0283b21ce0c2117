"""The whole run, from a stored archive to written products."""

from __future__ import annotations

from tailward import schemas
from tailward.operators.features import FEATURES
from tailward.plans.products import SPLIT, Products
from tailward.plans.run import write_products
from tailward.sources import archive, fixture


def test_products_from_an_archive(spark, sf_dir, tmp_path):
    root, out = str(tmp_path / "archive"), str(tmp_path / "out")
    fixture.quotes(spark, sf_dir).write.parquet(f"{root}/SF/2024")
    stored = archive.read_archive(spark, root, schemas.QUOTES)
    write_products(Products(stored, fixture.exo_events(spark, sf_dir), fixture.macro(spark, sf_dir), SPLIT), out)

    features = spark.read.parquet(f"{out}/features")
    assert set(features.columns) == {"variety", "bar", *FEATURES}
    assert features.count() == spark.read.parquet(f"{out}/greeks").count() == spark.read.parquet(f"{out}/warnings").count()
    alerts = spark.read.parquet(f"{out}/adaptive_alerts")
    assert alerts.where("alert and (rule_level < 1 or round(score, 6) < tau_star)").count() == 0
    assert spark.read.json(f"{out}/backtest").count() == 6
    assert spark.read.json(f"{out}/f1_gain").count() == 1
    assert spark.read.json(f"{out}/cvar_method").count() == 1 and spark.read.json(f"{out}/cvar_competition").count() == 2
    nodes, edges = archive.read_graph(spark, f"{out}/graph")
    assert edges.join(nodes, edges.dst == nodes.id, "left_anti").count() == 0
    sample = spark.read.json(f"{out}/explanation_sample")
    assert sample.groupBy("variety", "level").count().where("count > 2").count() == 0
    assert spark.read.json(f"{out}/latest_status").count() == 6
    assert spark.read.json(f"{out}/robust_grid").count() == 3 * 3 * 3 * 3
    for name in ("level_heatmap", "level_counts", "tau_sweep", "coverage"):
        assert not spark.read.json(f"{out}/{name}").isEmpty()
    assert not spark.read.parquet(f"{out}/fused_events").isEmpty()
