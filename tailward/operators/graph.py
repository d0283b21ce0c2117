"""A five-layer explanation graph as node and edge tables.

Layers: trigger factor, market pattern, historical analogue, macro environment,
conclusion. Ids are ``md5(type|key)``, so any engine can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailward.operators.warnings import strength
from tailward.operators.asof import asof_join
from tailward.session import stage

WARNING, TRIGGER, PATTERN, ANALOGUE, MACRO, CONCLUSION = "warning", "trigger", "pattern", "analogue", "macro", "conclusion"
LAYERS = (TRIGGER, PATTERN, ANALOGUE, MACRO, CONCLUSION)


def node_id(kind: str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(kind), key))


def moment_key(variety: str = "variety", bar: str = "bar") -> Column:
    return F.concat_ws("|", F.col(variety).cast("string"), F.col(bar).cast("string"))


def trigger_edges(warnings: DataFrame, cuts: DataFrame, cols: list[str], cut: int = 1) -> DataFrame:
    """Each warning with every feature past its cut, the direction and the size of the move."""
    long = warnings.select(
        "variety",
        "bar",
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"z_{c}").alias("z"), strength(c).alias("size")) for c in cols])),
    )
    marks = cuts.select("variety", "feature", F.col(f"cut_{cut}").alias("_cut"))
    past = long.where(F.col("size").isNotNull()).join(marks, ["variety", "feature"]).where(F.col("size") > F.col("_cut"))
    return past.select("variety", "bar", "feature", F.when(F.col("z") > 0, "up").otherwise("down").alias("direction"), "size")


def trigger_key() -> Column:
    return F.concat_ws("|", F.col("variety").cast("string"), "feature", "direction")


def market_pattern(df: DataFrame, steep: float = 2.0, rich: float = 2.0, shock: float = 0.5) -> DataFrame:
    """Add ``pattern``: the first rule that holds."""
    label = (
        F.when(F.col("z_skew") > steep, "skew_steep")
        .when(F.round("term_slope", 9) < 0, "term_inverted")
        .when(F.col("z_curvature") > rich, "wing_rich")
        .when(F.round(F.abs("signed_flow"), 9) > shock, "flow_shock")
        .otherwise("calm")
    )
    return df.withColumn("pattern", label)


def macro_state(macro: DataFrame, back: int = 5) -> DataFrame:
    """Add ``macro_high``: above the mean of the previous ``back`` values. One row per date and series."""
    w = Window.partitionBy("_series").orderBy("obs_date").rowsBetween(-back, -1)
    high = F.round(F.col("macro_index") - F.avg("macro_index").over(w), 6) > 0
    return macro.withColumn("_series", F.lit("macro_index")).withColumn("macro_high", F.coalesce(high, F.lit(False))).drop("_series")


def macro_asof(df: DataFrame, macro: DataFrame, ts: str = "bar") -> DataFrame:
    """Add the last macro observation dated before the day of ``ts``; an equal date is not before."""
    dated = df.withColumn("_day", F.to_date(ts))
    return asof_join(dated, macro, "_day", "obs_date", [], strict=True).drop("_day")


def conclude(df: DataFrame) -> DataFrame:
    """Add ``conclusion`` from level and macro state; expects ``level`` and ``macro_high``."""
    label = (
        F.when(F.col("level") == 3, "tail_risk")
        .when((F.col("level") == 2) & F.coalesce("macro_high", F.lit(False)), "vol_up")
        .when(F.col("level") >= 1, "watch")
        .otherwise("none")
    )
    return df.withColumn("conclusion", label)


def explain(warnings: DataFrame, macro: DataFrame) -> DataFrame:
    """Warnings with pattern, macro observation and conclusion."""
    return conclude(macro_asof(market_pattern(warnings), macro_state(macro)))


def kg_nodes(explained: DataFrame, triggers: DataFrame, analogues: DataFrame) -> DataFrame:
    """Distinct typed nodes of the warnings and the five layers."""

    def nodes(df: DataFrame, kind: str, key: Column) -> DataFrame:
        named = df.select(key.alias("key")).where(F.col("key").isNotNull()).distinct()
        return named.select(node_id(kind, F.col("key")).alias("id"), F.lit(kind).alias("type"), "key")

    parts = [
        nodes(explained, WARNING, moment_key()),
        nodes(triggers, TRIGGER, trigger_key()),
        nodes(explained, PATTERN, F.col("pattern")),
        nodes(analogues, ANALOGUE, moment_key("variety", "match_bar")),
        nodes(explained, MACRO, F.col("obs_date").cast("string")),
        nodes(explained, CONCLUSION, F.col("conclusion")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kg_edges(explained: DataFrame, triggers: DataFrame, analogues: DataFrame) -> DataFrame:
    """All edges from layer to layer, deduplicated; ``weight`` counts the warnings behind an edge.

    Equal edges combine on the map side, so the few pattern and conclusion nodes that
    most warnings share do not gather their edges in one task.
    """

    def edges(df: DataFrame, relation: str, src: Column, dst: Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))

    warning = node_id(WARNING, moment_key())
    trigger = node_id(TRIGGER, trigger_key())
    pattern = node_id(PATTERN, F.col("pattern"))
    led = triggers.join(explained.select("variety", "bar", "pattern"), ["variety", "bar"])
    parts = [
        edges(triggers, "triggered_by", warning, trigger),
        edges(led, "shapes", trigger, pattern),
        edges(analogues, "resembles", warning, node_id(ANALOGUE, moment_key("variety", "match_bar"))),
        edges(
            explained.where(F.col("obs_date").isNotNull()), "under_macro", warning, node_id(MACRO, F.col("obs_date").cast("string"))
        ),
        edges(explained, "concludes", pattern, node_id(CONCLUSION, F.col("conclusion"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("weight"))


def attribution_path(explained: DataFrame, triggers: DataFrame, analogues: DataFrame) -> DataFrame:
    """One row per warning with its layers as an ordered array of (layer, kind, item).

    A warning has at most one item per feature, k analogues and one of each other layer.
    """

    def items(df: DataFrame, kind: str, item: Column) -> DataFrame:
        step = F.struct(F.lit(LAYERS.index(kind) + 1).alias("layer"), F.lit(kind).alias("kind"), item.alias("item"))
        return df.where(item.isNotNull()).select("variety", "bar", step.alias("step"))

    steps = (
        items(triggers, TRIGGER, F.concat_ws(" ", "feature", "direction"))
        .unionByName(items(explained, PATTERN, F.col("pattern")))
        .unionByName(items(analogues, ANALOGUE, F.col("match_bar").cast("string")))
        .unionByName(items(explained, MACRO, F.col("obs_date").cast("string")))
        .unionByName(items(explained, CONCLUSION, F.col("conclusion")))
    )
    return steps.groupBy("variety", "bar").agg(F.sort_array(F.collect_list("step")).alias("path"))


def trace(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes reachable from ``seeds`` (column ``id``) along at most ``depth`` edges, with the fewest hops.

    Every hop is written before the next one starts, so hops are not computed again.
    """
    reached = stage(seeds.select("id").distinct().withColumn("hops", F.lit(0)), "trace-0")
    frontier = reached
    steps = edges.select(F.col("src").alias("id"), "dst")
    for hop in range(1, depth + 1):
        found = frontier.join(steps, "id").select(F.col("dst").alias("id")).distinct()
        frontier = stage(found.join(reached, "id", "left_anti").withColumn("hops", F.lit(hop)), f"trace-{hop}")
        reached = reached.unionByName(frontier)
    return reached


def trace_routes(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """``trace`` with the way to each node: ``route`` lists (relation, id) from the seed, whose relation is null, to the node.

    A breadth-first search that carries predecessors: of the edges by which a node is first
    reached, the one from the smallest id, then of the smallest relation, is kept. Routes
    have at most ``depth`` + 1 steps, and a node with very many edges is combined before it moves.
    """
    step = lambda relation, node: F.array(F.struct(relation.cast("string").alias("relation"), F.col(node).alias("id")))
    frontier = reached = stage(seeds.select("id").distinct().select("id", F.lit(0).alias("hops"), step(F.lit(None), "id").alias("route")), "route-0")
    onward = edges.select(F.col("src").alias("id"), "dst", "relation")
    for hop in range(1, depth + 1):
        met = frontier.join(onward, "id").groupBy("dst").agg(F.min(F.struct("id", "relation", "route")).alias("_by"))
        fresh = met.join(reached.select(F.col("id").alias("dst")), "dst", "left_anti")
        route = F.concat("_by.route", step(F.col("_by.relation"), "dst")).alias("route")
        frontier = stage(fresh.select(F.col("dst").alias("id"), F.lit(hop).alias("hops"), route), f"route-{hop}")
        reached = reached.unionByName(frontier)
    return reached


def kg_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by type and edges by relation with totals, and the mean and largest degree per node type."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    degrees = ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    per_node = nodes.join(degrees, "id", "left").na.fill(0, ["n_out", "n_in"])
    of_nodes = per_node.rollup("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(None).cast("bigint").alias("total_weight"),
        F.avg(F.col("n_out") + F.col("n_in")).alias("mean_degree"),
        F.max("n_out").alias("max_out"),
        F.max("n_in").alias("max_in"),
    )
    of_edges = edges.rollup(F.col("relation").alias("type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("weight").alias("total_weight"),
        F.lit(None).cast("double").alias("mean_degree"),
        F.lit(None).cast("bigint").alias("max_out"),
        F.lit(None).cast("bigint").alias("max_in"),
    )
    tag = lambda df, part: df.select(F.lit(part).alias("part"), F.coalesce("type", F.lit("(all)")).alias("type"), *df.columns[1:])
    return tag(of_nodes, "node").unionByName(tag(of_edges, "edge"))


def kg_audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Problems of a graph: edges with a missing endpoint, and nodes without any edge.

    Endpoints become distinct before they meet the nodes, so a node on which very many
    edges end is looked up once.
    """
    known = nodes.select("id")
    ends = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).select(F.col("src").alias("id")).distinct()
    missing = ends.join(known, "id", "left_anti")
    bad = lambda end, problem: (
        edges.join(missing.withColumnRenamed("id", end), end, "left_semi").select(F.lit(problem).alias("problem"), "src", "dst")
    )
    lonely = known.join(ends, "id", "left_anti").select(
        F.lit("node_without_edge").alias("problem"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")
    )
    return bad("src", "missing_source").unionByName(bad("dst", "missing_target")).unionByName(lonely)


def stratified_sample(df: DataFrame, strata: list[str], k: int, id_key: Column) -> DataFrame:
    """``k`` rows per stratum, chosen by the hash of an id: the same rows on every run.

    The rank limit also applies before the shuffle, so a large stratum sends k rows per partition.
    """
    w = Window.partitionBy(*strata).orderBy("_hash", "_id")
    ranked = df.withColumn("_id", id_key).withColumn("_hash", F.md5("_id")).withColumn("sample_no", F.row_number().over(w))
    return ranked.where(F.col("sample_no") <= k).drop("_id", "_hash")
