"""The tables of one run, each built from the ones before it.

A product that several later steps read is staged: written once and read back,
the way a batch run leaves its products on disk.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailward.operators import adaptive, events, features, graph, greeks, sessions, tailrisk, warnings
from tailward.operators.bars import to_bars
from tailward.operators.neighbours import similar_history
from tailward.session import stage
from tailward.sources import fixture

SPLIT = "2024-01-22 00:00:00"  # of the derived inputs: cuts, model and thresholds see only bars before it
SOURCES = ["named", "market"]


Z_SCORES = [f"z_{c}" for c in features.FEATURES]


class Products:
    """``quotes``, ``exo`` and ``macro`` follow ``tailward.schemas``; ``split`` ends the training period."""

    def __init__(self, quotes: DataFrame, exo: DataFrame, macro: DataFrame, split: str, sf_dir: str = ""):
        self.spark, self.quotes, self.exo, self.macro, self.split = quotes.sparkSession, quotes, exo, macro, split
        self.sf_dir = sf_dir  # of the derived inputs

    @classmethod
    def of_fixture(cls, spark: SparkSession, sf_dir: str) -> Products:
        return cls(fixture.quotes(spark, sf_dir), fixture.exo_events(spark, sf_dir), fixture.macro(spark, sf_dir), SPLIT, sf_dir)

    @classmethod
    def of_uneven_fixture(cls, spark: SparkSession, sf_dir: str) -> Products:
        """Quotes with irregular tenors, bent smiles, gaps, zero strikes and unknown volatilities."""
        return cls(fixture.uneven_quotes(spark, sf_dir), fixture.exo_events(spark, sf_dir), fixture.macro(spark, sf_dir), SPLIT, sf_dir)

    def training(self, df: DataFrame, ts: str = "bar") -> DataFrame:
        return df.where(F.col(ts) < F.lit(self.split).cast("timestamp_ntz"))

    def later(self, df: DataFrame, ts: str = "bar") -> DataFrame:
        return df.where(F.col(ts) >= F.lit(self.split).cast("timestamp_ntz"))

    @cached_property
    def bars(self) -> DataFrame:
        return to_bars(self.quotes, "variety", "ts", "fwd", "volume", "quote_id")

    @cached_property
    def calendar(self) -> DataFrame:
        """Open bars of the days with quotes."""
        days = self.quotes.select("variety", F.to_date("ts").alias("day")).distinct()
        return sessions.open_bars(sessions.weekly_sessions(days, fixture.week(self.spark)))

    @cached_property
    def features(self) -> DataFrame:
        return features.build_features(self.quotes)

    @cached_property
    def greeks(self) -> DataFrame:
        return greeks.build_greeks(self.quotes)

    @cached_property
    def scored(self) -> DataFrame:
        """Features with z-scores: the input of everything from the warnings on."""
        return stage(features.rolling_zscore(self.features, features.FEATURES), "scored")

    @cached_property
    def cuts(self) -> DataFrame:
        return stage(warnings.calibrate(self.training(self.scored), features.FEATURES), "cuts")

    @cached_property
    def raw_levels(self) -> DataFrame:
        """Levels before debouncing, in ``level`` and ``raw_level``."""
        raw = warnings.score_levels(self.scored, self.cuts, features.FEATURES)
        return raw.withColumn("raw_level", F.col("level"))

    @cached_property
    def levels(self) -> DataFrame:
        """Debounced levels, on which all that follows rests, with the features they rest on and the raw level."""
        return stage(warnings.debounce(self.raw_levels), "levels")

    @cached_property
    def episodes(self) -> DataFrame:
        return warnings.episodes(self.levels)

    @cached_property
    def fused(self) -> DataFrame:
        return events.fuse_events(self.exo)

    @cached_property
    def fused_tracks(self) -> DataFrame:
        return events.fuse_events(warnings.for_both_tracks(self.exo))

    @cached_property
    def labelled(self) -> DataFrame:
        """Scored bars with the label and a rule score in (0, 1) from their largest move."""
        sizes = [F.coalesce(warnings.strength(c), F.lit(0.0)) for c in features.FEATURES]
        scored = self.scored.withColumn("_top", F.greatest(*sizes)).withColumn("score", F.round(F.col("_top") / (F.col("_top") + 1), 6))
        return stage(events.label_bars(scored.drop("_top"), self.exo), "labelled")

    @cached_property
    def model(self) -> PipelineModel:
        return adaptive.bc_fit(self.training(self.labelled), Z_SCORES)

    @cached_property
    def model_scored(self) -> DataFrame:
        return stage(adaptive.bc_score(self.model, self.labelled.drop("score")).select("variety", "bar", "score", "label"), "model-scored")

    @cached_property
    def model_taus(self) -> DataFrame:
        return stage(adaptive.tau_star(adaptive.tau_sweep(self.training(self.model_scored))), "model-taus")

    @cached_property
    def adaptive_alerts(self) -> DataFrame:
        """Alerts of the scored period: the model's threshold from the training period, confirmed by the rules."""
        return adaptive.double_confirm(self.later(self.model_scored), self.levels, self.model_taus)

    @cached_property
    def daily(self) -> DataFrame:
        """Written, as every risk table starts from it."""
        return stage(self._daily, "daily")

    @cached_property
    def _daily(self) -> DataFrame:
        return tailrisk.log_returns(tailrisk.daily_closes(self.quotes), ts="day")

    @cached_property
    def exposed(self) -> DataFrame:
        return tailrisk.de_expose(self.daily, tailrisk.alert_days(self.levels))

    @cached_property
    def warned(self) -> DataFrame:
        """Bars at level 1 or above: what the graph explains."""
        return stage(self.levels.where(F.col("level") >= 1), "warned")

    @cached_property
    def triggers(self) -> DataFrame:
        return graph.trigger_edges(self.warned, self.cuts, features.FEATURES)

    @cached_property
    def analogues(self) -> DataFrame:
        return similar_history(self.warned, Z_SCORES)

    @cached_property
    def explained(self) -> DataFrame:
        return graph.explain(self.warned, self.macro)

    @cached_property
    def layers(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return stage(self.explained, "explained"), stage(self.triggers, "triggers"), stage(self.analogues, "analogues")

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.kg_nodes(*self.layers)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.kg_edges(*self.layers)

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as written tables."""
        return stage(self.nodes, "nodes"), stage(self.edges, "edges")
