"""Text quality by Bradley-Terry ranking.

Every whole text gets ``FEATURES`` (shares of kinds of characters, repetition, lengths);
each is cut at its quantiles over all labelled texts into bins, so a text is a 0/1 vector. From pairs of a
preferred text (label 1) and another (label 0), in which every labelled text occurs, Newton steps on the logistic loss of
the vectors' differences learn one weight per bin: the probability that one text is
preferred to another depends on the difference of their strengths alone. The threshold is
the strength quantile at the share of label 0 among all labels; the score is a
logistic curve through 0.5 there.

Null text counts as empty; an empty text has every feature 0 and is scored like any other.
With labels of one kind only, or none, every score is that kind's (or 0.5). Rows are
scored one by one, so ties and repeated rows do not matter; other columns pass through,
and result columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailward.functions.quantile import range_counts, ranged_quantiles, weighted_quantiles
from tailward.session import stage

from .columns import add_columns
from .flat import flat, row_sums, slices

FEATURES = """upper_share digit_share space_share bang_share pipe_share symbol_share stop_share comma_share line_share foreign_share
word_length distinct_words repeated_next distinct_lines longest_word log_words log_bytes symbol_words capital_words
""".split()
FEATURE_COLUMN = "quality_features"
_KINDS = {
    "upper_share": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit_share": b"0123456789",
    "space_share": b" \t",
    "bang_share": b"!?",
    "pipe_share": b"|",
    "symbol_share": b"#$%&*+<=>@^~",
    "stop_share": b".",
    "comma_share": b",;:",
    "line_share": b"\n\r",
    "foreign_share": bytes(range(128, 256)),
}
_LOOKUP = np.zeros((len(_KINDS), 256), bool)
for _k, _chars in enumerate(_KINDS.values()):
    _LOOKUP[_k, list(_chars)] = True
_MARKS = tuple("!|#$%&*")


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, at = flat(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    shares = len(_KINDS)
    for first, last in slices(at):
        part, edges = data[at[first] : at[last]], at[first : last + 1] - at[first]
        size = np.maximum(np.diff(edges), 1)
        for k in range(shares):
            out[first:last, k] = row_sums(_LOOKUP[k][part], edges[:-1], edges[1:]) / size
        for row in range(first, last):
            text = bytes(data[at[row] : at[row + 1]]).decode("utf-8", "replace")
            words = text.split()
            if not words:
                continue
            lines = text.split("\n")
            n = len(words)
            out[row, shares:] = (
                sum(map(len, words)) / n,
                len(set(words)) / n,
                sum(map(str.__eq__, words, words[1:])) / n,
                len(set(lines)) / len(lines),
                min(max(map(len, words)), 100),
                np.log1p(n),
                np.log1p(len(text)),
                sum(w.endswith(_MARKS) for w in words) / n,
                sum(map(str.isupper, words)) / n,
            )
    return out


@dataclass(frozen=True)
class QualityModel:
    cuts: list[np.ndarray]  # of each feature
    strength: list[np.ndarray]  # of each feature's bins
    threshold: float
    slope: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return sum(s[np.searchsorted(c, x[:, k], "right")] for k, (c, s) in enumerate(zip(self.cuts, self.strength, strict=True)))


def train_pairs(pairs: DataFrame, starts: np.ndarray, penalty: float = 1e-3, rounds: int = 15) -> np.ndarray:
    """Weights that make ``better`` beat ``worse`` in all pairs: Newton steps on the mean logistic loss.

    Tasks add up the gradient and the Hessian of their pairs; the driver gets their sums, whose
    size is set by the bins.
    """
    size = int(starts[-1])
    weights = np.zeros(size)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            gradient, curve, n = np.zeros(size), np.zeros((size, size)), 0
            for batch in batches:
                for first in range(0, batch.num_rows, 4096):
                    part = batch.slice(first, 4096)
                    difference = _bits(part.column(0), starts) - _bits(part.column(1), starts)
                    lost = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
                    gradient += difference.T @ lost
                    curve += difference.T @ (difference * (lost * (1 - lost)).astype(np.float32)[:, None])
                    n += len(difference)
            flat_sums = np.concatenate([[n], gradient, curve.ravel()])
            at = np.flatnonzero(flat_sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat_sums[at])], ["at", "s"])

        got = pairs.select("better", "worse").mapInArrow(sums, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
        total = np.zeros(1 + size + size * size)
        total[got["at"].to_numpy()] = got["s"].to_numpy()
        slope, curve = total[1 : size + 1] / total[0] - penalty * weights, total[size + 1 :].reshape(size, size) / total[0]
        step = np.linalg.solve(curve + penalty * np.eye(size), slope)
        weights = weights + step
        if np.abs(step).max() < 1e-3:
            break
    return weights


def _bits(bins: pa.Array, starts: np.ndarray) -> np.ndarray:
    """0/1 vectors of rows of bins."""
    rows = np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(len(bins), len(FEATURES))
    out = np.zeros((len(bins), starts[-1]), np.float32)
    out[np.arange(len(bins))[:, None], rows + starts[:-1]] = 1
    return out


def _numbered(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """Rows of each label numbered from 0 in the order of their keys' hashes: within hash buckets, and from each bucket's first number on."""
    dealt = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    earlier = Window.partitionBy("y").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("y", "_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("y", "_bucket").orderBy("_hash", "k", "bins"))
    return dealt.withColumn("_inside", inside).join(sizes.drop("_n"), ["y", "_bucket"]).select("y", "bins", (F.col("_first") + F.col("_inside") - 1).alias("number"))


def draw_pairs(rows: DataFrame, n_better: int, n_worse: int, each: int) -> DataFrame:
    """(better, worse): every row of the more frequent label with ``each`` of the other, which take turns, so every row of either is in a pair."""
    many, few = (1, 0) if n_better >= n_worse else (0, 1)
    n_few = min(n_better, n_worse)
    numbered = stage(_numbered(rows), "numbered-labels")
    turns = F.explode(F.array(*[F.lit(t * (n_few // each + 1)) for t in range(each)])).alias("_turn")
    asking = numbered.where(F.col("y") == many).select("bins", "number", turns).select(F.col("bins").alias("_many"), F.pmod(F.col("number") + F.col("_turn"), F.lit(n_few)).alias("number"))
    asked = numbered.where(F.col("y") == few).select(F.col("bins").alias("_few"), "number")
    better, worse = ("_many", "_few") if many else ("_few", "_many")
    return asking.join(asked, "number").select(F.col(better).alias("better"), F.col(worse).alias("worse"))


def _cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Cuts of each feature at exact quantiles of all rows, and of those above 0."""
    counts = rows.select(F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranged = range_counts(counts, ["feature"], "value", "n")
    deciles = [float(q) for q in np.linspace(0, 1, bins + 1)[1:-1]]
    found = ranged_quantiles(ranged, ["feature"], "value", "n", deciles).unionByName(ranged_quantiles(ranged.where("value > 0"), ["feature"], "value", "n", [0.25, 0.5, 0.75]))
    at: list[list[float]] = [[] for _ in FEATURES]
    for r in found.select("feature", "quantile").collect():
        at[r["feature"]].append(r["quantile"])
    # 0 and anything above it are kinds of their own: most texts have no symbol of a kind at all
    return [np.unique([*c, np.nextafter(0, 1)]) for c in at]


def _features():
    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(list(text_features(texts)), pa.list_(pa.float64()))

    return features


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Features in the place of texts, so that a join with labels moves no text."""
    return docs.withColumn(FEATURE_COLUMN, _features()(F.col(text).cast("string"))).drop(text)


def fit_quality(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", each: int = 5, bins: int = 10) -> QualityModel:
    """Fit on all rows labelled 1 or 0, and ``each`` pairs of each row of the more frequent label.

    The cuts, the pairs, the sums of every Newton step, the threshold and the slope come from
    all these rows; the driver gets quantiles and sums alone. ``labelled`` may hold features
    (``with_features``) in the place of texts.
    """

    x = F.col(FEATURE_COLUMN) if FEATURE_COLUMN in labelled.columns else _features()(F.col(text).cast("string"))
    kept = labelled.where(F.col(label).cast("int").isin(0, 1))
    rows = stage(kept.select(F.col(label).cast("int").alias("y"), F.col(key).cast("string").alias("k"), x.alias("x")), "labelled-features")
    n_better, n = rows.agg(F.count_if(F.col("y") == 1), F.count("*")).first()
    if n_better in (0, n):
        constant = 0.0 if not n else (10.0 if n_better else -10.0)
        return QualityModel([np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), -constant, 1.0)
    cuts = _cuts(rows, bins)
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])

    @F.arrow_udf("binary")
    def binned(x: pa.Array) -> pa.Array:
        values = x.flatten().to_numpy().reshape(len(x), len(cuts))
        found = np.stack([np.searchsorted(c, values[:, k], "right") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)
        return pa.array([r.tobytes() for r in found], pa.binary())

    vectors = stage(rows.select("y", "k", F.xxhash64("k").alias("_hash"), binned("x").alias("bins")), "labelled-bins")
    weights = train_pairs(stage(draw_pairs(vectors, n_better, n - n_better, each), "quality-pairs"), starts)

    @F.arrow_udf("double")
    def worth(bins: pa.Array) -> pa.Array:
        return pa.array(_bits(bins, starts) @ weights)

    values = vectors.select("y", F.round(worth("bins"), 9).alias("value")).groupBy("y", "value").agg(F.count("*").alias("n"))
    values = stage(values.withColumn("of", F.lit(0)), "quality-strengths")
    threshold = weighted_quantiles(values.groupBy("of", "value").agg(F.sum("n").alias("n")), ["of"], "value", "n", [(n - n_better) / n]).first()["quantile"]
    sign = F.col("y") * 2 - 1
    slopes = [float(a) for a in np.geomspace(0.1, 10, 40)]
    margins = [F.least(F.greatest((F.col("value") - threshold) * sign * a, F.lit(-30.0)), F.lit(30.0)) for a in slopes]
    losses = values.agg(*[F.sum(F.col("n") * F.log1p(F.exp(-m))).alias(f"_{k}") for k, m in enumerate(margins)]).first()
    strength = [weights[starts[k] : starts[k + 1]] for k in range(len(cuts))]
    return QualityModel(cuts, strength, float(threshold), slopes[int(np.argmin(losses))])


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Add ``quality_strength`` and ``quality_score`` (0 to 1, 0.5 at the threshold)."""
    names = ["quality_strength", "quality_score"]

    @F.arrow_udf("quality_strength double, quality_score double")
    def score(texts: pa.Array) -> pa.Array:
        strength = model.strengths(text_features(texts)) if len(texts) else np.zeros(0)
        likely = 1 / (1 + np.exp(-np.clip(model.slope * (strength - model.threshold), -30, 30)))
        return pa.StructArray.from_arrays([pa.array(strength, pa.float64()), pa.array(likely, pa.float64())], names)

    return add_columns(docs, score(F.col(text).cast("string")), names)
