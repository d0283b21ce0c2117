"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte bigrams and trigrams of the lower-cased text, white space as one
symbol, hashed into ``BUCKETS`` cells. A text is the average of its subwords' embeddings;
a linear layer and softmax over the languages follow. Both layers are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows; a temperature
and a rejection bound are fitted on a part held back from it.

Because average and layer are linear, a trained model is one vector of language scores
per bucket: scoring reads each byte of the whole text once.

Null or empty text, and text without a letter, is ``und`` with score 0. Without labelled
rows every text is ``und``. Rows are scored one by one, so ties and repeated rows do not
matter; other columns pass through, and result columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import add_columns
from .flat import flat, row_sums, slices

BUCKETS = 4096
SCALE = 1024  # keeps small shares within half precision
UNKNOWN = "und"
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: score of one subword
    bias: np.ndarray
    temperature: float
    reject_below: float


def _subwords(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket at each byte, and whether a subword of the row begins there, for each subword length."""
    wide = data.astype(np.uint32)
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(data))
    two = wide[:-1] * np.uint32(0x9E3779B1) + wide[1:] * np.uint32(0x85EBCA77)
    yield (two >> np.uint32(20)).astype(np.int32), left[:-1] >= 2
    three = two[:-1] + wide[2:] * np.uint32(0xC2B2AE3D)
    yield ((three ^ (three >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int32), left[:-2] >= 3


def _each(texts: pa.Array, most: int = 1 << 16):
    """Row range, bytes and row ends of each slice of a lower-cased text column."""
    data, at = flat(pc.utf8_lower(texts))
    for first, last in slices(at, most=most):
        yield first, last, _SPACE[data[at[first] : at[last]]], at[first + 1 : last + 1] - at[first]


def subword_shares(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each row the share of each bucket among its subwords, some rows at a time."""
    for first, last, data, ends in _each(texts, most=128):
        out = np.zeros((last - first, BUCKETS), np.float32)
        rows = np.repeat(np.arange(last - first), np.diff(np.concatenate([[0], ends])))
        for bucket, valid in _subwords(data, ends):
            key = rows[: len(bucket)][valid].astype(np.int64) * BUCKETS + bucket[valid]
            out += np.bincount(key, minlength=out.size).reshape(out.shape)
        yield out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def _logits(texts: pa.Array, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(bias)))
    columns = [np.ascontiguousarray(c) for c in table.T]
    for first, last, data, ends in _each(texts):
        starts = np.concatenate([[0], ends[:-1]])
        count = np.zeros(last - first)
        for bucket, valid in _subwords(data, ends):
            s, e = np.minimum(starts, len(bucket)), np.minimum(ends, len(bucket))
            count += row_sums(valid, s, e)
            for k, column in enumerate(columns):
                out[first:last, k] += row_sums(column[bucket] * valid, s, e)
        out[first:last] /= np.maximum(count, 1)[:, None]
    return out + bias


def train(x: np.ndarray, y: np.ndarray, classes: int, dim: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7):
    """Embeddings and softmax layer by minibatch gradient descent with per-weight rates; returns their product and the bias."""
    rng = np.random.default_rng(seed)
    embed, layer, bias = rng.normal(0, 1, (x.shape[1], dim)).astype(np.float32), np.zeros((dim, classes), np.float32), np.zeros(classes, np.float32)
    seen = [np.full_like(w, 1e-8) for w in (embed, layer, bias)]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 64):
            part = order[k : k + 64]
            hidden = x[part] @ embed
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            for w, g, s in zip((embed, layer, bias), (x[part].T @ (p @ layer.T), hidden.T @ p, p.sum(axis=0)), seen, strict=True):
                s += g * g
                w -= rate * g / np.sqrt(s)
    return embed @ layer, bias


def _calibrate(z: np.ndarray, y: np.ndarray, reject_share: float) -> tuple[float, float]:
    """Temperature of least loss, and the score below which ``reject_share`` of the right answers fall."""

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    rows = np.arange(len(y))
    grid = np.geomspace(0.05, 20, 60)
    best = min(grid, key=lambda t: -np.log(np.maximum(probabilities(t)[rows, y], 1e-12)).mean())
    p = probabilities(best)
    right = p[rows, y][p.argmax(axis=1) == y]
    return float(best), float(np.quantile(right, reject_share)) if len(right) else 0.0


def fit_language(
    labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = 1000, reject_share: float = 0.005
) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each language, those whose key hashes lowest.

    The driver receives one vector of ``BUCKETS`` shares per sampled row; every fifth
    calibrates the model.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    order = Window.partitionBy("_label").orderBy("_hash", "_key")
    chosen = (
        rows.select(F.col(label).alias("_label"), F.col(key).alias("_key"), F.xxhash64(F.col(key)).alias("_hash"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= per_language)
        .select("_key")
        .distinct()
    )

    @F.arrow_udf("binary")
    def shares(texts: pa.Array) -> pa.Array:
        return pa.array([(row * SCALE).astype(np.float16).tobytes() for part in subword_shares(texts) for row in part], pa.binary())

    sample = (
        rows.join(F.broadcast(chosen), F.col(key) == F.col("_key"), "left_semi")
        .select(F.col(label).cast("string").alias("y"), F.col(key).cast("string").alias("k"), shares(F.col(text)).alias("x"))
        .toArrow()
        .sort_by([("k", "ascending"), ("y", "ascending")])
    )
    languages = sorted(pc.unique(sample["y"]).to_pylist())
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    x = np.stack([np.frombuffer(b, np.float16) for b in sample["x"].to_pylist()]).astype(np.float32)
    y = np.searchsorted(np.array(languages), np.array(sample["y"].to_pylist()))
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    table, bias = train(x[~held], y[~held], len(languages))
    probe = held if held.any() else ~held
    temperature, bound = _calibrate(x[probe] @ table + bias, y[probe], reject_share)
    return LanguageModel(languages, table * SCALE, bias, temperature, bound)


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` (calibrated probability) and ``lang_accepted`` (score not below the rejection bound)."""

    @F.arrow_udf("lang_pred string, lang_score double, lang_accepted boolean")
    def predict(texts: pa.Array) -> pa.Array:
        lettered = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
        if model.languages:
            z = _logits(texts, model.table, model.bias) / model.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best, score = np.array(model.languages, object)[p.argmax(axis=1)], np.where(lettered, p.max(axis=1), 0.0)
        else:
            best, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        names = pa.array(np.where(lettered, best, UNKNOWN), pa.string())
        accepted = lettered & (score >= model.reject_below) & bool(model.languages)
        return pa.StructArray.from_arrays([names, pa.array(score, pa.float64()), pa.array(accepted)], ["lang_pred", "lang_score", "lang_accepted"])

    return add_columns(docs, predict(F.col(text).cast("string")), ["lang_pred", "lang_score", "lang_accepted"])
