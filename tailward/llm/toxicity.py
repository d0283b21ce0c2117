"""Toxicity of text whose words may be disguised: noisy-channel decoding, then a word model.

A word may be written with look-alike signs, repeated letters, or its letters set apart.
Each such spelling is a lattice: every character stands for itself, for a look-alike
letter, for a repetition of the letter before or for a mere separator, each at a cost. A
Viterbi search over the whole spelling, however long, finds the cheapest letters under a
character trigram model of the corpus.
The trigrams are counted over all texts. A plainly written word is a lattice with one
path and stands for itself.

The restored words are then scored: words that occur far more in texts labelled toxic are
chosen by their likelihood ratio, and a logistic model over their presence gives the
probability. Labels are read from a bounded sample; texts are read whole.

Null or empty text has no words: its score is the model's base rate. Without labels the
score is 0. Rows are scored one by one, so ties and repeated rows do not matter; other
columns pass through, and result columns replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import add_columns
from .flat import flat, slices

# Letters that a sign is commonly put for.
LOOK_ALIKES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "bg",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
}
SEPARATORS = " .-_*~'`,/\\"
SUBSTITUTE, REPEAT, DROP = 1.0, 0.5, 0.7  # costs in natural-log units
LOSE, SPLIT = 12.0, 6.0  # of a sign that is no separator, to leave it out or to end the word there

_SIGNS = re.escape("".join(LOOK_ALIKES))
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—"
_PLAIN = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
# A look-alike sign or separator between letters, or before one, within a word.
_MIXED = re.compile(rf"[\w{_SIGNS}]*?(?:[^\W\d_][{_SIGNS}*.\-_~'`/\\]{{1,3}}(?=[^\W\d_])|[{_SIGNS}](?=[^\W\d_]))[\w{_SIGNS}*.\-~'`/\\]*[^\W_]")
# At least three single letters or signs set apart by one separator each.
_APART = re.compile(rf"(?<![\w{_SIGNS}])[^\W_](?:[ .\-_*~/][\w{_SIGNS}]){{2,}}(?!\w)")

SYMBOLS = 32
_CODE = np.full(256, 28, np.uint8)
_CODE[: 128] = 0
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)


def _code(letter: str) -> int:
    return int(_CODE[ord(letter)]) if ord(letter) < 128 else 28


def count_trigrams(texts: pa.Array) -> np.ndarray:
    """Counts of letter trigrams in the lower-cased texts; other characters are a boundary."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    data, at = flat(pc.utf8_lower(texts))
    for first, last in slices(at):
        part = np.concatenate([[0, 0], _CODE[data[at[first] : at[last]]], [0]]).astype(np.int32)
        counts += np.bincount(part[:-2] * SYMBOLS**2 + part[1:-1] * SYMBOLS + part[2:], minlength=SYMBOLS**3)
    return counts


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log probability of a letter after two, interpolated with that after one."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    two = three.sum(axis=0)
    one = (two.sum(axis=0) + 1) / (two.sum() + SYMBOLS)
    two = (two + 10 * one) / (two.sum(axis=1, keepdims=True) + 10)
    return -np.log((three + 10 * two[None]) / (three.sum(axis=2, keepdims=True) + 10))


def decode(run: str, costs: np.ndarray) -> str:
    """The cheapest letters for a disguised run; a separator kept as a boundary shows as a space."""
    # state: last two symbols and the last letter (a repetition must equal it) -> (cost, letters so far: all but the last, the last)
    states = {(0, 0, ""): (0.0, None)}
    for k, sign in enumerate(run):
        options = [(sign, 0.0)] if sign.isalpha() else [(x, SUBSTITUTE) for x in LOOK_ALIKES.get(sign, "")]
        repeated = any(run[j : j + 3] == sign * 3 for j in (k - 2, k - 1, k) if j >= 0)
        dropped = DROP if sign in SEPARATORS else LOSE
        after: dict = {}

        def offer(key, cost, path, after=after):
            if key not in after or cost < after[key][0]:
                after[key] = (cost, path)

        for (a, b, letter), (cost, path) in states.items():
            for x, price in options:
                c = _code(x)
                offer((b, c, x), cost + price + costs[a, b, c], (path, x))
                if repeated and x == letter:
                    offer((a, b, letter), cost + price + REPEAT, path)
            if not sign.isalpha():
                offer((a, b, letter), cost + dropped, path)
                if sign in SEPARATORS or sign.isdigit():
                    offer((b, 0, ""), cost + costs[a, b, 0] + (SPLIT if sign.isdigit() else 0), (path, " "))
        states = after
    ends = [(cost + costs[a, b, 0], path) for (a, b, _), (cost, path) in states.items()]
    if not ends:
        return run
    least = min(cost for cost, _ in ends)
    return min(_spelt(path) for cost, path in ends if cost == least)


def _spelt(path) -> str:
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


_decoded: dict[str, str] = {}


def restored_words(text: str, costs: np.ndarray) -> set[str]:
    """The distinct words of a whole text as written, and those that its disguised runs decode to."""
    text = text.lower()
    words, runs = set(), {m[0] for m in _APART.finditer(text)}
    for token in set(text.split()):
        if token.isalpha():
            words.add(token)
            continue
        bare = token.strip(_EDGE)
        if bare.isalpha():
            words.add(bare)
        else:
            words.update(_PLAIN.findall(token))
        if token[:1] in LOOK_ALIKES or not bare.isalpha():
            runs.update(m[0] for m in _MIXED.finditer(token))
    if _TRIPLE.search(text):
        runs.update(w for w in words if _TRIPLE.search(w))
    for run in runs:
        if run not in _decoded:
            if len(_decoded) > 50_000:
                _decoded.clear()
            _decoded[run] = decode(run, costs)
        words.update(_decoded[run].split())
    return words


@dataclass(frozen=True)
class ToxicityModel:
    costs: np.ndarray
    weights: dict[str, float]
    bias: float


def corpus_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts: one array per task, summed by Spark; the driver gets at most ``SYMBOLS`` cubed numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            total += count_trigrams(batch.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_rows: int = 20_000, max_words: int = 400
) -> ToxicityModel:
    """Letters from all ``docs``; words from at most ``max_rows`` labelled rows, those whose key hashes lowest.

    The driver receives counts of at most ``max_words`` words and, per sampled row, which
    of them it has.
    """
    costs = trigram_costs(corpus_trigrams(docs, text))
    chosen = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "_y").limit(max_rows)

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(restored_words(t or "", costs)) for t in texts.to_pylist()], pa.list_(pa.string()))

    sample = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_key")
    size = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(costs, {}, 30.0 if toxic else -30.0)
    each = sample.select("_y", F.explode(words("_text")).alias("word"))
    counted = each.groupBy("word").agg(F.sum("_y").alias("a"), F.sum(1 - F.col("_y")).alias("b")).where(F.col("a") >= 5)
    a, b = F.col("a"), F.col("b")
    ratio = 2 * (a * F.log((a + 0.5) / toxic / ((a + b + 1) / (toxic + clean))) + b * F.log((b + 0.5) / clean / ((a + b + 1) / (toxic + clean))))
    # only words at least five times as frequent in toxic texts
    telling = counted.where((a + 0.5) / toxic > 5 * (b + 0.5) / clean).orderBy(ratio.desc(), "word").limit(max_words)
    vocabulary = sorted(r["word"] for r in telling.select("word").collect())
    place = {w: k for k, w in enumerate(vocabulary)}

    @F.arrow_udf("array<int>")
    def present(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(place[w] for w in restored_words(t or "", costs) & place.keys()) for t in texts.to_pylist()], pa.list_(pa.int32()))

    rows = sample.select(F.col("_y"), present("_text").alias("has")).groupBy("_y", "has").agg(F.count("*").alias("n")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["_y"], r["has"]))
    weights, bias = _logistic([r["has"] for r in rows], np.array([r["_y"] for r in rows], float), np.array([r["n"] for r in rows], float), len(place))
    return ToxicityModel(costs, dict(zip(vocabulary, map(float, weights), strict=True)), float(bias))


def _logistic(has: list[list[int]], y: np.ndarray, n: np.ndarray, size: int, penalty: float = 0.1, rounds: int = 25):
    """Newton steps for a logistic model over presence; ``n`` rows are alike."""
    x = np.zeros((len(has), size + 1))
    for k, places in enumerate(has):
        x[k, places] = 1
    x[:, size] = 1
    w = np.zeros(size + 1)
    ridge = np.full(size + 1, penalty)
    ridge[size] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:size], w[size]


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``toxic_score`` and ``toxic_words``, the telling words found in the restored text."""
    names = ["toxic_score", "toxic_words"]
    costs, weights, bias = model.costs, model.weights, model.bias

    @F.arrow_udf("toxic_score double, toxic_words array<string>")
    def score(texts: pa.Array) -> pa.Array:
        found = [sorted(restored_words(t.as_py() or "", costs) & weights.keys()) for t in texts]
        z = np.array([bias + sum(weights[w] for w in words) for words in found], float)
        likely = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pa.StructArray.from_arrays([pa.array(likely, pa.float64()), pa.array(found, pa.list_(pa.string()))], names)

    return add_columns(docs, score(F.col(text).cast("string")), names)
