"""The class model against plain Python: the classes of all words, and scores under them."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_data import odd_docs  # noqa: F401
from pyspark.sql import functions as F

from tailward.llm import brown
from tailward.llm.brown import END, SHAPES, SMOOTH, best_classes, exchange_clusters, score_texts


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def plain_shape(word: bytes) -> int:
    last = word[-1:]
    sign = 0 if last.isalnum() or last >= b"\x80" else 1
    other = 0 if word.isascii() else 1
    plain = word.strip(b".,;:!?").isalpha() or other
    return min(len(word) // 4, 3) * 8 + sign * 4 + other * 2 + (0 if plain else 1)


def likelihood(pairs: np.ndarray) -> float:
    def h(x):
        return (x * np.log(np.where(x > 0, x, 1))).sum()

    return h(pairs) - h(pairs.sum(axis=0)) - h(pairs.sum(axis=1))


def plain_model(texts: list[str | None], learned: list[bool], units: int, classes: int) -> tuple[dict[bytes, int], Counter, list[tuple[float, float]]]:
    """Classes of all learned words, their counts, and (score, base_score) of each text."""
    rows = [[*plain_words(t), END] for t in texts]
    pairs = Counter()
    for row, yes in zip(rows, learned, strict=True):
        if yes:
            pairs.update(zip([END, *row[:-1]], row, strict=True))
    counts = Counter()
    for (_, word), n in pairs.items():
        counts[word] += n
    place = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:units])}

    def unit(word):
        return place.get(word, len(place) + plain_shape(word))

    bigrams = np.zeros((len(place) + SHAPES,) * 2, np.int64)
    for (a, b), n in pairs.items():
        bigrams[unit(a), unit(b)] += n
    cls = exchange_clusters(bigrams, classes)
    first = {w: int(cls[unit(w)]) for w in counts}

    def class_pairs(of):
        out = np.zeros((classes, classes))
        for (a, b), n in pairs.items():
            out[of[a], of[b]] += n
        return out

    of = dict(first)
    for word in counts.keys() - place.keys():
        found = [likelihood(class_pairs(first | {word: g})) for g in range(classes)]
        if max(found) > found[first[word]] + 1e-9:
            of[word] = int(np.argmax(found))
    held, kinds = np.zeros(classes), np.zeros(classes)
    for word, n in counts.items():
        held[of[word]] += n
        kinds[of[word]] += 1
    p = class_pairs(of)
    share = (p.sum(axis=0) + 1) / (p.sum() + classes)
    steps = (p + 20 * share) / (p.sum(axis=1, keepdims=True) + 20)
    total, scores = sum(counts.values()), []
    for row in rows:
        c = [of.get(w, int(cls[unit(w)])) for w in [END, *row]]
        score = sum(np.log10(steps[a, b] * (counts[w] + SMOOTH) / (held[b] + SMOOTH * (kinds[b] + 1))) for a, b, w in zip(c, c[1:], row, strict=False))
        base = sum(np.log10((counts[w] + SMOOTH) / (total + SMOOTH * (len(counts) + 1))) for w in row)
        scores.append((float(score), float(base)))
    return of, counts, scores


def grammar(n: int, seed: int = 5) -> list[str | None]:
    """Nouns follow determiners and verbs follow nouns; all look alike, and most are rare."""
    rng = random.Random(seed)
    kinds = [[f"{a}{b}{c}" for b in "aeiou" for c in s] for a, s in (("d", "nt"), ("d", "kmprst"), ("d", "bcfgl"))]

    def word(kind):
        return kind[min(int(rng.expovariate(0.25)), len(kind) - 1)]

    return [" ".join(word(k) for _ in range(rng.randrange(1, 9)) for k in kinds) for _ in range(n)]


@pytest.mark.parametrize("units, known", [(6, 20), (6, 0), (0, 5), (0, 0), (30, 100)])
def test_classes_and_scores_of_all_words_match_plain_python(spark, units, known):
    texts = [*grammar(60), "", None, "dan never Seen, 12 été", "DAN dak\x0bdab\tdan", "rare " * 40]
    ids = [*range(len(texts)), None]
    texts.append("dan dak dab")
    learned = [i is not None and i % 5 != 0 for i in ids]
    of, counts, scores = plain_model(texts, learned, units, 4)
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(ids)), strict=True)), "doc_id bigint, text string, at int").repartition(3)
    rows = sorted(score_texts(docs, F.col("doc_id") % 5 != 0, units=units, classes=4, known=known).collect(), key=lambda r: r["at"])
    assert [r["text"] for r in rows] == texts
    for row, text, (score, base) in zip(rows, texts, scores, strict=True):
        words = [*plain_words(text), END]
        assert (row.score, row.base_score) == (pytest.approx(score), pytest.approx(base))
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), sum(counts.values()))
        assert row.perplexity == pytest.approx(10 ** (-score / len(words)))


def test_rare_words_of_one_shape_find_their_own_classes(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(grammar(300))], "doc_id bigint, text string")
    texts = [r.text for r in docs.collect()]
    of, counts, _ = plain_model(texts, [True] * len(texts), 8, 4)
    rare = sorted(counts, key=lambda w: (-counts[w], w))[8:]
    assert len({plain_shape(w) for w in rare}) == 1 and len({of[w] for w in rare}) > 1
    frequent = pa.array(sorted(counts, key=lambda w: (-counts[w], w))[:8])
    bigrams = brown.count_bigrams(docs, frequent)
    assert {bytes(r.word): r.n for r in brown.count_tokens(docs, most=1).collect()} == counts
    for most in (1 << 20, 1):  # tasks that hand on their counts once, or with each run
        found = brown.class_words(docs, frequent, exchange_clusters(bigrams, 4), bigrams, 4, most=most).collect()
        assert {bytes(r.word): (r.n, r["class"]) for r in found} == {w: (counts[w], of[w]) for w in rare} and len(found) == len(rare)


def test_columns_that_pass(odd_docs):  # noqa: F811
    out = score_texts(odd_docs, F.col("doc_id") > 1, keep=["score", "doc_id"])
    assert out.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in odd_docs.collect())


def test_best_classes_match_brute_force():
    rng = np.random.default_rng(0)
    for mean in (0.05, 0.5, 3.0) * 4:
        bigrams, cls = rng.poisson(mean, (30, 30)), rng.integers(0, 5, 30)
        member, rows = np.eye(5)[cls], np.arange(30)
        to, fro, own = bigrams @ member, bigrams.T @ member, np.diag(bigrams).astype(float)
        to[rows, cls] -= own
        fro[rows, cls] -= own
        for word, got in enumerate(best_classes(member.T @ bigrams @ member, to, fro, own, cls)):
            each = np.array([likelihood(m.T @ bigrams @ m) for m in (np.eye(5)[np.where(rows == word, g, cls)] for g in range(5))])
            assert each[got] >= each.max() - 1e-7


def test_tokens_and_shapes_match_plain_python(monkeypatch):
    rng = random.Random(2)
    parts = ["ab", "C", " ", "\n", "é", "\x1c", "\xa0", "x1", "\t", "\x0b", ".", ",", "!", "-", "[", "`", "9"]
    texts = pa.array([*("".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)), None, "", "  a", "b ", "c"])
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(brown, "RUN_BYTES", size)
        for some in (texts, texts[7:50], texts[:0]):
            rows, n = [], 0
            for first, last, sizes, codes, words in brown.tokens(some):
                assert first == n and last - first == len(sizes)
                n, at = last, np.cumsum(sizes)
                rows += [[words[int(c)].as_py() for c in part] for part in np.split(codes, at[:-1])]
                assert brown.shapes(words).tolist() == [plain_shape(w) for w in words.to_pylist()]
            assert rows == [[*plain_words(t), END] for t in some.to_pylist()]
