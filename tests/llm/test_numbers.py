"""The numpy helpers against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tailward.llm.brown import exchange_clusters
from tailward.llm.flat import flat, row_sums, slices
from tailward.llm.packing import column_generation
from tailward.llm.shingles import shingle_sets
from tailward.llm.similar import Order, parities, tree_overlaps
from tailward.llm.toxicity import count_trigrams, decode, restored_words, trigram_costs


def plain_shingles(text: str) -> set[tuple[str, ...]]:
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@given(st.lists(st.one_of(st.none(), st.text("aB \n\x0bé漢", max_size=30)), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_shingles_are_equal_where_the_words_are(texts):
    plain = [plain_shingles(t or "") for t in texts]
    found = [set(s.tolist()) for s in shingle_sets(pa.array(texts, pa.string()))]
    assert [len(s) for s in found] == [len(p) for p in plain]
    for a, b in zip(range(len(texts)), range(1, len(texts))):
        assert len(found[a] & found[b]) == len(plain[a] & plain[b])


def test_slices_cover_all_rows_and_sums_match():
    texts = pa.array(["abc", None, "", "x" * 50, "yz"])
    data, at = flat(texts)
    assert bytes(data[at[0] : at[-1]]) == b"abc" + b"x" * 50 + b"yz"
    assert [r for a, b in slices(at, 4) for r in range(a, b)] == list(range(5))
    assert row_sums(np.ones(len(data)), at[:-1], at[1:]).tolist() == [3, 0, 0, 50, 2]


def test_a_sliced_column_is_read_from_its_own_start():
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e f", "g", "h i"]).slice(1))] == [1, 1]


def test_tree_walk_counts_or_prunes():
    rng = np.random.default_rng(3)
    one = np.unique(rng.integers(0, 500, 200).astype(np.uint64))
    others = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (1, 60, 200, 200, 300)] + [one, one[:150]]
    exact = [len(np.intersect1d(one, o)) for o in others]
    assert tree_overlaps(one, others, [0] * len(others)) == exact
    for need in (20, 90, 150, 190):
        found = tree_overlaps(one, others, [need] * len(others))
        assert all(f == e or (f == -1 and e < need) for f, e in zip(found, exact))


def test_parities_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 1 << 40, 300).astype(np.uint64)) for _ in "ab")
        differ = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(parities(a), parities(b)))
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) / 2


def test_order_keeps_sets_apart_and_puts_frequent_last():
    s = np.array([10, 20, 30, 40], np.uint64)
    keys = Order(np.array([30, 10], np.uint64)).keys(s)
    assert len(set(keys.tolist())) == 4 and (keys[-2:] >= 1 << 63).all() and (keys[:2] < 1 << 63).all()


def test_column_generation_covers_and_fills():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(0, 64, 5000), minlength=64)
    plan = column_generation(counts, 64)
    assert (sum(t * p for t, p in plan) == counts).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for _, p in plan)
    used = sum(t for t, _ in plan)
    assert used <= 1.02 * (counts * np.arange(1, 65)).sum() / 64 + 2
    assert column_generation(np.zeros(64, int), 64) == []


def test_exchange_finds_alternating_classes():
    rng = random.Random(6)
    bigrams = np.zeros((12, 12), int)
    for _ in range(6000):
        a = rng.randrange(6)
        bigrams[a, 6 + rng.randrange(6)] += 1
        bigrams[6 + rng.randrange(6), a] += 1
    cls = exchange_clusters(bigrams, 2)
    assert len(set(cls[:6])) == 1 and len(set(cls[6:])) == 1 and cls[0] != cls[6]


def test_disguised_words_are_restored():
    corpus = pa.array(["the idiot and the moron read stupid trash about a pathetic clown that is worthless"] * 50)
    costs = trigram_costs(count_trigrams(corpus))
    for run, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("p@thetic", "pathetic"), ("i d i o t", "idiot"), ("c-l-o-w-n", "clown"), ("tr4sh", "trash")]:
        assert word in restored_words(f"the {run} of", costs), run
    assert restored_words("plain words, only!", costs) == {"plain", "words", "only"}
    assert decode("x" * 200, costs)


def test_quality_learns_from_every_label(spark):
    """The pairs hold every labelled row, and the cuts are quantiles of all of them."""
    from pyspark.sql import functions as F

    from tailward.llm import quality

    rows = [(k, int(k % 7 > 1), f"k{k}") for k in range(15_000)]
    df = spark.createDataFrame([(y, k, k.encode()) for _, y, k in rows], "y int, k string, bins binary").withColumn("_hash", F.xxhash64("k"))
    worse = sum(y == 0 for _, y, _ in rows)
    pairs = quality.draw_pairs(df, len(rows) - worse, worse, 5)
    n, better, others = pairs.agg(F.count("*"), F.countDistinct("better"), F.countDistinct("worse")).first()
    assert (n, better, others) == ((len(rows) - worse) * 5, len(rows) - worse, worse)
    docs = spark.createDataFrame([(k, "x" * (1 + k // 100), k % 2) for k in range(15_000)], "doc_id bigint, text string, quality int")
    model = quality.fit_quality(docs)
    sizes = np.log1p(1 + np.arange(15_000) // 100)
    expected = np.unique([np.nextafter(0, 1), *np.quantile(sizes, np.linspace(0, 1, 11)[1:-1]), *np.quantile(sizes, (0.25, 0.5, 0.75))])
    assert np.allclose(model.cuts[quality.FEATURES.index("log_bytes")], expected)
