"""Vector codes against rounds that compare every part with every entry, and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from tailward.llm import codebooks
from tailward.llm.codebooks import Bounds, compress, distances, label_totals


def plain_version(vectors, rounds, parts, entries):
    x = np.floor(np.asarray(vectors, np.float64) * 1024).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(len(x), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()

    def nearest():
        return np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)

    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            for e in np.unique(code[:, p]):
                mine = x[code[:, p] == e, p]
                books[p, e] = mine.sum(0) // len(mine)
    code = nearest()
    error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
    return code, error, books


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties", "large"])
def test_equals_the_plain_version(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 10)).astype(np.float32)
    if kind == "clusters":
        x = rng.normal(size=(12, 10))[rng.integers(12, size=900)].astype(np.float32) + x / 50
    elif kind == "ties":
        x = rng.integers(-2, 3, size=(900, 10)).astype(np.float32) / 512
    elif kind == "large":
        x *= 30_000
    rows = [(k, v.tolist(), None if k % 3 == 0 else k % 5) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    coded, books = compress(df, rounds=5, entries=40, b=4)
    code, error, wanted = plain_version(x, 5, 4, 40)
    assert (books == wanted).all()
    got = {r.id: (list(r.code), r.error) for r in coded.collect()}
    assert got == {k: (code[k].tolist(), int(error[k])) for k in range(len(x))}
    sums = {}
    for _, _, label in (rows[k] for k in range(len(rows))):
        sums[label] = sum(int(error[k]) for k in range(len(rows)) if rows[k][2] == label)
    assert {(r.label, r.label_error) for r in label_totals(coded).collect()} == set(sums.items())


def test_salted_totals_equal_the_others(spark, monkeypatch):
    rows = [(k, None if k % 4 == 0 else k % 2, bytes([k % 7]), k) for k in range(300)]
    coded = spark.createDataFrame(rows, "id bigint, label int, code binary, error bigint")
    broadcasted = sorted((r.id, r.label_error) for r in label_totals(coded).collect())
    monkeypatch.setattr(codebooks, "broadcast_if_small", lambda df, width: df)
    assert sorted((r.id, r.label_error) for r in label_totals(coded).collect()) == broadcasted and len(broadcasted) == 300


def test_bounds_spare_distances():
    """After small moves the bounds settle most parts without looking at all entries, and never wrongly."""
    rng = np.random.default_rng(1)
    x, book = rng.integers(-500, 500, size=(3000, 8)), rng.integers(-500, 500, size=(64, 8))
    part = Bounds.fresh(x, book, 8)
    for size in (2, 3, 40, 1, 300):
        step = rng.integers(-size, size + 1, size=book.shape)
        book = book + step
        part.moved(np.ceil(np.sqrt((step**2).sum(1))).astype(np.int64))
        open_ = (part.upper >= part.lower[:, 0]).mean()
        assert size > 3 or open_ < 0.2
        part = part.settled(x, book)
        squares = distances(x, book)
        assert (part.code == squares.argmin(1)).all()
        nearest = np.sort(squares, axis=1)
        assert (part.upper.astype(float) ** 2 >= nearest[:, 0]).all() and (part.lower[:, 0].astype(float) ** 2 <= nearest[:, 1]).all()


def test_odd_vectors(spark):
    good = [(3, [0.5, -0.25, 0.1, 0.0, 1.0], 1), (1, [0.5, -0.25, 0.1, 0.0, 1.0], None), (None, [9.0, 9.0, 9.0, 9.0, 9.0], 2), (3, [0.5, -0.25, 0.1, 0.0, 1.0], 1), (7, [1e30, -1e30, 0.0, 0.0, 0.0], 1)]
    bad = [(0, None, 1), (2, [0.5, None, 0.1, 0.0, 1.0], 1), (4, [0.5, float("nan"), 0.1, 0.0, 1.0], 1), (5, [0.5, float("inf"), 0.1, 0.0, 1.0], 1), (6, [], 1), (8, [1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id bigint, embedding array<float>, label int, code string, error int")
    coded, books = compress(df)
    rows = coded.collect()
    assert sorted((r.id is None, r.id or 0) for r in rows) == [(False, 1), (False, 3), (False, 3), (False, 7), (True, 0)]
    assert books.shape == (4, 5, 2) and all(r.error == 0 for r in rows)
    assert len({bytes(r.code) for r in rows if r.id in (1, 3)}) == 1
    one, _ = compress(df.where("vec_id = 1"))
    assert [(bytes(r.code), r.error) for r in one.collect()] == [(b"\0\0\0\0", 0)]
    none, books = compress(df.where("embedding is null"))
    assert none.count() == 0 and label_totals(none).count() == 0 and books.size == 0
