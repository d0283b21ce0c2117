"""Vectors compressed to codes: each of four parts by its nearest entry of a learned codebook.

Components are scaled to integers, so distances are exact and every run gives the same codes.
Codebooks start at the parts of the first vectors and are moved to the floor of their parts'
mean a fixed number of rounds. After the first round most parts keep their entry, and the
bounds of Drake and Hamerly say so without a distance: each part carries, written with it, an
upper bound of the distance to its own entry, the ``b`` next closest entries in order of
their lower bounds, and one outer bound below all others. When entries move, the bounds give
way by as much. Only a part whose upper bound reaches a lower one is looked at: the distance
to its own entry first, then those to the listed entries still in reach, and all entries only
if the outer bound is reached. All decisions are made on exact squared integers; bounds are
whole numbers rounded to the safe side. Each batch of vectors adapts ``b``, for each part by itself: it
doubles where more than an eighth reached the outer bound, and halves where half was not needed.

A task holds one Arrow batch and the codebooks (parts x 256 entries, whatever the number of
vectors). Sums for the next codebooks are added per batch, then combined by entry. The state
of each round is a written table that the next one reads; a lost executor repeats only its share.

Dropped are vectors that are null, empty or hold a null or non-finite component, and those
whose length is not that of the first kept one. Components beyond 2**27 after scaling are set
to that bound, so that sums of squares stay exact. A length that the parts do not divide is filled up with zeros. Vectors come in
the order of their id, null last; of equal ids in that of their components. With fewer vectors than entries there is one entry a
vector, and none at all gives no rows. Ties go to the lower entry. Repeated rows are coded alike. Other columns take no part,
so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailward.session import stage

from .columns import broadcast_if_small

ENTRIES = 256
PARTS = 4
SCALE = 1024
LARGEST = 1 << 27
LISTED = (4, 64)  # least and greatest number of listed entries
_TOP = (1 << 16) - 1  # lower bounds are kept in 16 bits; a greater one counts as this


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    # A null component makes the sum null, an infinite or unknown one makes it unknown.
    total = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * 0)
    return F.coalesce((F.size(vector) > 0) & (total == 0), F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """The scaled components, rounded down."""
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    return F.transform(vector, lambda x: F.greatest(F.least(scaled(x), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def _floor_root(squares: np.ndarray) -> np.ndarray:
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def _ceil_root(squares: np.ndarray) -> np.ndarray:
    root = _floor_root(squares)
    return root + (root * root < squares)


def _ordered(lower: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Lower bounds made to rise along the list and stay below the outer one."""
    both = np.column_stack([lower, outer])
    return np.minimum.accumulate(both[:, ::-1], axis=1)[:, ::-1][:, :-1]


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all parts to all entries."""
    if max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)) < 1 << 20 and parts.shape[1] <= 1 << 10:
        p, e = parts.astype(np.float64), book.astype(np.float64)  # every term is a whole number below 2**53
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None]).astype(np.int64)
    return np.column_stack([((parts - entry) ** 2).sum(1) for entry in book])


class Bounds:
    """One part of a batch of vectors: own entry, upper bound, listed entries with lower bounds, outer bound."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray):
        self.code, self.upper, self.near, self.lower, self.outer = code, upper, near, lower, outer

    @classmethod
    def fresh(cls, parts: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        """From the distances to all entries."""
        squares = distances(parts, book)
        # Equal distances go to the lower entry, so entries are ranked by distance, then number.
        order = np.argsort(squares, axis=1, kind="stable")[:, : b + 2]
        ranked = np.take_along_axis(squares, order, axis=1)
        outer = _floor_root(ranked[:, b + 1]) if ranked.shape[1] > b + 1 else np.full(len(parts), _TOP)
        return cls(order[:, 0], _ceil_root(ranked[:, 0]), order[:, 1 : b + 1], _floor_root(ranked[:, 1 : b + 1]), outer)

    def put(self, rows: np.ndarray, new: Bounds) -> None:
        for name in ("code", "upper", "near", "lower", "outer"):
            getattr(self, name)[rows] = getattr(new, name)

    def moved(self, steps: np.ndarray) -> None:
        """Give way by how far entries have moved."""
        self.upper = self.upper + steps[self.code]
        self.outer = np.maximum(self.outer - steps.max(), 0)
        self.lower = _ordered(np.maximum(self.lower - steps[self.near], 0), self.outer)

    def settled(self, parts: np.ndarray, book: np.ndarray) -> Bounds:
        """Each part's nearest entry, found anew where the bounds leave it open; the list adapts to what was needed."""
        b = self.near.shape[1]
        nearest = self.lower[:, 0] if b else self.outer
        rows = np.flatnonzero(self.upper >= nearest)
        own = ((parts[rows] - book[self.code[rows]]) ** 2).sum(1)
        self.upper[rows] = _ceil_root(own)
        far = self.outer[rows] <= self.upper[rows]
        if far.sum() * 8 > len(parts) and b < min(LISTED[1], len(book) - 2):
            return Bounds.fresh(parts, book, min(2 * max(b, 1), LISTED[1], len(book) - 2))
        for chunk in np.array_split(rows[far], 1 + int(far.sum()) // 4096):
            if len(chunk):
                self.put(chunk, Bounds.fresh(parts[chunk], book, b))
        rows, own = rows[~far], own[~far]
        reach = (self.lower[rows] <= self.upper[rows, None]).sum(1)  # bounds rise, so these are the first ones
        for q in np.unique(reach[reach > 0]):
            at = rows[reach == q]
            entries = np.column_stack([self.code[at], self.near[at, :q]])
            others = ((parts[at, None, :] - book[self.near[at, :q]]) ** 2).sum(2)
            squares = np.column_stack([own[reach == q], others])
            order = np.lexsort((entries, squares), axis=1)
            entries, squares = np.take_along_axis(entries, order, axis=1), np.take_along_axis(squares, order, axis=1)
            self.code[at], self.upper[at], self.near[at, :q] = entries[:, 0], _ceil_root(squares[:, 0]), entries[:, 1:]
            self.lower[at] = _ordered(np.column_stack([_floor_root(squares[:, 1:]), self.lower[at, q:]]), self.outer[at])
        if b > LISTED[0] and not far.any() and reach.max(initial=0) < b // 2:
            kept = max(b // 2, LISTED[0])
            self.outer = np.minimum(self.outer, self.lower[:, kept])  # the first that falls off the list bounds all others
            self.near, self.lower = self.near[:, :kept], self.lower[:, :kept]
        return self


def _blobs(values: np.ndarray, dtype) -> pa.Array:
    """Rows of numbers as binary values."""
    rows = np.ascontiguousarray(values.reshape(len(values), -1), dtype)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _numbers(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).astype(np.int64)


def _padded(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers of different lengths as one array, and which of its places are filled."""
    sizes = pc.binary_length(column).to_numpy() // np.dtype(dtype).itemsize
    filled = np.arange(sizes.max(initial=0))[None] < sizes[:, None]
    out = np.zeros(filled.shape, np.int64)
    out[filled] = _numbers(column, dtype)
    return out, filled


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    """Vectors x parts x components, filled up with zeros."""
    flat = pc.list_flatten(column).to_numpy().astype(np.int64).reshape(len(column), -1)
    return np.pad(flat, ((0, 0), (0, -flat.shape[1] % parts))).reshape(len(column), parts, -1)


def _state(batch: pa.RecordBatch, bounds: list[Bounds]) -> pa.RecordBatch:
    """The rows of a batch with their bounds."""
    stacked = {n: np.stack([getattr(x, n) for x in bounds], 1) for n in ("code", "upper", "outer")}
    columns = [*batch.columns[:3], _blobs(stacked["code"], np.uint8), _blobs(stacked["upper"], np.uint32), _blobs(np.minimum(stacked["outer"], _TOP), np.uint16)]
    columns += [_blobs(x.near, np.uint8) for x in bounds] + [_blobs(np.minimum(x.lower, _TOP), np.uint16) for x in bounds]
    return pa.RecordBatch.from_arrays(columns, _names(len(bounds)))


def _names(parts: int) -> list[str]:
    return ["id", "label", "vec", "code", "upper", "outer", *[f"near_{p}" for p in range(parts)], *[f"lower_{p}" for p in range(parts)]]


def _bounds(batch: pa.RecordBatch, parts: int) -> list[Bounds]:
    code, upper, outer = (_numbers(batch.column(n), t).reshape(-1, parts) for n, t in (("code", np.uint8), ("upper", np.uint32), ("outer", np.uint16)))
    out = []
    for p in range(parts):
        near, filled = _padded(batch.column(f"near_{p}"), np.uint8)
        lower, _ = _padded(batch.column(f"lower_{p}"), np.uint16)
        # A place without an entry is in reach only when the outer bound is, and then all entries are looked at.
        lower = np.where(filled, lower, outer[:, p, None])
        out.append(Bounds(code[:, p].copy(), upper[:, p].copy(), near, lower, outer[:, p].copy()))
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def first_round(kept: DataFrame, books: np.ndarray, b: int) -> DataFrame:
    """Vectors (id, label, vec) with their nearest entries and bounds."""
    parts = len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vectors = _vectors(batch.column(2), parts)
            yield _state(batch, [Bounds.fresh(vectors[:, p], books[p], min(b, max(len(books[p]) - 2, 0))) for p in range(parts)])

    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    binary = ", ".join(f"{n} binary" for n in _names(parts)[3:])
    return kept.select("id", "label", "vec").mapInArrow(assign, f"id {id_type}, label {label_type}, vec array<int>, {binary}")


def next_round(state: DataFrame, books: np.ndarray, steps: np.ndarray) -> DataFrame:
    """The state after entries moved by ``steps`` to ``books``."""
    parts = len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vectors, bounds = _vectors(batch.column(2), parts), _bounds(batch, parts)
            for p, part in enumerate(bounds):
                part.moved(steps[p])
                bounds[p] = part.settled(vectors[:, p], books[p])
            yield _state(batch, bounds)

    return state.mapInArrow(assign, state.schema)


def new_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry moved to the floor of its parts' mean; an entry without parts stays."""
    parts, entries, length = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for batch in _slices(batches):
            vectors, code = _vectors(batch.column(0), parts), _numbers(batch.column(1), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], vectors[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        used = np.repeat(counts.ravel() > 0, length)
        numbers = [np.flatnonzero(used), sums.ravel()[used], np.repeat(counts.ravel(), length)[used]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in numbers], ["place", "total", "n"])

    added = state.select("vec", "code").mapInArrow(add, "place bigint, total bigint, n bigint")
    rows = added.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()  # at most one a component of an entry
    out = books.copy().ravel()
    out[rows["place"].to_numpy()] = rows["total"].to_numpy() // rows["n"].to_numpy()
    return out.reshape(books.shape)


def _coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of a settled state."""
    parts = len(books)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vectors, code = _vectors(batch.column(2), parts), _numbers(batch.column(3), np.uint8).reshape(-1, parts)
            error = sum(((vectors[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    id_type, label_type = (state.schema[c].dataType.simpleString() for c in ("id", "label"))
    return state.select("id", "label", "vec", "code").mapInArrow(measure, f"id {id_type}, label {label_type}, code binary, error bigint")


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = 4, parts: int = PARTS, entries: int = ENTRIES, b: int = 8) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of each usable vector, and the codebooks (parts x entries x length)."""
    kept = vectors.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(label).alias("label"), whole_numbers(F.col(vector)).alias("vec"))
    width = F.size("vec")
    lead = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(1).select(width).head()
    if lead is None:
        empty = kept.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")).where("false")
        return empty, np.zeros((parts, 0, 0), np.int64)
    kept = kept.where(width == lead[0])
    seeds = [r["vec"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()]
    books = np.stack([np.pad(np.array(v, np.int64), (0, -len(v) % parts)).reshape(parts, -1) for v in seeds], 1)
    state = stage(first_round(kept, books, b), "codes")
    for _ in range(rounds):
        moved = new_books(state, books)
        steps = _ceil_root(((moved - books) ** 2).sum(2))
        books = moved
        state = stage(next_round(state, books, steps), "codes")
    return _coded(state, books), books


def books_digest(books: np.ndarray) -> str:
    """Hash of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_totals(coded: DataFrame, salts: int = 32) -> DataFrame:
    """Add ``label_error``, the error of all rows of a row's label; null is a label like others.

    Labels are joined by broadcast if their sums are measured to be small, else spread over salts.
    """
    known = F.coalesce(F.col("label").cast("string"), F.lit(""))
    same = F.struct(F.col("label").isNull().alias("none"), known.alias("name"))
    totals = stage(coded.groupBy(same.alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    small = broadcast_if_small(totals, F.length("_label.name") + 16)
    if small is not totals:
        return coded.withColumn("_label", same).join(small, "_label").drop("_label")
    spread = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = coded.withColumn("_label", same).withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(salts)).cast("int"))
    return dealt.join(spread, ["_label", "_salt"]).drop("_label", "_salt")
