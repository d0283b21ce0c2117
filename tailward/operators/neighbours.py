"""The k most similar earlier rows of the same key, exactly, without forming all pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailward.session import stage

SLACK = 1e-9  # keeps a unit that lies exactly at the bound
SAMPLE = 4096  # rows of a key that its centres are found from
CELLS = 512  # of a key at most
ROUNDS = 8
CHUNK = 8192  # rows of a key that are dealt, or sent to a unit, in one task
SLICE = 512  # rows whose distances are held at once


def _nearest(queries: pd.DataFrame, candidates: pd.DataFrame, vec: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of queries and candidates, and distances, of the k nearest earlier candidates.

    Queries with a ``_limit`` and their distance ``_far`` to the candidates' centre are
    compared only with candidates whose own distance to it, ``_apart``, differs by no more:
    by the triangle inequality others are beyond the limit.
    """
    candidates = candidates.sort_values("_t")
    c, t, apart = candidates[vec].to_numpy(dtype="float64"), candidates["_t"].to_numpy(), candidates["_apart"].to_numpy()
    q, when = queries[vec].to_numpy(dtype="float64"), queries["_t"].to_numpy()
    ringed = "_limit" in queries
    if ringed:
        far, limit = queries["_far"].to_numpy(), queries["_limit"].fillna(np.inf).to_numpy()
    found = []
    for first in range(0, len(queries), SLICE):
        rows = np.arange(first, min(first + SLICE, len(queries)))
        within = t[None, : np.searchsorted(t, when[rows].max())] < when[rows, None]
        if ringed:
            within &= np.abs(far[rows, None] - apart[None, : within.shape[1]]) <= limit[rows, None]
        a, b = np.nonzero(within)
        square = np.zeros(len(a))
        for j in range(len(vec)):
            step = q[rows[a], j] - c[b, j]
            square += step * step
        dist = np.sqrt(square)
        order = np.lexsort((t[b], dist, a))
        a, b, dist = a[order], b[order], dist[order]
        best = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
        found.append((rows[a[best]], b[best], dist[best]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    at, near, dist = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, t[near], dist


def _matcher(key: str, vec: list[str], k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def match(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        rows, matches, dist = _nearest(queries, candidates, vec, k)
        return pd.DataFrame({key: queries[key].to_numpy()[rows], "_t": queries["_t"].to_numpy()[rows], "_match": matches, "distance": dist})

    return match


def _cells(key: str, vec: list[str], cell: int, most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Centres of a key's cells by a few rounds of k-means over its sample, which holds its number of rows in ``_rows``."""

    def place(sample: pd.DataFrame) -> pd.DataFrame:
        x = sample.sort_values("_t")[vec].to_numpy(dtype="float64")
        x = np.unique(x, axis=0)
        wanted = min(max(-(-int(sample["_rows"].iloc[0]) // cell), 1), most, len(x))
        centres = x[np.linspace(0, len(x) - 1, wanted).astype(int)]
        for _ in range(ROUNDS):
            nearest = _nearest_centre(x, centres)[0]
            sizes = np.bincount(nearest, minlength=wanted)
            sums = np.column_stack([np.bincount(nearest, x[:, j], wanted) for j in range(len(vec))])
            centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        out = pd.DataFrame(centres, columns=[f"_at_{c}" for c in vec])
        out.insert(0, "_cell", np.arange(wanted))
        out.insert(0, key, sample[key].iloc[0])
        return out

    return place


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nearest, apart = np.zeros(len(x), int), np.zeros(len(x))
    for first in range(0, len(x), SLICE):
        part = x[first : first + SLICE]
        square = np.zeros((len(part), len(centres)))
        for j in range(x.shape[1]):
            square += (part[:, j, None] - centres[None, :, j]) ** 2
        at = square.argmin(1)
        nearest[first : first + SLICE], apart[first : first + SLICE] = at, np.sqrt(square[np.arange(len(part)), at])
    return nearest, apart


def _dealer(key: str, vec: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def deal(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        nearest, apart = _nearest_centre(points[vec].to_numpy(dtype="float64"), centres[[f"_at_{c}" for c in vec]].to_numpy(dtype="float64"))
        cells = centres["_cell"].to_numpy()[nearest]
        return pd.DataFrame({key: points[key].to_numpy(), "_t": points["_t"].to_numpy(), "_cell": cells, "_apart": apart})

    return deal


class CellIndex:
    """Rows of each key in cells around centres, and which cells a row's neighbours can lie in.

    Centres come from a bounded sample of each key by a hash; they decide how much work there is,
    never the result. A unit is a cell within a span of time, so it has about ``cell`` rows
    whatever the history. It keeps the box around its rows and the ring around its
    centre that holds them: by the triangle inequality a row of the unit is no nearer than
    the gap to either. ``routed`` names the units within each row's bound, which is the
    distance of its k-th neighbour in its own unit.
    """

    def __init__(self, df: DataFrame, vec: list[str], k: int, key: str, order: str, cell: int):
        self.vec, self.k, self.key, self.order, self.cell = vec, k, key, order, cell
        self.key_type = dict(df.dtypes)[key]
        self.out = f"`{key}` {self.key_type}, _t int, _match int, distance double"
        in_time = Window.partitionBy(key).orderBy(order)
        held = df.select(key, order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in vec])
        self.rows = stage(held.withColumn("_t", F.row_number().over(in_time)), "knn-rows")
        self.points = stage(self._dealt(), "knn-points")
        # Of equal vectors the earliest ones come first, so no more than k of them are ever a match.
        same = Window.partitionBy(key, *vec).orderBy("_t")
        self.offered = stage(self.points.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy"), "knn-offered")

    def _dealt(self) -> DataFrame:
        key, vec = self.key, self.vec
        points = self.rows.drop(self.order).withColumn("_chunk", F.floor((F.col("_t") - 1) / F.lit(CHUNK)).cast("int"))
        by_hash = Window.partitionBy(key).orderBy(F.xxhash64("_t"), "_t")
        sample = points.withColumn("_nth", F.row_number().over(by_hash)).where(F.col("_nth") <= SAMPLE)
        sample = sample.join(points.groupBy(key).agg(F.count("*").alias("_rows")), key).select(key, "_t", "_rows", *vec)
        at = ", ".join(f"`_at_{c}` double" for c in vec)
        self.centres = stage(sample.groupBy(key).applyInPandas(_cells(key, vec, self.cell, CELLS), f"`{key}` {self.key_type}, _cell int, {at}"), "knn-centres")
        # toDF gives this second use of the rows columns of its own, so that the cogroup is not a self-join.
        known = points.select(key, "_chunk").distinct().join(self.centres, key)
        known = known.toDF(*known.columns)
        dealt = points.groupBy(key, "_chunk").cogroup(known.groupBy(key, "_chunk")).applyInPandas(_dealer(key, vec), f"`{key}` {self.key_type}, _t int, _cell int, _apart double")
        span = F.floor((F.col("_t") - 1) / F.lit(self.cell * CELLS)).cast("int")
        return self.rows.drop(self.order).join(dealt, [key, "_t"]).withColumn("_unit", span * CELLS + F.col("_cell")).drop("_cell")

    def units(self) -> DataFrame:
        vec, of_cell = self.vec, F.pmod(F.col("_unit"), F.lit(CELLS)).alias("_cell")
        box = [F.min(c).alias(f"_lo_{c}") for c in vec] + [F.max(c).alias(f"_hi_{c}") for c in vec]
        ring = [F.min("_apart").alias("_inner"), F.max("_apart").alias("_outer"), F.min("_t").alias("_first")]
        return self.offered.groupBy(self.key, F.col("_unit").alias("_to")).agg(*box, *ring).withColumn("_cell", F.pmod("_to", F.lit(CELLS))).join(self.centres, [self.key, "_cell"])

    def own(self) -> DataFrame:
        """The nearest earlier rows in each row's own unit."""
        names = [self.key, "_unit", "_t", *self.vec, "_apart"]
        queries, offered = self.points.select(*names), self.offered.select(*names).toDF(*names)
        match = _matcher(self.key, self.vec, self.k)
        return queries.groupBy(self.key, "_unit").cogroup(offered.groupBy(self.key, "_unit")).applyInPandas(match, self.out)

    def routed(self, own: DataFrame) -> DataFrame:
        """(key, _t, vector, _to, _far, _limit) of each row and each other unit that can hold one of its nearest earlier rows."""
        key, vec = self.key, self.vec
        bounds = own.groupBy(key, "_t").agg(F.max("distance").alias("_bound"), F.count(F.lit(1)).alias("_found"))
        gap = lambda c: F.greatest(F.col(f"_lo_{c}") - F.col(c), F.col(c) - F.col(f"_hi_{c}"), F.lit(0.0))
        to_box = F.sqrt(sum((gap(c) * gap(c) for c in vec), F.lit(0.0)))
        to_centre = F.sqrt(sum(((F.col(c) - F.col(f"_at_{c}")) * (F.col(c) - F.col(f"_at_{c}")) for c in vec), F.lit(0.0)))
        reached = self.points.join(bounds, [key, "_t"], "left").join(self.units(), key).where((F.col("_to") != F.col("_unit")) & (F.col("_first") < F.col("_t")))
        # Rounding: bounds are compared with a little slack, of the size of the numbers they come from.
        reached = reached.withColumn("_limit", F.when(F.coalesce("_found", F.lit(0)) >= self.k, F.col("_bound"))).withColumn("_far", to_centre)
        slack = F.col("_limit") + (F.col("_far") + F.col("_outer") + F.col("_limit")) * SLACK
        reached = reached.withColumn("_limit", slack)
        limit = F.col("_limit")
        within = limit.isNull() | ((to_box <= limit) & (F.col("_far") - F.col("_outer") <= limit) & (F.col("_inner") - F.col("_far") <= limit))
        return reached.where(within).select(key, "_t", "_to", "_far", "_limit", *vec)

    def far(self, routed: DataFrame) -> DataFrame:
        """The nearest earlier rows in the units each row is sent to; a task sees one unit and a chunk of the rows sent there."""
        key = self.key
        chunked = routed.withColumn("_chunk", F.floor(F.col("_t") / F.lit(CHUNK)).cast("int"))
        names = [key, "_to", "_chunk", "_t", *self.vec, "_apart"]
        pairs = chunked.select(key, "_to", "_chunk").distinct()
        offered = self.offered.withColumnRenamed("_unit", "_to").join(pairs, [key, "_to"]).select(*names).toDF(*names)
        match = _matcher(key, self.vec, self.k)
        return chunked.groupBy(key, "_to", "_chunk").cogroup(offered.groupBy(key, "_to", "_chunk")).applyInPandas(match, self.out)


def similar_history(df: DataFrame, vec: list[str], k: int = 5, key: str = "variety", order: str = "bar", cell: int = 64) -> DataFrame:
    """The ``k`` rows of the same key, strictly earlier in ``order``, at the smallest Euclidean distance.

    Exact, by a metric index (``CellIndex``): each row first searches its own unit, which
    bounds how far its k-th neighbour can be, and is then sent only to units within that
    bound. Tasks see one unit and a chunk of rows, so a large key becomes more tasks, not
    larger ones, and a vector that repeats is offered ``k`` times at most. Missing components count as 0; equal
    distances go to the earliest row. Expects distinct ``order`` values per key.

    Result: ``key``, ``order``, ``match_<order>``, ``distance``, ``nth``.
    """
    index = CellIndex(df, vec, k, key, order, cell)
    own = stage(index.own(), "knn-own")
    far = index.far(stage(index.routed(own), "knn-routed"))
    best = Window.partitionBy(key, "_t").orderBy("distance", "_match")
    top = own.unionByName(far).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    at = index.rows.select(key, "_t", order)
    matched = at.select(key, F.col("_t").alias("_match"), F.col(order).alias(f"match_{order}"))
    return top.join(at, [key, "_t"]).join(matched, [key, "_match"]).select(key, order, f"match_{order}", "distance", "nth")
