"""Texts linked by the Jaccard similarity of their word shingles: a prefix-tree join.

A text's set is its distinct shingles. Sets are held in one global order, rare shingles
first: ``frequent_shingles`` of a bounded sample of texts come last, the rest by number.
The order decides only how much work there is, never the result.

1. Equal sets are one: a group of copies is stood for by its smallest id.
2. In global order, two sets that link must share one of their first ``n - ceil(s n) + 1``
   shingles: these are the tree's first steps, and sets meet by joining on them.
3. First each set is tested against one other that it meets often. Sets that meet and are
   not connected by then are tested by way of their components' roots, and against single
   sets only where the triangle inequality leaves the link possible. A pair that cannot
   link by size or by the parities of its shingles' residues is not tested.
4. A test walks the tree of the sets that meet the same set: they are sorted in the global
   order, so neighbours share the start of their paths, and what is shared is counted
   once; a subtree is left as soon as the shingles that remain cannot make up the overlap.
5. Links become components by pointer jumping over written tables.

A group of near copies, however large, meets in many places but is connected by one test
a set; only what stays unconnected is ever paired, so nothing is quadratic in such a group.

Null, empty and blank texts have an empty set and link with nothing. A row with a null id
links with nothing and has a null component. Rows with the same id are one document: it
links by any of its texts. Repeated rows keep their number in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailward.session import stage

from .columns import broadcast_if_small
from .components import components
from .shingles import mix, shingle_sets

PARITY_WORDS = 16
PART = 256  # sets walked together
WIDTH = 64  # bytes that a row of ids takes at most
_LAST = np.uint64(1 << 63)


def frequent_shingles(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, share: float = 1 / 6, at_least: int = 3, most: int = 1_000_000) -> np.ndarray:
    """Shingles in ``at_least`` of the texts whose key's hash lies in the lowest ``share``, rarest first; it only serves to order them.

    At most ``most`` shingles are kept, the most frequent: with more, the order is coarser
    and sets meet more often, but the result is the same.
    """
    chosen = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col(text).cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                sets = list(shingle_sets(batch.column(0).slice(k, 500), width))
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["s", "n"])

    counted = chosen.mapInArrow(count, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
    top = counted.orderBy(F.col("n").desc(), "s").limit(most).toArrow()
    return top["s"].to_numpy().view(np.uint64)[::-1].copy()


class Order:
    """The global order: shingles as numbers that ascend from rare to frequent."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent, kind="stable")
        self.known = frequent[self.rank]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        keys = shingles >> np.uint64(1)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            hit = self.known[at] == shingles
            keys[hit] = _LAST | self.rank[at[hit]].astype(np.uint64)
        return np.sort(keys)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each residue class of the shingles' numbers, whether the set has an odd number of it, as bits."""
    odd = np.bincount((shingles & np.uint64(PARITY_WORDS * 64 - 1)).astype(np.int64), minlength=PARITY_WORDS * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def tree_overlaps(one: np.ndarray, others: list[np.ndarray], needs: list[int], step: int = 256) -> list[int]:
    """Overlap of the ordered set ``one`` with each other ordered set, or -1 where it must stay below its need.

    The others are walked as a tree: in sorted order each shares the start of its path
    with the one before, whose counts it takes over.
    """
    order = sorted(range(len(others)), key=lambda k: others[k].astype(">u8").tobytes())
    out = [-1] * len(others)
    path: list[tuple[int, int, int]] = [(0, 0, 0)]  # depth, overlap so far, place in ``one``
    last = np.zeros(0, np.uint64)
    for k in order:
        keys, need = others[k], needs[k]
        m = min(len(last), len(keys))
        differ = np.flatnonzero(last[:m] != keys[:m])
        shared = int(differ[0]) if len(differ) else m
        while path[-1][0] > shared:
            path.pop()
        depth, overlap, place = path[-1]
        last = keys
        while True:
            if overlap + min(len(keys) - depth, len(one) - place) < need:
                break
            if depth == len(keys):
                out[k] = overlap
                break
            part = keys[depth : depth + step]
            at = np.searchsorted(one, part)
            overlap += int((one[np.minimum(at, len(one) - 1)] == part)[at < len(one)].sum())
            depth += len(part)
            place = int(np.searchsorted(one, part[-1], "right"))
            path.append((depth, overlap, place))
    return out


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Overlap of ``one`` with each other set."""
    return [int((one[np.minimum(np.searchsorted(one, o), len(one) - 1)] == o).sum()) for o in others]


def _links(percent: int, n: Column, m: Column, overlap: Column) -> Column:
    return 100 * overlap >= percent * (n + m - overlap)


def _possible(percent: int) -> Column:
    """Whether a and b can link, by their sizes and parities."""
    differ = sum((F.bit_count(F.col("p_a")[k].bitwiseXOR(F.col("p_b")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    return _links(percent, F.col("n_a"), F.col("n_b"), F.least("n_a", "n_b")) & _links(percent, F.col("n_a"), F.col("n_b"), ((F.col("n_a") + F.col("n_b") - differ) / 2).cast("bigint"))


class _Join:
    def __init__(self, docs: DataFrame, text: str, key: str, percent: int, width: int):
        self.percent, self.width = percent, width
        self.docs = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
        self.order = Order(frequent_shingles(self.docs, "text", "id", width))
        self.sets = stage(self._sets(), "sets")
        same = self.sets.where("n > 0 and id is not null").groupBy("d1", "d2", "n")
        self.groups = stage(same.agg(F.min("id").alias("rep")), "groups")
        # the set of a group's smallest id stands for it
        on = (F.col("id") == F.col("rep")) & (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2"))
        g = self.groups.select("rep", F.col("d1").alias("g1"), F.col("d2").alias("g2"))
        self.reps = self.sets.where("n > 0").join(g, on, "left_semi")

    def _sets(self) -> DataFrame:
        order, percent, width = self.order, self.percent, self.width

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    n, one, two, steps, odd = [], [], [], [], []
                    for s in shingle_sets(part.column(1), width):
                        n.append(len(s))
                        one.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                        two.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                        first = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                        steps.append(order.keys(s)[:first].view(np.int64))
                        odd.append(parities(s))
                    many = pa.list_(pa.int64())
                    columns = [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(odd, many), pa.array(steps, many)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "p", "steps"])

        kind = self.docs.schema["id"].dataType.simpleString()
        return self.docs.mapInArrow(sets, f"id {kind}, n bigint, d1 bigint, d2 bigint, p array<bigint>, steps array<bigint>")

    def meetings(self) -> DataFrame:
        """(step, id) of the steps where at least two sets meet, with the smallest of them as ``center``."""
        each = self.reps.select("id", F.explode("steps").alias("step"))
        shared = each.groupBy("step").agg(F.min("id").alias("center"), F.max("id").alias("_last")).where("center < _last").drop("_last")
        return stage(each.join(shared, "step"), "meetings")

    def shingles(self, wanted: DataFrame) -> DataFrame:
        """(a, id, s) of each shingle of the texts of ``wanted`` (a, id)."""
        order, width = self.order, self.width

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    keys = [order.keys(s).view(np.int64) for s in shingle_sets(part.column(2), width)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64()))], ["a", "id", "keys"])

        texts = self.docs.join(broadcast_if_small(stage(wanted, "wanted"), F.lit(WIDTH)), "id").select("a", "id", "text")
        kind = self.docs.schema["id"].dataType.simpleString()
        return texts.mapInArrow(each, f"a {kind}, id {kind}, keys array<bigint>").select("a", "id", F.explode("keys").alias("s")).distinct()

    def test(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, with their distance."""
        return self.measure(pairs.where("a <> b"), _possible(self.percent), True).where("linked")

    def measure(self, pairs: DataFrame, possible: Column, prune: bool = False) -> DataFrame:
        """(a, b, distance, linked) of the pairs that may be ``possible``; with ``prune`` the distance only of those that link."""
        brief = self.reps.select("id", "n", "p")
        of = {x: brief.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}")) for x in "ab"}
        able = stage(pairs.join(of["a"], "a").join(of["b"], "b").where(possible).select("a", "b").distinct(), "able")
        # the sets that meet one set are walked in parts of about PART, each with a copy of its text
        parts = able.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("_parts"))
        dealt = able.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("part"))
        wanted = dealt.select("a", "part", F.lit(True).alias("member"), F.col("b").alias("id")).unionByName(
            dealt.select("a", "part", F.lit(False).alias("member"), F.col("a").alias("id")).distinct()
        )
        wanted = broadcast_if_small(stage(wanted, "wanted"), F.lit(WIDTH))
        texts = self.docs.join(wanted, "id").select("a", "part", "member", "id", "text").repartition("a", "part").sortWithinPartitions("a", "part", "member")
        order, width, share = self.order, self.width, Fraction(self.percent, 100 + self.percent)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ones = None, {}
            for whole in batches:
                for k in range(0, whole.num_rows, 256):
                    batch = whole.slice(k, 256)
                    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                    member, sets = batch.column(2).to_pylist(), [order.keys(s) for s in shingle_sets(batch.column(4), width)]
                    apart, linked = np.full(len(keys), 2.0), np.zeros(len(keys), bool)
                    start = 0
                    while start < len(keys):
                        end = start + 1
                        while end < len(keys) and keys[end] == keys[start] and member[end] == member[start]:
                            end += 1
                        if keys[start] != at:
                            at, ones = keys[start], {}
                        if not member[start]:
                            ones.update({s.tobytes(): s for s in sets[start:end]})
                        for one in ones.values() if member[start] else ():
                            others = sets[start:end]
                            # 100 o >= percent (n + m - o)
                            needs = [math.ceil(share * (len(one) + len(o))) for o in others]
                            for i, (o, need) in enumerate(zip(tree_overlaps(one, others, needs) if prune else overlaps(one, others), needs, strict=True), start):
                                linked[i] |= o >= need
                                apart[i] = min(apart[i], 1 - o / (len(one) + len(sets[i]) - o) if o >= 0 else 1)
                        start = end
                    columns = [batch.column(0), batch.column(3), pa.array(apart), pa.array(linked)]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "distance", "linked"]).filter(batch.column(2))

        kind = self.docs.schema["id"].dataType.simpleString()
        measured = texts.mapInArrow(walk, f"a {kind}, b {kind}, distance double, linked boolean")
        return stage(measured.where("linked") if prune else measured, "measured")


def _unconnected(join: _Join, meetings: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets that meet and lie in different components.

    Jaccard distance is a metric. Where two components meet, each set of the smaller is
    measured against the root of the larger, and so is each set of the larger; by the
    triangle inequality a set can only link with those whose distance to the root is at
    least its own less the links' greatest distance. Only these are tested.
    """
    reach = 1 - percent / 100 + 1e-9
    named = meetings.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("step", "id", F.coalesce("root", "id").alias("root"))
    several = named.groupBy("step").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most").select("step")
    size = roots.groupBy("root").agg(F.count("*").alias("size"))
    brief = join.reps.select("id", "n")
    left = named.join(several, "step").join(brief, "id").join(size, "root", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    left = stage(left.select("step", "id", "n", "root", "size"), "unconnected")

    # distance to the root of each set in a component of several
    members = left.where("size > 1").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()
    radius = stage(join.measure(members, F.lit(True)).groupBy("a", "b").agg(F.min("distance").alias("radius")), "radius")
    widest = radius.groupBy("a").agg(F.max("radius").alias("widest"))

    larger = left.groupBy("step", F.col("root").alias("a"), F.col("size").alias("_size")).agg(F.min("n").alias("_low"), F.max("n").alias("_high"))
    bigger = (F.col("_size") > F.col("size")) | ((F.col("_size") == F.col("size")) & (F.col("a") < F.col("root")))
    sizes = (100 * F.col("n") >= percent * F.col("_low")) & (percent * F.col("n") <= 100 * F.col("_high"))
    facing = left.join(larger, "step").where(bigger & sizes).select("a", F.col("id").alias("b")).distinct()
    facing = facing.join(widest, "a", "left").select("a", "b", F.coalesce("widest", F.lit(0.0)).alias("widest"))
    # the least distance that sizes and parities allow
    differ = sum((F.bit_count(F.col("p_a")[k].bitwiseXOR(F.col("p_b")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    most = F.least(F.col("n_a"), F.col("n_b"), ((F.col("n_a") + F.col("n_b") - differ) / 2).cast("bigint"))
    near = 1 - most / (F.col("n_a") + F.col("n_b") - most) <= F.col("widest") + reach
    faced = join.measure(facing, near)
    direct = faced.where("linked").select("a", "b")

    # a set links with none of a component if too few of its shingles occur anywhere in it
    close = stage(faced.join(widest, "a").where(F.col("distance") - reach <= F.col("widest")).select("a", "b", "distance"), "close")
    owned = radius.select("a", F.col("b").alias("id")).unionByName(radius.select("a", F.col("a").alias("id"))).distinct()
    owned = owned.join(close.select("a").distinct(), "a", "left_semi")
    within = join.shingles(owned).select("a", "s").distinct()
    shared = join.shingles(close.select("a", F.col("b").alias("id"))).join(within, ["a", "s"]).groupBy("a", "id").agg(F.count("*").alias("shared"))
    lowest = larger.groupBy("a").agg(F.min("_low").alias("low"))
    able = shared.join(lowest, "a").join(brief.groupBy("id").agg(F.max("n").alias("n")), "id").where(_links(percent, F.col("n"), F.greatest("low", "shared"), F.col("shared")))
    close = close.join(able.select("a", F.col("id").alias("b")), ["a", "b"], "left_semi")

    # against the larger component's other sets: joined by distance class, so that only those within reach meet
    classes = 50
    parts = join.reps.select(F.col("id").alias("_id"), "n", "p")
    larger_side = radius.join(parts, F.col("b") == F.col("_id")).select(
        F.col("a").alias("_a"), F.col("b").alias("other"), "radius", F.floor(F.col("radius") * classes).alias("_in"), F.col("n").alias("n_a"), F.col("p").alias("p_a")
    )
    smaller_side = close.join(parts, F.col("b") == F.col("_id")).select("a", "b", "distance", F.col("n").alias("n_b"), F.col("p").alias("p_b"))
    smaller_side = smaller_side.withColumn("_class", F.explode(F.sequence(F.greatest(F.floor((F.col("distance") - reach) * classes), F.lit(0)), F.lit(classes))))
    within_reach = (F.col("a") == F.col("_a")) & (F.col("_class") == F.col("_in")) & (F.col("radius") >= F.col("distance") - reach) & (F.col("other") != F.col("a"))
    reached = smaller_side.join(larger_side, within_reach & _possible(percent))
    pairs = reached.select(F.least("b", "other").alias("a"), F.greatest("b", "other").alias("b")).distinct()
    return direct.unionByName(join.test(pairs).select("a", "b"))


def component_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80, width: int = 5) -> DataFrame:
    """For each row of ``docs``: its id (as ``key``), ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when 100 x intersection >= ``percent`` x union of their sets.
    """
    join = _Join(docs, text, key, percent, width)
    meetings = join.meetings()
    # ids that stand for several sets, as their rows have several texts, are connected to begin with
    sets = join.sets.where("n > 0 and id is not null").select("id", "d1", "d2", "n").distinct()
    several = sets.join(join.groups, ["d1", "d2", "n"]).groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("_reps")).where(F.size("_reps") > 1)
    links = several.select("a", F.explode("_reps").alias("b"))

    counted = meetings.where("id <> center").groupBy("id", "center").agg(F.count("*").alias("n"))
    best = counted.groupBy("id").agg(F.max_by("center", "n").alias("a"))
    links = stage(links.unionByName(join.test(best.select("a", F.col("id").alias("b"))).select("a", "b")), "links")
    links = links.unionByName(_unconnected(join, meetings, components(links), percent))
    roots = components(links)

    member = join.groups.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d1", "d2", F.col("n").alias("m"), F.coalesce("root", "rep").alias("component_id"))
    rows = join.sets.select("id", "n", "d1", "d2").withColumnsRenamed({"d1": "e1", "d2": "e2"})
    found = rows.join(member, (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")) & (F.col("n") == F.col("m")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
