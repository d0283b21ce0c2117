"""Packing token sequences by cutting-stock column generation.

Texts become token ids with an end id; what is longer than a sequence is cut into full
sequences, and the rest are pieces to be packed. Their lengths, rounded up to ``grain``,
form a histogram of at most ``sequence / grain`` classes. How often to use which pattern
(a multiset of classes that fits a sequence) is a linear program over all patterns:
columns are generated by a knapsack over the dual prices until none improves, the
solution is rounded down, and what is left is packed first-fit by decreasing length. All
that works on the histogram alone, so it costs the same at any size of corpus. Pieces are
ranked within their class and each takes the place its rank has in the patterns.

Ranks are counted per class and salt and added up, so a class with a third of all pieces
is spread over many tasks. Null text counts as empty and still has its end id. Rows with
the same id are separate pieces sets (ties in the order of pieces are broken by length
and checksum; equal pieces are interchangeable). Null ids are packed like others. An
empty table gives no rows.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailward.session import stage

MEMO_BYTES = 12 << 20  # what the words and ids that a task keeps may take; when full, it starts anew
_ENTRY = 210  # bytes of an entry besides its characters and ids: two objects and their place in the table
# Characters at which splitting or lower-casing a text is left to the tokenizer: separators it takes for signs, and its special tokens' start.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_SIGNS = string.punctuation.replace("'", "")  # an apostrophe may join what follows it


def _byte_letters() -> dict[int, str]:
    """Letters that a byte-level tokenizer writes bytes with: visible ones stand for themselves, the rest for those from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokenizer(dict):
    """Ids of whole texts by a byte-level tokenizer that lower-cases, drops white space and splits letters from signs.

    No token reaches across white space, and a run of letters is a token run of its own, so
    each distinct word is encoded once: letters by the model alone, all else by the whole
    tokenizer. The items are the words' ids so far.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        """Ids of a lower-case word of the first 256 characters."""
        if word.isalpha():
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()
        elif (stem := word.rstrip(_SIGNS)).isalpha() and stem != word:
            ids = self[stem] + self[word[len(stem) :]]
        else:
            ids = self._whole(word)
        self[word] = ids
        self.held += _ENTRY + len(word) + len(ids)
        return ids

    def ids(self, text: str) -> bytes:
        """32-bit ids, little-endian as the machines are."""
        if any(c in text for c in _ODD):
            return self._whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        return b"".join(map(self.__getitem__, text.lower().split()))


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1, sequence: int = 2048) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of each text's ids with ``end_id``, cut at multiples of ``sequence``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer)
        end = array("I", [end_id]).tobytes()
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                at, start, length, check, total = [], [], [], [], []
                for row, text_ in enumerate(batch.column(1)):
                    ids = words.ids(text_.as_py() or "") + end
                    n = len(ids) // 4
                    for a in range(0, n, sequence):
                        b = min(a + sequence, n)
                        at.append(row), start.append(a), length.append(b - a), check.append(zlib.crc32(ids[4 * a : 4 * b])), total.append(n)
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                numbers = [pa.array(x, pa.int64()) for x in (start, length, check, total)]
                yield pa.RecordBatch.from_arrays([keys, *numbers], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    held = docs.select(F.col(key), F.col(text).cast("string"))
    return held.mapInArrow(cut, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _best_pattern(price: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of classes 1..n (class c takes c of ``room``) of greatest price."""
    value, choice = np.zeros(room + 1), np.zeros(room + 1, int)
    for r in range(1, room + 1):
        m = min(r, len(price))
        gains = price[:m] + value[r - 1 :: -1][:m]
        c = int(gains.argmax())
        value[r], choice[r] = (gains[c], c + 1) if gains[c] > value[r - 1] + 1e-12 else (value[r - 1], 0)
    pattern, r = np.zeros(len(price), int), room
    while r > 0:
        if choice[r]:
            pattern[choice[r] - 1] += 1
            r -= choice[r]
        else:
            r -= 1
    return float(value[room]), pattern


def column_generation(counts: np.ndarray, room: int, rounds: int = 3000) -> list[tuple[int, np.ndarray]]:
    """Patterns with multiplicities that take exactly ``counts`` pieces of classes 1..n, few in number.

    Revised simplex on the covering program, one column at a time.
    """
    used = np.flatnonzero(counts)
    if not len(used):
        return []
    demand = counts[used].astype(float)
    basis = np.diag((room // (used + 1)).astype(float))  # column: pattern
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ demand
    for _ in range(rounds):
        dual = np.maximum(inverse.sum(axis=0), 0)
        price = np.zeros(len(counts))
        price[used] = dual
        value, pattern = _best_pattern(price, room)
        if value <= 1 + 1e-7:
            break
        column = inverse @ pattern[used]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, np.maximum(amount, 0) / column, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = pattern[used]
        pivot = inverse[leave] / column[leave]
        inverse -= np.outer(column, pivot)
        inverse[leave] = pivot
        amount -= column * ratio[leave]
        amount[leave] = ratio[leave]
    left = counts.astype(np.int64).copy()
    plan = []
    for k in np.argsort(-amount, kind="stable"):
        pattern = np.zeros(len(counts), np.int64)
        pattern[used] = basis[:, k].astype(np.int64)
        here = pattern > 0
        times = min(int(amount[k] + 1e-6), int((left[here] // pattern[here]).min()))
        if times > 0:
            left -= times * pattern
            plan.append((times, pattern))
    while left.any():
        pattern, r = np.zeros(len(counts), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            take = min(int(left[c]), r // (int(c) + 1))
            pattern[c] += take
            r -= take * (int(c) + 1)
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= times * pattern
        plan.append((times, pattern))
    return plan


def pack_pieces(pieces: DataFrame, key: str = "doc_id", sequence: int = 2048, grain: int = 8) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces (id, start, length, ids_crc32, doc_tokens).

    Full sequences come after the packed ones.
    """
    spark: SparkSession = pieces.sparkSession
    room = sequence // grain
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cls = F.when(F.col("length") == sequence, 0).otherwise(F.ceil(F.col("length") / grain)).cast("int")
    ranked = pieces.withColumn("class", cls).withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(partitions)).cast("int"))
    sizes = stage(ranked.groupBy("class", "salt").agg(F.count("*").alias("n")), "sizes")
    totals = {r["class"]: r["n"] for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    counts = np.array([totals.get(c, 0) for c in range(1, room + 1)], np.int64)
    slots, at, taken = [], 0, np.zeros(room, np.int64)
    for times, pattern in column_generation(counts, room):
        for c in np.flatnonzero(pattern):
            slots.append((int(c) + 1, int(taken[c]), int(taken[c] + times * pattern[c]), int(pattern[c]), at))
            taken[c] += times * pattern[c]
        at += times
    # one row per class and pattern: at most classes times patterns, whatever the size of the corpus
    schema = "class int, low bigint, high bigint, each bigint, first bigint"
    places = F.broadcast(spark.createDataFrame(pa.table({n: pa.array([s[k] for s in slots], pa.int32() if not k else pa.int64()) for k, n in enumerate(("class", "low", "high", "each", "first"))}), schema))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    order = Window.partitionBy("class", "salt").orderBy("id", "start", "length", "ids_crc32")
    numbered = ranked.withColumn("number", F.row_number().over(order) - 1).join(begins, ["class", "salt"]).withColumn("rank", F.col("begin") + F.col("number"))
    held = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    full = numbered.where("class = 0").select(*held, (F.lit(at) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    fits = numbered.where("class > 0").join(places, "class").where("rank >= low and rank < high")
    placed = fits.select(*held, (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("bigint").alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    return placed.select(*held, "sequence_id", offset).unionByName(full).withColumnRenamed("id", key)


def pack_texts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1, sequence: int = 2048, grain: int = 8) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a word-splitting tokenizers file that every executor can read.
    """
    pieces = stage(token_pieces(docs, tokenizer, text, key, end_id, sequence), "pieces")
    return pack_pieces(pieces, key, sequence, grain)
