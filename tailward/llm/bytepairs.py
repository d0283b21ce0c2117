"""Byte-level pair encoding and decoding with the ranks of a public vocabulary.

A text is split into pieces by the vocabulary's pattern, and each piece's bytes are merged:
of all neighbours whose joined bytes are a token, those of the lowest rank first, leftmost
first. A piece that is a token itself needs no merges.

* Pieces of up to ``SHORT`` bytes are merged together: those of one length are the rows of a
  matrix of ids, beside one of the ranks of neighbours; each step joins the lowest neighbours of
  every row and ranks the two beside them anew, and rows without any leave.
* Longer pieces keep neighbours in a heap by rank and place, so the work grows with n log n and
  a run of 100,000 letters is only long.

The merges are done for distinct pieces. Spark counts all of them, and as many of the most
frequent as ``MEMO_BYTES`` bounds are merged once and broadcast, piece to ids. Any other piece is
merged by the task that meets it, which keeps what it has merged until that takes ``MEMO_BYTES``,
and then starts anew; the result is the same. So no text is shuffled, only one row per distinct
piece and input partition. Spark's pattern may know fewer letters than the vocabulary's; that
changes only which pieces are counted, never how a text is split.

Decoding looks up each id's bytes and joins them, a batch of rows at a time. Null texts count as
empty; an empty text has no ids. Null ids, and ids the vocabulary does not have, decode to
nothing. Other columns are kept, those named like a result replaced; repeated rows and null keys
are rows like others. ``encode_texts`` refuses ranks of which merges do not reduce every token
to two parts below its own rank, as no training makes them.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailward.session import stage

from .columns import add_columns

SHORT = 60  # bytes of a piece that is a row of a matrix
NONE = 1 << 30  # the rank of bytes that are no token
MEMO_BYTES = 12 << 20  # bound of the table of frequent words, and of the words that a task keeps besides
TOGETHER = 50_000  # pieces whose unknown ones are merged at once
IDS = 100_000  # ids looked up at once
MEMO_WORD = 40  # bytes of the longest word in that table
_ENTRY = 190  # bytes of an entry besides its characters and ids: two objects and their place in the table

# Letters and numbers of Unicode 14 to 16, which an older Python does not know as such.
LETTERS_SINCE = """
870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4
10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0
107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1
113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE
16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB
1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF
"""
NUMBERS_SINCE = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space of Unicode
# The vocabulary's pattern as Spark has it, for counting: (?U) gives white space its Unicode meaning.
COUNTED = r"(?U)'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _kind(initial: str, listed: str, last: int) -> str:
    """The characters of a general category up to ``last``, as ranges of a pattern's class."""
    points = {c for c in range(last + 1) if unicodedata.category(chr(c))[0] == initial}
    for ends in (r.split("-") for r in listed.split()):
        points.update(c for c in range(int(ends[0], 16), int(ends[-1], 16) + 1) if c <= last)
    firsts = sorted(c for c in points if c - 1 not in points)
    lasts = sorted(c for c in points if c + 1 not in points)
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(firsts, lasts))


@cache
def piece_pattern(last: int) -> re.Pattern:
    """The vocabulary's pattern, for texts without characters beyond ``last``: the fewer ranges, the faster."""
    letter, number = _kind("L", LETTERS_SINCE, last), _kind("N", NUMBERS_SINCE, last)
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def pieces(text: str) -> list[str]:
    last = 0x7F if text.isascii() else 0xFFFF if max(text) <= "\uffff" else sys.maxunicode
    return piece_pattern(last).findall(text)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2, ...")
    return [tokens[k] for k in range(len(tokens))]


def _joined(ids: Column, parts: list[bytes]) -> Column:
    """What ``parts`` has for each row's ids, joined; nothing for ids that it does not have, and for a null row."""

    @F.arrow_udf("binary")
    def join(batch: pa.Array) -> pa.Array:
        held = pa.array([*parts, b""], pa.large_binary())
        starts, flat = batch.offsets.to_numpy(), batch.values
        joined, first = [pa.array([], pa.binary())], 0
        while first < len(batch):
            end = max(first + 1, int(starts.searchsorted(starts[first] + IDS, "right")) - 1)
            some = pc.fill_null(flat.slice(starts[first], starts[end] - starts[first]), -1).to_numpy()
            taken = held.take(pa.array(np.where((some >= 0) & (some < len(parts)), some, len(parts))))
            at = np.frombuffer(taken.buffers()[1], np.int64)[starts[first : end + 1] - starts[first]] if len(some) else np.zeros(end - first + 1, np.int64)
            joined.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(at), taken.buffers()[2]]).cast(pa.binary()))
            first = end
        return pa.concat_arrays(joined)

    return join(ids)


class Ranks:
    """Tokens by rank."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens

    def bytes_of(self, ids: Column) -> Column:
        """The bytes of ids, joined."""
        return _joined(ids, self.tokens)

    def little_endian(self, ids: Column) -> Column:
        """The ids as 32-bit numbers, joined."""
        return _joined(ids, [k.to_bytes(4, "little") for k in range(len(self.tokens))])


@cache
def pair_ranks(tokens: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Every two tokens whose joined bytes are a token, as one number in ascending order, and the joined token's rank."""
    rank = {t: k for k, t in enumerate(tokens)}
    found = sorted((rank[t[:k]] * len(tokens) + rank[t[k:]], r) for r, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank)
    return np.array([key for key, _ in found] + [len(tokens) ** 2]), np.array([r for _, r in found] + [NONE], np.int32)


def _short_parts(pairs: tuple[np.ndarray, np.ndarray], tokens: int, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and ids of pieces of equal length, given as rows of the ids of their bytes.

    Each step joins every row's lowest pair, so all rows that go on are equally long.
    """

    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * tokens + right
        at = pairs[0].searchsorted(key)
        return np.where(pairs[0][at] == key, pairs[1][at], NONE)

    places = np.arange(len(parts))
    ranked = ranks(parts[:, :-1], parts[:, 1:])
    while len(places):
        if not (width := ranked.shape[1]):
            yield places, parts
            return
        k = ranked.argmin(axis=1)
        lowest = ranked[np.arange(len(k)), k]
        done = lowest == NONE
        yield places[done], parts[done]
        places, parts, ranked, k, lowest = (x[~done] for x in (places, parts, ranked, k, lowest))
        row, at = np.arange(len(k)), k[:, None]
        parts = np.where(np.arange(width) <= at, parts[:, :-1], parts[:, 1:])
        parts[row, k] = lowest
        ranked = np.where(np.arange(width - 1) < at, ranked[:, :-1], ranked[:, 1:])
        for first, some in ((k - 1, k > 0), (k, k < width - 1)):
            i, j = row[some], first[some]
            ranked[i, j] = ranks(parts[i, j], parts[i, j + 1])


def _long_parts(rank: dict[bytes, int], piece: bytes) -> list[int]:
    """The ids of a piece of any length."""
    n = len(piece)
    before, after = array("q", range(-1, n)), array("q", range(1, n + 2))  # the boundaries beside each boundary
    waiting = [rank[piece[k : k + 2]] * n + k for k in range(n - 1) if piece[k : k + 2] in rank]
    heapify(waiting)
    while waiting:
        lowest, a = divmod(heappop(waiting), n)
        if (b := after[a]) >= n or rank.get(piece[a : after[b]]) != lowest:
            continue  # what began here has been joined to something else
        c = after[a] = after[b]
        before[c], after[b] = a, n + 1  # no part begins at b any more
        if a and (r := rank.get(piece[before[a] : c])) is not None:
            heappush(waiting, r * n + before[a])
        if c < n and (r := rank.get(piece[a : after[c]])) is not None:
            heappush(waiting, r * n + a)
    ids, a = [], 0
    while a < n:
        ids.append(rank[piece[a : after[a]]])
        a = after[a]
    return ids


class PieceIds(dict):
    """32-bit ids of pieces, little-endian as the machines are; the items are the pieces met so far."""

    def __init__(self, tokens: list[bytes], frequent: dict[str, bytes]):
        super().__init__(frequent)
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.bytes = np.array([self.rank.get(bytes([k]), 0) for k in range(256)], np.int32)
        self.pairs = pair_ranks(tuple(tokens))
        self.frequent, self.held = frequent, 0

    def merged(self, distinct: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Distinct pieces with their ids."""
        rest = defaultdict(list)
        for piece in distinct:
            held = piece.encode()
            if (whole := self.rank.get(held)) is not None:
                yield piece, whole.to_bytes(4, "little")
            elif len(held) <= SHORT:
                rest[len(held)].append((piece, held))
            else:
                yield piece, array("I", _long_parts(self.rank, held)).tobytes()
        for n, equal in rest.items():
            parts = self.bytes[np.frombuffer(b"".join([held for _, held in equal]), np.uint8).reshape(-1, n)]
            for places, found in _short_parts(self.pairs, len(self.rank), parts):
                held, size = found.astype("<u4").tobytes(), 4 * found.shape[1]
                for k, place in enumerate(places.tolist()):
                    yield equal[place][0], held[k * size : k * size + size]

    def of_texts(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts, given by their pieces."""
        if self.held > MEMO_BYTES:
            self.clear()
            self.update(self.frequent)
            self.held = 0
        new = dict(self.merged(set().union(*texts).difference(self)))
        self.update(new)
        self.held += sum(map(len, new)) + sum(map(len, new.values())) + _ENTRY * len(new)
        return [b"".join(map(self.__getitem__, text)) for text in texts]


def _encoded(ranks: Ranks, text: Column, frequent=None) -> Column:
    """The ids of a text: of each word from the broadcast table of frequent ones, or merged."""
    tokens = ranks.tokens

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = PieceIds(tokens, frequent.value if frequent else {})
        for texts in batches:
            some, size = [], 0
            for k, text in enumerate(texts, 1):
                some.append(pieces(text.as_py() or ""))
                size += len(some[-1])
                if size > TOGETHER or k == len(texts):
                    coded = known.of_texts(some)
                    ends = np.cumsum([0, *[len(ids) // 4 for ids in coded]])
                    yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                    some, size = [], 0

    return encode(text)


def untrained(ranks: Ranks) -> list[int]:
    """Tokens that the merges below their own rank do not reduce to two parts."""
    index = {t: k for k, t in enumerate(ranks.tokens)}
    none = len(index)
    wrong = []
    for rank, token in enumerate(ranks.tokens):
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            lowest, k = min((index.get(parts[k] + parts[k + 1], none), k) for k in range(len(parts) - 1))
            if lowest >= rank:
                wrong.append(rank)
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return wrong


def frequent_words(docs: DataFrame, ranks: Ranks, text: str = "text", most: int = MEMO_BYTES) -> dict[str, bytes]:
    """The most frequent words and their ids: at most ``most`` bytes.

    All texts are counted. Words are taken by the eighth of a power of two of their count, the
    greatest first, while the bytes they could need at most are within ``most``.
    """
    found = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(COUNTED), F.lit(0))).alias("word"))
    counted = stage(found.groupBy("word").agg(F.floor(F.log2(F.count("*")) * 8).cast("int").alias("level")), "words")
    usable = counted.where(F.octet_length("word") <= MEMO_WORD)
    sizes = usable.groupBy("level").agg(F.sum(F.octet_length("word") * 5 + _ENTRY).alias("bytes")).collect()  # some hundred levels
    lowest, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["bytes"]
        if total > most:
            break
        lowest = row["level"]
    if lowest is None:
        return {}
    coded = usable.where(F.col("level") >= lowest).select("word", ranks.little_endian(_encoded(ranks, F.col("word"))).alias("ids"))
    return {row["word"]: bytes(row["ids"]) for row in coded.collect()}


def encode_texts(docs: DataFrame, ranks: Ranks, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each text as ``out``."""
    if wrong := untrained(ranks):
        raise ValueError(f"the ranks are not those of trained byte pairs, see {wrong[:3]}")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_words(docs.select(text), ranks, text))
    return add_columns(docs, F.struct(_encoded(ranks, F.col(text), frequent).alias(out)), [out])


def decode_ids(df: DataFrame, ranks: Ranks, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of each row's ids as ``out``."""
    return add_columns(df, F.struct(ranks.bytes_of(F.col(ids)).alias(out)), [out])
