"""Fill-in-middle: texts rearranged so that a model learns to fill the gap between two parts.

A text is cut into units, runs of letters A-Z or single other characters, and the cuts fall
between units. A task works on Arrow batches with ``pyarrow.compute`` alone: the texts are
split into lists of units, the lists flattened with the index of their text, each unit's
ordinal says whether it belongs to prefix, middle or suffix, the units of each role are
filtered and put back into lists, joined per text, and the pieces joined in the order of the
text's form. Long batches are worked on in slices of bounded bytes; a longer text is a slice
of its own. No row depends on another, so nothing is shuffled.

Texts are handled as UTF-8 bytes: the byte 0xFF occurs in none and separates the units.
Null text counts as empty. Empty texts and those that hold a marker stay plain, as do the
shares asked for. A null key gives the cuts of an empty one. Repeated rows give equal rows,
an empty table none. Other columns are kept; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import add_columns, packed, quoted, unpacked
from .flat import slices

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_UNIT = rb"([A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*)"  # over the bytes of UTF-8
_END = b"\xff"
_ANY = "|".join((PREFIX, SUFFIX, MIDDLE))
_FIELDS = "form string, n bigint, output string, prefix_chars bigint, middle_chars bigint"
SLICE = 1 << 19  # bytes of text a task works on at a time; a unit takes some sixty bytes besides its own


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), SLICE)


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2**32 from the hash of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _lists(values: pa.Array, sizes: pa.Array) -> pa.ListArray:
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])
    return pa.ListArray.from_arrays(offsets.cast(pa.int32()), values)


def _text(values: pa.Array) -> pa.Array:
    return values.cast(pa.large_string())


def _joined(*parts: pa.Array | str) -> pa.Array:
    """The parts of each row joined; a plain string is the same in each."""
    held = [pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts]
    return pc.binary_join_element_wise(*held, pa.scalar("", pa.large_string()))


def _cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """The number of units of each text, and its prefix, middle and suffix for two draws."""
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), pattern=_UNIT, replacement=rb"\1" + _END)
    units = pc.split_pattern(marked, _END)  # one empty item more than units
    items = pc.list_value_length(units).cast(pa.int64())
    n = pc.subtract(items, 1)
    cuts = [_modulo(h, items) for h in (first, second)]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    parent, flatted = pc.list_parent_indices(units), pc.list_flatten(units)
    begin = pc.subtract(pc.cumulative_sum(items), items)
    ordinal = pc.subtract(pa.array(np.arange(len(flatted))), pc.take(begin, parent))
    after_low = pc.greater_equal(ordinal, pc.take(low, parent))
    after_high = pc.greater_equal(ordinal, pc.take(high, parent))
    roles = [pc.invert(after_low), pc.and_(after_low, pc.invert(after_high)), after_high]
    sizes = [low, pc.subtract(high, low), pc.subtract(items, high)]
    return n, [_text(pc.binary_join(_lists(pc.filter(flatted, role), size), pa.scalar(b"", pa.large_binary()))) for role, size in zip(roles, sizes, strict=True)]


def _transform(texts: pa.Array, h: list[pa.Array], plain_from: int, spm_below: int) -> list[pa.Array]:
    n, (prefix, middle, suffix) = _cut(texts, h[0], h[1])
    stays = pc.or_(pc.equal(n, 0), pc.match_substring_regex(texts, _ANY))
    stays = pc.or_(stays, pc.greater_equal(_modulo(h[2], pa.scalar(100, pa.int64())), plain_from))
    swapped = pc.less(_modulo(h[3], pa.scalar(100, pa.int64())), spm_below)
    form = pc.if_else(stays, PLAIN, pc.if_else(swapped, SPM, PSM))
    psm, spm = _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    output = pc.if_else(stays, texts, pc.if_else(swapped, spm, psm))
    length = [pc.if_else(stays, pa.scalar(None, pa.int64()), pc.utf8_length(part).cast(pa.int64())) for part in (prefix, middle)]
    return [form, n, output, *length]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Add ``form``, ``n`` (units), ``output``, ``prefix_chars`` and ``middle_chars`` (null if plain).

    Of four draws by the key's hash two say where to cut, the third keeps ``100 - plain_from``
    in a hundred texts plain, and ``spm_below`` in a hundred have the suffix first.
    """
    names = ["form", "n", "output", "prefix_chars", "middle_chars"]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = docs.select(packed(docs, *names), F.array(*draws(F.col(key), seed)).alias("_h"), body.alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _slices(batch.column(2)):
                part = batch.take(pa.array(np.arange(first, last)))  # rows of their own: kernels misread the offsets of a slice
                h = [pc.list_element(part.column(1), k) for k in range(4)]
                form, n, output, before, between = _transform(part.column(2).cast(pa.large_string()), h, plain_from, spm_below)
                yield pa.RecordBatch.from_arrays([part.column(0), form, n, output, before, between], ["_row", *names])

    row = held.schema["_row"].dataType.simpleString()
    done = held.mapInArrow(cut, f"_row {row}, {_FIELDS}")
    return done.select(*unpacked(done), *names)


def _restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The text of each output, from its pieces between the markers."""
    output = output.cast(pa.large_string())
    turned = pc.not_equal(form, PLAIN)
    whole = pc.or_kleene(pc.invert(turned), pc.equal(pc.count_substring_regex(output, _ANY), 3))
    output = pc.if_else(whole, output, pa.scalar(None, pa.large_string()))
    turned = pc.fill_null(pc.and_(turned, whole), False)
    pieces = pc.split_pattern_regex(pc.filter(output, turned), _ANY)
    one, two, middle = (pc.list_element(pieces, k) for k in (1, 2, 3))
    first = pc.equal(pc.filter(form, turned), SPM)
    prefix, suffix = pc.if_else(first, two, one), pc.if_else(first, one, two)
    return pc.replace_with_mask(output, turned, _joined(prefix, middle, suffix))


def restore(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """Add the exact text from ``output`` and ``form``; null where either is null or the markers are not all there once."""

    @F.arrow_udf("string")
    def back(whole: pa.Array, kind: pa.Array) -> pa.Array:
        rows = [pa.array(np.arange(a, b)) for a, b in _slices(whole)]
        parts = [_restore(whole.take(at), kind.take(at)).cast(pa.string()) for at in rows]
        return pa.concat_arrays([*parts, pa.array([], pa.string())])

    return add_columns(df, F.struct(back(quoted(output), quoted(form)).alias(out)), [out])
