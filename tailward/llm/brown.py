"""Scoring text with a class-based bigram model: words belong to classes found by exchange clustering.

Tokens are a text's words, A-Z lower-cased, and an end. Every token is counted, in Spark,
over all texts the model learns from, and every learned word's own neighbours choose its class.
The ``units`` most frequent words are units; the others are, to begin with, one unit for
each shape (length, signs, digits, letters beyond a-z). Bigrams of units are counted over the
same texts, and exchange clustering moves units between classes while that raises the
likelihood of the class bigrams. Then the classes before and after every other word are
counted, and each leaves its shape's class for the one in which it raises that likelihood
most; all of them move once and at the same time, however rare. Only a word that was never
learned has the class of its shape. The class bigrams of the model are counted anew over the
final classes. A text's score is the sum over its tokens of

    log10 P(class | class before) + log10 P(token | class)

where the transition is interpolated with the class's share and the emission is
(c + 0.1) / (T + 0.1 (V + 1)): c the token's count, T and V the class's tokens and
distinct tokens, so unseen tokens of every class have a probability.

Counts and classes of the ``known`` most frequent words travel with the tasks; every other
word of a text is looked up by a join with the table of words, so all counts and classes are
exact and the tables grow with the corpus, not the driver.

Null text counts as empty and consists of its end. Without texts to learn from every
probability is that of an unseen token. Rows are scored one by one; repeated rows and
rows with null or equal ids are kept apart. Other columns pass through, and result columns
replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailward.session import stage

from .columns import packed, unpacked
from .flat import flat, slices

END = b"\n"  # no word holds white space
SHAPES = 32
SMOOTH = 0.1
RUN_BYTES = 1 << 21
BYTES = np.arange(256)
LETTER = ((BYTES | 32) >= 97) & ((BYTES | 32) <= 122) & (BYTES < 128)
LOWER = np.where(LETTER, BYTES | 32, BYTES).astype(np.uint8)
BLANK = np.isin(BYTES, list(b" \t\n\r\x0b\f"))
EDGE = np.isin(BYTES, list(b".,;:!?"))
PLAIN_END = LETTER | ((BYTES >= 48) & (BYTES <= 57)) | (BYTES >= 128)


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Runs of rows, each with its first row, the row after its last, tokens of each row, their places in the run's
    distinct words, and these words, of which the end is the last. Words are A-Z lower-cased and split at ASCII white space."""
    data, at = flat(texts)
    for first, last in slices(at, RUN_BYTES):
        part = LOWER[data[at[first] : at[last]]]
        rows = at[first : last + 1] - at[first]
        solid = ~BLANK[part]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        edges = rows[rows < len(part)]
        opens[edges] = solid[edges]  # no word goes on from row to row
        begins = np.flatnonzero(opens)
        through = np.concatenate([[0], np.cumsum(solid, dtype=np.int32)])
        offsets = through[np.append(begins, len(part))].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(part[solid])]).dictionary_encode()
        sizes = np.diff(np.searchsorted(begins, rows)) + 1
        codes = np.full(sizes.sum(), len(words.dictionary))
        inner = np.ones(len(codes), bool)
        inner[sizes.cumsum() - 1] = False
        codes[inner] = words.indices.to_numpy()
        yield first, last, sizes, codes, pa.concat_arrays([words.dictionary, pa.array([END], pa.binary())])


def before(codes: np.ndarray, end: int) -> np.ndarray:
    """The token before each; a row's first comes after an end."""
    return np.concatenate([[end], codes[:-1]])


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of binary values without null, and the offset where each begins and the last ends."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def shapes(words: pa.Array) -> np.ndarray:
    """A number below ``SHAPES`` for how each word looks: its length, a sign at its end, bytes beyond ASCII, and whether
    it is letters only but for signs around them."""
    if not len(words):
        return np.zeros(0, np.int64)
    data, at = flat_bytes(words)
    starts, size, place = at[:-1], np.diff(at), np.arange(len(data))
    letter = LETTER[data]
    letters, edges = np.add.reduceat(letter.astype(np.int64), starts), np.add.reduceat(EDGE[data].astype(np.int64), starts)
    reach = np.maximum.reduceat(np.where(letter, place, -1), starts) - np.minimum.reduceat(np.where(letter, place, len(data)), starts) + 1
    other = np.logical_or.reduceat(data >= 128, starts)
    plain = other | ((letters > 0) & (reach == letters) & (letters + edges == size))
    return np.minimum(size // 4, 3) * 8 + ~PLAIN_END[data[at[1:] - 1]] * 4 + other * 2 + ~plain


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word stands in ``among``, -1 if it does not."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy().astype(np.int64)


def units_of(words: pa.Array, frequent: pa.Array) -> np.ndarray:
    """The unit of each word: its place among the frequent ones, or behind these its shape."""
    at = places(words, frequent)
    return np.where(at < 0, len(frequent) + shapes(words), at)


def count_tokens(docs: DataFrame, text: str = "text", most: int = 200_000) -> DataFrame:
    """(word, n) over all texts, the end included; tasks add up until they hold over ``most`` words, then hand them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = [pa.array([], pa.binary())], [np.zeros(0, np.int64)]

        def add_up() -> None:
            words = pa.concat_arrays(held).dictionary_encode()
            n = np.bincount(words.indices.to_numpy(), weights=np.concatenate(times), minlength=len(words.dictionary))
            held[:], times[:] = [words.dictionary], [n.astype(np.int64)]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([held[0], pa.array(times[0])], ["word", "n"])
            held[:], times[:] = [held[0][:0]], [times[0][:0]]
            return batch

        for batch in batches:
            for *_, codes, words in tokens(batch.column(0)):
                held.append(words)
                times.append(np.bincount(codes, minlength=len(words)))
                if sum(map(len, held)) > 3 * most:
                    add_up()
                    if len(held[0]) > most:
                        yield out()
        add_up()
        if len(held[0]):
            yield out()

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def added_pairs(pairs: DataFrame, size: int) -> np.ndarray:
    """The sum of counts (pair, n) of ``size`` times ``size`` pairs."""
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def pair_batch(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def count_bigrams(docs: DataFrame, frequent: pa.Array, text: str = "text") -> np.ndarray:
    """Bigrams of units over all texts; the driver gets at most the square of their number."""
    size = len(frequent) + SHAPES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for *_, codes, words in tokens(batch.column(0)):
                unit = units_of(words, frequent)
                pair, n = np.unique(unit[before(codes, len(words) - 1)] * size + unit[codes], return_counts=True)
                total[pair] += n
        yield pair_batch(total)

    return added_pairs(docs.select(F.col(text).cast("string")).mapInArrow(count, "pair bigint, n bigint"), size)


def exchange_clusters(bigrams: np.ndarray, classes: int, rounds: int = 4) -> np.ndarray:
    """Class of each unit: units move to the class that most raises the likelihood of the class bigrams, until none gains."""
    n = len(bigrams)
    b = bigrams.astype(float)
    order = np.argsort(-(b.sum(axis=0) + b.sum(axis=1)), kind="stable")
    cls = np.empty(n, int)
    cls[order] = np.arange(n) % classes

    def h(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    member = np.eye(classes)[cls]
    pairs = member.T @ b @ member
    for _ in range(rounds):
        moved = 0
        for w in order:
            old = cls[w]
            to, fro, own = member.T @ b[w], member.T @ b[:, w], b[w, w]  # to classes, from classes, with itself
            if not to.sum() and not fro.sum():
                continue
            to, fro = to.copy(), fro.copy()
            to[old] -= own
            fro[old] -= own
            rest = pairs.copy()
            rest[old] -= to
            rest[:, old] -= fro
            rest[old, old] -= own
            left, right = rest.sum(axis=1) + fro, rest.sum(axis=0) + to
            out_total, in_total = to.sum() + own, fro.sum() + own
            # what changes when w joins class g: row g, column g, their crossing, and the totals of g
            row = (h(rest + to[None, :]) - h(rest)).sum(axis=1)
            column = (h(rest + fro[:, None]) - h(rest)).sum(axis=0)
            d = np.diag(rest)
            crossing = h(d + to + fro + own) - h(d + to) - h(d + fro) + h(d)
            totals = h(left + out_total) - h(left) + h(right + in_total) - h(right)
            gain = row + column + crossing - totals
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            rest[new] += to
            rest[:, new] += fro
            rest[new, new] += own
            pairs = rest
            if new != old:
                member[w, old], member[w, new] = 0, 1
                cls[w] = new
                moved += 1
        if moved <= n // 200:
            break
    return cls


def best_classes(pairs: np.ndarray, to: np.ndarray, fro: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Where each of many words raises the likelihood of the class bigrams most, if it alone leaves its class ``old``.

    ``pairs`` are the class bigrams with all words in their old classes, ``to`` and ``fro`` a row of each word's bigrams
    to and from classes without those with itself, which are ``own``. As in ``exchange_clusters``, but only the
    classes that a word meets are looked at, of which a rare word has few."""
    rows, p, each = np.arange(len(old)), pairs.astype(float), np.arange(pairs.shape[0])

    def added(x, n):
        """(x + n) log(x + n) - x log x, of whole numbers."""
        return n * np.log(np.maximum(x + n, 1)) + x * np.log1p(n / np.maximum(x, 1))

    def raised(p: np.ndarray, there: np.ndarray, back: np.ndarray) -> np.ndarray:
        """What bigrams with other classes gain, for each word and class it may join."""
        i, c = np.nonzero(there)
        n, at, o = there[i, c], np.arange(len(i)), old[i]
        most = int(n.max(initial=0)) + 1
        kinds, kind = np.unique(c * most + n.astype(np.int64), return_inverse=True)
        met, much = np.divmod(kinds, most)
        gain = added(p[:, met], much).T[kind]
        gain[at, o] = added(np.maximum(p[o, c] - n, 0), n)  # the word is counted there
        same = c == o  # bigrams with the old class, which no longer holds the word
        rest = p[:, o[same]].T - back[i[same]]
        rest[np.arange(len(rest)), o[same]] = 0
        gain[same] = added(rest, n[same, None])
        gain[at, c] = 0  # bigrams within the joined class: below
        out = np.zeros(there.shape)
        first = np.flatnonzero(np.diff(i, prepend=-1))
        if len(i):
            out[i[first]] = np.add.reduceat(gain, first, axis=0)
        return out

    inside = to + fro + own[:, None]
    rest = np.repeat(p[each, each][None], len(old), 0)
    rest[rows, old] -= inside[rows, old]
    gain = raised(p, to, fro) + raised(p.T, fro, to) + added(rest, inside)
    for total, n in ((p.sum(axis=1), to.sum(axis=1) + own), (p.sum(axis=0), fro.sum(axis=1) + own)):
        rest = np.repeat(total[None], len(old), 0)
        rest[rows, old] -= n
        gain -= added(rest, n[:, None])
    new = gain.argmax(axis=1)
    return np.where(gain[rows, new] <= gain[rows, old] + 1e-9, old, new)


def class_words(docs: DataFrame, frequent: pa.Array, cls: np.ndarray, bigrams: np.ndarray, classes: int, text: str = "text", most: int = 1 << 20) -> DataFrame:
    """(word, n, class) of every word of the texts that is no unit of its own: the class in which it raises the likelihood of
    the class bigrams most. Tasks add up at most about ``most`` counts before they hand them on."""
    width = 2 * classes + 1  # of a word: the classes after it, those before it, and itself
    member = np.eye(classes)[cls]
    pairs = member.T @ bigrams @ member

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, times = [], [], []

        def out() -> pa.RecordBatch:
            words = pa.concat_arrays(held).dictionary_encode()
            word, what = np.divmod(np.concatenate(keys), width)
            key, at = np.unique(words.indices.to_numpy().astype(np.int64)[word] * width + what, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(times)).astype(np.int64)
            starts = np.searchsorted(key, np.arange(len(words.dictionary) + 1) * width)
            batch = pa.RecordBatch.from_arrays([words.dictionary, pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(n * width + key % width))], ["word", "counts"])
            for x in (held, keys, times):
                x.clear()
            return batch

        for batch in batches:
            for *_, codes, words in tokens(batch.column(0)):
                unit, last = units_of(words, frequent), before(codes, len(words) - 1)
                klass, rare = cls[unit], unit >= len(frequent)
                if not rare.any():
                    continue
                word = np.where(rare, rare.cumsum() - 1 + sum(map(len, held)), -1) * width
                here, there = word[codes], word[last]
                kinds = (there + klass[codes])[there >= 0], (here + classes + klass[last])[here >= 0], (here + 2 * classes)[(here >= 0) & (codes == last)]
                key, n = np.unique(np.concatenate(kinds), return_counts=True)
                held.append(words.filter(pa.array(rare)))
                keys.append(key)
                times.append(n)
                if sum(map(len, keys)) > most:
                    yield out()
        if held:
            yield out()

    def assign(words: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        old, rows = cls[len(frequent) + shapes(words)], np.arange(len(words))
        to, fro, own = total[:, :classes].copy(), total[:, classes:-1].copy(), total[:, -1]
        n = fro.sum(axis=1)
        to[rows, old] -= own
        fro[rows, old] -= own
        new = np.concatenate([best_classes(pairs, to[k : k + 2000], fro[k : k + 2000], own[k : k + 2000], old[k : k + 2000]) for k in range(0, len(rows), 2000)])
        return pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), pa.array(new, pa.int32())], ["word", "n", "class"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up what follows each other of one word, also over the end of a batch."""
        word, sums = pa.array([], pa.binary()), np.zeros((0, width))  # the last word so far
        for batch in batches:
            if not batch.num_rows:
                continue
            all_words = pa.concat_arrays([word, batch.column(0).cast(pa.binary())]).dictionary_encode()
            at = all_words.indices.to_numpy().astype(np.int64)
            n, what = np.divmod(batch.column(1).flatten().to_numpy(), width)
            row = np.repeat(at[len(word) :], batch.column(1).value_lengths().to_numpy())
            total = np.bincount(row * width + what, weights=n, minlength=len(all_words.dictionary) * width).reshape(-1, width)
            total[: len(word)] += sums
            if len(total) > 1:
                yield assign(all_words.dictionary[:-1], total[:-1])
            word, sums = all_words.dictionary[-1:], total[-1:]
        if len(word):
            yield assign(word, sums)

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "word binary, counts array<bigint>")
    return counted.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word binary, n bigint, class int")


def trace_pairs(traces: DataFrame, classes: int, end: int) -> np.ndarray:
    """Class bigrams of the rows' classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            trace, at = read_traces(batch.column(0), classes)
            if len(trace):
                total += np.bincount(trace_steps(trace, at, end, classes), minlength=len(total))
        yield pair_batch(total)

    return added_pairs(traces.mapInArrow(count, "pair bigint, n bigint"), classes)


def trace_type(classes: int) -> np.dtype:
    """Traces have numbers below twice the classes."""
    return np.min_scalar_type(2 * classes)


def read_traces(traces: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray]:
    data, at = flat_bytes(traces)
    kind = trace_type(classes)
    return data.view(kind).astype(np.int64), at // kind.itemsize


def write_traces(trace: np.ndarray, at: np.ndarray, classes: int) -> pa.Array:
    kind = trace_type(classes)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * kind.itemsize).astype(np.int32)), pa.py_buffer(trace.astype(kind))])


def trace_steps(trace: np.ndarray, at: np.ndarray, end: int, classes: int) -> np.ndarray:
    """The number of the class bigram that ends at each token; every row begins after an end."""
    last = before(trace, end)
    last[at[:-1]] = end
    return last * classes + trace


def score_texts(docs: DataFrame, learn: Column, text: str = "text", units: int = 1000, classes: int = 32, known: int = 150_000, keep: list[str] | None = None) -> DataFrame:
    """Add to each row: ``n_tokens``, ``n_known`` (tokens that were learned), ``train_tokens``, ``base_score`` (log10 by single
    tokens with the same smoothing), ``score`` and ``perplexity``. The model learns from the rows where ``learn`` holds.
    Of the other columns those in ``keep`` pass through, all if it is not given; what passes is written once."""
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    training = docs.where(learn)
    top = count_tokens(training, text).orderBy(F.col("n").desc(), "word").limit(units).toArrow()
    frequent, n = top["word"].combine_chunks().cast(pa.binary()), top["n"].to_numpy()
    bigrams = count_bigrams(training, frequent, text)
    cls = exchange_clusters(bigrams, classes)
    table = stage(class_words(training, frequent, cls, bigrams, classes, text), "words")

    # tokens and distinct tokens of each class, over all words
    held, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    np.add.at(held, cls[: len(frequent)], n)
    np.add.at(kinds, cls[: len(frequent)], 1)
    for r in table.groupBy("class").agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect():
        held[r["class"]] += r["t"]
        kinds[r["class"]] += r["v"]
    train_tokens = int(held.sum())
    below = held + SMOOTH * (kinds + 1)
    base_below = math.log10(train_tokens + SMOOTH * (int(kinds.sum()) + 1))
    more = table.orderBy(F.col("n").desc(), "word").limit(max(0, known - len(frequent))).toArrow()
    end = pa.array([END], pa.binary())
    if END not in frequent.to_pylist() and END not in more["word"].to_pylist():
        more = pa.concat_tables([more, table.where(F.col("word") == F.lit(END)).toArrow()])
    index = pa.concat_arrays([frequent, more["word"].combine_chunks().cast(pa.binary())])
    word_class = np.concatenate([cls[: len(frequent)], more["class"].to_numpy()])
    log_n = np.log10(np.concatenate([n, more["n"].to_numpy()]) + SMOOTH)
    shape_class = cls[len(frequent) :]
    end_at = places(end, index)[0]
    end_class = int(shape_class[shapes(end)[0]] if end_at < 0 else word_class[end_at])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's classes; for a word that does not travel its shape's class, plus ``classes``, and which of the text's rare words it is."""
        for whole in batches:
            for first, last, sizes, codes, words in tokens(whole.column(2)):
                at = np.concatenate([[0], sizes.cumsum()])
                found = places(words, index)
                there, klass, log = found >= 0, shape_class[shapes(words)] + classes, np.zeros(len(words))
                klass[there], log[there] = word_class[found[there]], log_n[found[there]]
                row = np.repeat(np.arange(len(sizes)), sizes)
                holes = np.flatnonzero(~there[codes])
                rare, which, times = np.unique(row[holes] * len(words) + codes[holes], return_inverse=True, return_counts=True)
                rare_at = np.searchsorted(rare, np.arange(len(sizes) + 1) * len(words))
                hole_at = np.searchsorted(row[holes], np.arange(len(sizes) + 1))
                of_row = (which - rare_at[row[holes]]).astype(np.int32)
                batch = whole.select([0, 1]).take(pa.array(np.arange(first, last)))
                arrays = [batch.column(0), batch.column(1), pa.array(sizes), pa.array(np.add.reduceat(there[codes].astype(np.int64), at[:-1]))]
                arrays += [pa.array(np.add.reduceat(log[codes], at[:-1])), write_traces(klass[codes], at, classes)]
                arrays += [pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((hole_at * 4).astype(np.int32)), pa.py_buffer(of_row)])]
                arrays += [pa.ListArray.from_arrays(rare_at.astype(np.int32), words.take(pa.array(rare % len(words))))]
                arrays += [pa.ListArray.from_arrays(rare_at.astype(np.int32), pa.array(times))]
                yield pa.RecordBatch.from_arrays(arrays, [n.split(" ")[0] for n in columns])

    columns = ["_learn boolean", "_row", "_tokens bigint", "_seen bigint", "_counted double", "_trace binary", "_which binary", "_rare array<binary>", "_times array<bigint>"]
    dropped = [c for c in docs.columns if keep is not None and c not in keep]
    kept = docs.select(F.coalesce(learn, F.lit(False)).alias("_learn"), packed(docs, *names, *dropped), F.col(text).cast("string").alias("_text"))
    columns[1] += f" {kept.schema['_row'].dataType.simpleString()}"
    # written, so that the number of a row stays its own
    parts = stage(kept.mapInArrow(read, ", ".join(columns)).withColumn("_number", F.monotonically_increasing_id()), "texts")
    # all that is looked up beyond the words the tasks know; "_code" also says which of the row's rare words it is
    rare = parts.select("_number", F.posexplode(F.arrays_zip("_rare", "_times")).alias("_k", "_x")).select("_number", "_k", F.col("_x._rare").alias("word"), F.col("_x._times").alias("times"))
    code = F.col("_k").cast("bigint") * classes + F.col("class")
    gained = F.col("times") * F.log10((F.col("n") + SMOOTH) / SMOOTH)
    found = rare.join(table, "word").groupBy("_number").agg(F.sum("times").alias("_known"), F.sum(gained).alias("_gain"), F.collect_list(code).alias("_codes"))

    @F.arrow_udf("binary")
    def filled(traces: pa.Array, which: pa.Array, n_rare: pa.Array, codes: pa.Array) -> pa.Array:
        """Traces in which every learned word has its own class."""
        trace, at = read_traces(traces, classes)
        rare_at = np.concatenate([[0], n_rare.to_numpy().cumsum()])
        klass = np.full(rare_at[-1], -1)
        k, c = np.divmod(codes.flatten().to_numpy(), classes)
        klass[np.repeat(rare_at[:-1], codes.value_lengths().to_numpy()) + k] = c
        holes = np.flatnonzero(trace >= classes)
        row = np.searchsorted(at, holes, "right") - 1
        got = klass[rare_at[row] + flat_bytes(which)[0].view(np.int32)]
        trace[holes] = np.where(got < 0, trace[holes] - classes, got)
        return write_traces(trace, at, classes)

    traces = parts.select("_number", "_learn", "_tokens", "_seen", "_counted", "_trace", "_which", F.size("_rare").alias("_n")).join(found, "_number", "left")
    gain = F.col("_counted") + F.coalesce("_gain", F.lit(0.0)) + (F.col("_tokens") - F.col("_seen")) * math.log10(SMOOTH)
    traces = stage(
        traces.select(
            "_number",
            "_learn",
            "_tokens",
            (F.col("_seen") + F.coalesce("_known", F.lit(0))).alias("_known"),
            gain.alias("_gain"),
            filled("_trace", "_which", "_n", F.coalesce("_codes", F.array().cast("array<bigint>"))).alias("_trace"),
        ),
        "traces",
    )

    pairs = trace_pairs(traces.where("_learn").select("_trace"), classes, end_class)
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + classes)
    steps = np.log10((pairs + 20 * share) / (pairs.sum(axis=1, keepdims=True) + 20)) - np.log10(below)

    @F.arrow_udf("double")
    def fixed(traces: pa.Array) -> pa.Array:
        trace, at = read_traces(traces, classes)
        return pa.array(np.add.reduceat(steps.ravel()[trace_steps(trace, at, end_class, classes)], at[:-1]) if len(trace) else [], pa.float64())

    joined = parts.select("_number", "_row").join(traces.withColumn("_fixed", fixed("_trace")).drop("_trace"), "_number")
    score = F.col("_fixed") + F.col("_gain")
    return joined.select(
        *unpacked(joined),
        F.col("_tokens").alias("n_tokens"),
        F.col("_known").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("_gain") - F.col("_tokens") * base_below).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("_tokens")).alias("perplexity"),
    )
