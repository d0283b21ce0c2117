"""Benchmark items in documents, also with other numbers, names or units.

Text is made canonical: a number becomes one placeholder, a unit after a number another,
and a capitalised word a third, as names also begin sentences; other words are lower-cased. Items of
equal canonical text form a template, which its smallest item stands for: of many
re-parameterised variants each document meets one. An item with fewer than ``plain`` words
that are no placeholder (in all of its words, if it is shorter) says too little for that:
it is a template of its own, of its words as they are, in lower case.

Hash joins find where a document and a template may agree: each run of ``width`` canonical
words of which ``plain`` are no placeholder, each run of ``plain`` such words that
placeholders stretch beyond ``width``, each run of ``width`` words as they are where some
item needs that, and the whole of each item of fewer words. All words are then compared
along the diagonal found; there a name's place in an item takes a word in lower case too, and a
capitalised word equals the same word of an item in lower case. Where a document holds ``least`` words of a template in a row (or
all of a shorter one), the slots of the passage are compared: an item's value must always
be filled with the same value in it. Items of a template may differ in which of their slots
are equal, so slots are compared with each such pattern that occurs. If at least
``consistent`` of the slots agree with one of them, the document is contaminated.

Everything is built-in SQL functions. Null or empty texts and items have no words.
Repeated rows of a document count as one in the result, and likewise repeated items.
Results carry ids and figures only, so other columns and their names do not matter. Rows
with a null id take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailward.session import stage

from .columns import broadcast_if_small, let

# Units that may follow a number.
UNITS = """
km m cm mm mi mile miles ft foot feet inch inches yd yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes
l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
km/h mph m/s hz khz mhz ghz w kw mw j kj v a ohm pa kpa bar k kb mb gb tb percent degrees euro euros dollar dollars cent cents usd eur gbp
""".split()
# Marks put before a name and before a unit; neither stands in ordinary text.
_NAME, _UNIT = "\x01", "\x02"
_MARKS = _NAME + _UNIT
_WINDOWS = "array<struct<at:int,window:bigint>>"
_WORD = rf"[{_MARKS}]?[\p{{L}}\p{{M}}]+|\p{{N}}+(?:[.,]\p{{N}}+)*"


def _marked(text: Column) -> Column:
    """The text's words with marks before names and units."""
    clean = F.translate(F.coalesce(text.cast("string"), F.lit("")), _MARKS, "  ")
    named = F.regexp_replace(clean, r"(?<![\p{L}\p{M}\p{N}])(?=\p{Lu}\p{Ll})", _NAME)
    units = "|".join(sorted((u for u in UNITS if u.isalpha()), key=len, reverse=True))
    return F.regexp_replace(named, rf"(?<=\p{{N}}) ?(?=(?i:{units})(?![\p{{L}}\p{{N}}]))", " " + _UNIT)


def _raw_words(text: Column) -> Column:
    return F.regexp_extract_all(_marked(text), F.lit(_WORD), F.lit(0))


def _canonical(text: Column) -> Column:
    """Canonical words; a placeholder is a mark or, for a number, ``0``."""
    plain = F.regexp_replace(_marked(text), rf"(?<=[{_MARKS}])[\p{{L}}\p{{M}}]+", "x")
    plain = F.regexp_replace(plain, r"\p{N}+(?:[.,]\p{N}+)*", "0")
    return F.regexp_extract_all(F.lower(plain), F.lit(_WORD), F.lit(0))


def _is_slot(word: Column) -> Column:
    return (word == "0") | word.startswith(_NAME) | word.startswith(_UNIT)


def _values(text: Column) -> Column:
    """The words as they are, in lower case; each stands where its canonical word does."""
    return F.transform(_raw_words(text), lambda w: F.lower(F.translate(w, _MARKS, "")))


def _runs(hashes: Column, width: int) -> Column:
    """(at, window) of each run of ``width`` words."""
    at = F.sequence(F.lit(0), F.size(hashes) - width)
    each = F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]).alias("window")))
    return F.when(F.size(hashes) >= width, each).otherwise(F.array().cast(_WINDOWS))


def _stretched(words: Column, hashes: Column, width: int, plain: int) -> Column:
    """(at, window) of each run from one word that is no placeholder to the ``plain``-th such word, if that is longer than ``width``."""

    def spans(places: Column) -> Column:
        each = F.transform(places, lambda p, k: F.struct(p.alias("at"), (F.get(places, k + plain - 1) - p + 1).alias("n")))
        return F.transform(F.filter(each, lambda x: x["n"] > width), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(F.slice(hashes, x["at"] + 1, x["n"])).alias("window")))

    return let(F.filter(F.transform(words, lambda w, i: F.when(~_is_slot(w), i)), lambda i: i.isNotNull()), spans)


def _templates(benchmark: DataFrame, text: str, key: str, plain: int) -> DataFrame:
    """Each template's ``item_id``, ``verbatim`` (of words as they are), ``words``, and ``patterns``: per slot its ``place``, and as ``value`` the number of the first slot filled alike."""

    def formed(x: Column) -> Column:
        said = F.size(F.filter(x["words"], lambda w: ~_is_slot(w)))
        verbatim = said < F.least(F.lit(plain), F.size(x["words"]))
        places = F.filter(F.transform(x["words"], lambda w, i: F.when(_is_slot(w), i)), lambda i: i.isNotNull())

        def numbered(at: Column) -> Column:
            values = F.transform(at, lambda i: F.get(x["values"], i))
            return let(values, lambda v: F.transform(at, lambda i, k: F.struct(i.alias("place"), F.array_position(v, F.get(v, k)).alias("value"))))

        return F.struct(verbatim.alias("verbatim"), F.when(verbatim, x["values"]).otherwise(x["words"]).alias("words"), F.when(~verbatim, let(places, numbered)).alias("pattern"))

    held = F.struct(_canonical(F.col(text)).alias("words"), _values(F.col(text)).alias("values"))
    each = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), let(held, formed).alias("_found"))
    each = each.select("id", "_found.*").where(F.size("words") > 0)
    return each.groupBy("verbatim", "words").agg(F.min("id").alias("item_id"), F.collect_set("pattern").alias("patterns"))


def _agreeing(pairs: Column) -> Column:
    """The share of (number, value) pairs that have their number's commonest value."""

    def step(acc: Column, p: Column) -> Column:
        same = p["number"].eqNullSafe(acc["number"])
        n = F.when(same & p["value"].eqNullSafe(acc["value"]), acc["n"] + 1).otherwise(1)
        return F.struct(
            p["number"].alias("number"),
            p["value"].alias("value"),
            n.alias("n"),
            F.when(same, F.greatest(acc["most"], n)).otherwise(n).alias("most"),
            F.when(same, acc["sum"]).otherwise(acc["sum"] + acc["most"]).alias("sum"),
        )

    start = F.struct(F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("string").alias("value"), *[F.lit(0).alias(n) for n in ("n", "most", "sum")])
    return F.aggregate(F.array_sort(pairs), start, step, lambda acc: (acc["sum"] + acc["most"]).cast("double")) / F.size(pairs)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    width: int = 8,
    plain: int = 5,
    least: int = 13,
    consistent: float = 0.8,
) -> DataFrame:
    """One row per contaminated document and template: ``doc_id``, ``item_id`` (the template's smallest item), ``words`` in a row,
    ``item_words``, ``slots`` compared, and ``agreeing``, the share of them that fill equal values of the best fitting item alike."""
    telling = min(plain, width)
    templates = _templates(benchmark, item_text, item_key, telling).withColumn("item_words", F.size("words"))
    templates = stage(templates.withColumn("template", F.xxhash64("verbatim", "words")), "templates")

    # windows by kind: runs of canonical words, stretched ones, and runs of words as they are; each with the length that is hashed
    def windows_of(x: Column) -> Column:
        long, short = F.size("words") >= width, F.struct(F.lit(0).alias("at"), F.xxhash64(x).alias("window"))
        told = F.filter(_runs(x, width), lambda r: F.size(F.filter(F.slice("words", r["at"] + 1, width), lambda w: ~_is_slot(w))) >= telling)
        run = F.when(~long, F.array(short)).when(F.col("verbatim"), _runs(x, width)).otherwise(told)
        wide = F.when(~F.col("verbatim") & long, _stretched(F.col("words"), x, width, telling)).otherwise(F.array().cast(_WINDOWS))

        def marked(found: Column, is_wide: bool) -> Column:
            return F.transform(found, lambda r: F.struct(F.lit(is_wide).alias("wide"), r["at"].alias("at"), r["window"].alias("window")))

        return F.concat(marked(run, False), marked(wide, True))

    each = templates.select("template", "item_words", "verbatim", F.explode(let(F.transform("words", lambda w: F.xxhash64(w)), windows_of)).alias("_w"))
    windows = stage(each.select("_w.window", "template", F.col("_w.at").alias("item_at"), "_w.wide", "verbatim", F.least("item_words", F.lit(width)).alias("length")), "template_windows")
    kinds = {(r["wide"], r["verbatim"], r["length"]) for r in windows.select("wide", "verbatim", "length").distinct().collect()}  # at most 2 x width + 1
    windows = broadcast_if_small(windows.select("window", "template", "item_at"), F.lit(32))

    needed = ["words"] + ["values"] * any(raw for _, raw, _ in kinds)

    def hashed(x: Column) -> Column:
        def of(words: Column, verbatim: bool) -> list[Column]:
            lengths = sorted(n for wide, raw, n in kinds if raw == verbatim and not wide)
            wide = not verbatim and any(w for w, *_ in kinds)

            def runs(h: Column) -> Column:
                return F.concat(*[_runs(h, n) for n in lengths], *([_stretched(words, h, width, telling)] if wide else []), F.array().cast(_WINDOWS))

            return [let(F.transform(words, lambda w: F.xxhash64(w)), runs)] if lengths or wide else []

        return F.concat(*of(x["words"], False), *(of(x["values"], True) if "values" in needed else []), F.array().cast(_WINDOWS))

    made = {"words": _canonical(F.col(text)), "values": _values(F.col(text))}
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.explode(let(F.struct(*[made[n].alias(n) for n in needed]), hashed)).alias("_w"))
    runs = known.select("doc_id", F.col("_w.at").alias("at"), F.col("_w.window").alias("window")).join(windows, "window")
    found = stage(runs.select("doc_id", "template", (F.col("at") - F.col("item_at")).alias("ahead")).distinct(), "window_matches")

    # the texts of these documents are read again, and all words along a diagonal compared
    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("_text")).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = wanted.withColumn("copy", F.xxhash64("_text")).dropDuplicates(["doc_id", "copy"])
    wanted = wanted.select("doc_id", "copy", _canonical(F.col("_text")).alias("doc_words"), _values(F.col("_text")).alias("doc_values"))
    compared = broadcast_if_small(templates.select("template", "item_id", "item_words", "verbatim", "words"), F.col("item_words") * 16)
    begin = F.greatest(F.lit(0), -F.col("ahead"))
    size = F.least(F.col("item_words"), F.size("doc_words") - F.col("ahead")) - begin

    def cut(words: str, at: Column) -> Column:
        return F.slice(words, at + 1, F.greatest(size, F.lit(0)))

    there = begin + F.col("ahead")
    aligned = F.struct(F.when(F.col("verbatim"), cut("doc_values", there)).otherwise(cut("doc_words", there)).alias("theirs"), cut("words", begin).alias("ours"), cut("doc_values", there).alias("values"))

    def passage(x: Column) -> Column:
        """The longest run of equal words, and the slots (place, value) in runs of ``width`` words (or of all)."""

        def parts(other: Column) -> Column:
            before = F.concat(F.array(F.lit(-1)), F.slice(other, 1, F.size(other) - 1))
            return F.zip_with(before, other, lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))

        def slots(long: Column) -> Column:
            places = F.filter(F.transform(x["ours"], lambda w, i: F.when(_is_slot(w), i)), lambda i: i.isNotNull())
            held = F.filter(places, lambda i: F.exists(long, lambda r: (r["first"] <= i) & (i <= r["last"])))
            return F.transform(held, lambda i: F.struct((i + begin).alias("place"), F.get(x["values"], i).alias("value")))

        def judged(all_runs: Column) -> Column:
            longest = F.array_max(F.transform(all_runs, lambda r: r["last"] - r["first"] + 1))
            long = F.filter(all_runs, lambda r: r["last"] - r["first"] + 1 >= F.least(F.lit(width), F.col("item_words")))
            enough = longest >= F.least(F.lit(least), F.col("item_words"))
            return F.struct(longest.alias("n"), F.when(enough & ~F.col("verbatim"), let(long, slots)).otherwise(F.array().cast("array<struct<place:int,value:string>>")).alias("slots"))

        ends = F.size(x["ours"])

        def differs(i: Column) -> Column:
            ours, theirs, value = F.get(x["ours"], i), F.get(x["theirs"], i), F.get(x["values"], i)
            cased = (ours == value) | (ours.startswith(_NAME) & ~_is_slot(theirs))  # said with other capitals
            return ~(ours.eqNullSafe(theirs) | F.coalesce(cased, F.lit(False)))

        other = F.filter(F.sequence(F.lit(0), ends), lambda i: (i == ends) | differs(i))
        return let(let(other, parts), judged)

    held = found.join(wanted, "doc_id").join(compared, "template").select("doc_id", "copy", "template", "item_id", "item_words", "ahead", let(aligned, passage).alias("_p"))
    held = held.where(F.col("_p.n") >= F.least(F.lit(least), F.col("item_words")))
    held = stage(held.select("doc_id", "template", "item_id", "item_words", F.col("_p.n").alias("words"), F.col("_p.slots").alias("filled")), "held")

    patterns = templates.select("template", F.explode("patterns").alias("pattern"))
    patterns = broadcast_if_small(stage(patterns, "patterns"), F.size("pattern") * 32)

    def paired(slots: Column, pattern: Column) -> Column:
        """(number, value) of each slot in the passage; both lists are in order of place."""
        number = F.map_from_arrays(F.transform(pattern, lambda p: p["place"]), F.transform(pattern, lambda p: p["value"]))
        return let(number, lambda m: F.transform(slots, lambda s: F.struct(F.element_at(m, s["place"]).alias("number"), s["value"].alias("value"))))

    agreed = held.join(patterns, "template", "left").select(
        "doc_id",
        "item_id",
        F.col("words").cast("bigint").alias("words"),
        F.col("item_words").cast("bigint").alias("item_words"),
        F.size("filled").cast("bigint").alias("slots"),
        F.when(F.size("filled") == 0, 1.0).otherwise(let(paired(F.col("filled"), F.col("pattern")), _agreeing)).alias("agreeing"),
    )
    best = agreed.where(F.col("agreeing") >= consistent).groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "agreeing", "slots", "item_words")).alias("_b"))
    return best.select("doc_id", "item_id", "_b.words", "_b.item_words", "_b.slots", "_b.agreeing")
