"""Document fingerprints that tell how much two versions share: invertible Bloom lookup sketches.

A text's paragraphs (lines, cut after every ``WORDS`` words) are hashed; the set of digests
goes into a small table: in each of three sub-tables a digest adds itself to one of
``CELLS`` cells, which keep a count, the digests' xor and the xor of their checks. That table, written out, is the fingerprint. The tables of two versions subtract
cell by cell, what they share cancels, and peeling the cells that hold a single digest
recovers the digests in which they differ. If that fails, as there are more differences than
cells can hold, it is tried again with four times as many cells: the digests of a table that
failed are dealt over four, until every table succeeds.

The likeness of two fingerprints is the number of shared digests over that of all.

Everything is built-in SQL functions inside the row. Null text counts as empty; texts
without words have no digests and are wholly alike. Repeated paragraphs count once. A row
with a null key comes before all others; rows with equal keys follow one another in the
order of their texts. The next document of the last is the first, so a single document
is its own next. Other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let

WORDS = 32
CELLS = 8  # of each sub-table; a power of two
TABLES = 3
ROUNDS = 16
TRIES = 10  # with 1, 4, 16, ... tables
_PIECE = rf"(?:[^\s]+[ \t]+){{0,{WORDS - 1}}}[^\s]+"
_SHIFTS = (0, 21, 42)  # bits of a digest that give its cell in each sub-table; those from 6 on deal it to a table


def digests(text: Column) -> Column:
    """The distinct hashes of the text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1))


def _cell(digest: Column, shift: int) -> Column:
    return F.shiftrightunsigned(digest, shift).bitwiseAND(F.lit(CELLS - 1).cast("bigint"))


def _xor(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseXOR(of(v)))


def sketch(found: Column) -> Column:
    """The table of a set of digests: cells (n, d, c), sub-table after sub-table."""
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(CELLS - 1).cast("bigint"))

    def cell(members: Column) -> Column:
        return F.struct(F.size(members).alias("n"), _xor(members, lambda d: d).alias("d"), _xor(members, _check).alias("c"))

    def sub_table(shift: int) -> Column:
        return F.transform(places, lambda p: let(F.filter(found, lambda d: _cell(d, shift) == p), cell))

    return F.flatten(F.array(*[sub_table(s) for s in _SHIFTS]))


def _subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["d"].bitwiseXOR(y["d"]).alias("d"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column) -> Column:
    """(ok, ours, theirs): whether all differences were recovered, and how many each side has."""
    start = F.struct(cells.alias("cells"), F.lit(0).alias("ours"), F.lit(0).alias("theirs"), F.lit(True).alias("more"))

    def pure(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (c["c"] == _check(c["d"]))

    def remove(state: Column, single: Column) -> Column:
        def sub_table(k: int, shift: int) -> Column:
            def one(c: Column, i: Column) -> Column:
                def less(hits: Column) -> Column:
                    n = F.aggregate(hits, F.lit(0), lambda acc, x: acc + x["n"])
                    return F.struct((c["n"] - n).alias("n"), c["d"].bitwiseXOR(_xor(hits, lambda x: x["d"])).alias("d"), c["c"].bitwiseXOR(_xor(hits, lambda x: x["c"])).alias("c"))

                here = F.filter(single, lambda x: _cell(x["d"], shift) == i)
                return let(here, lambda hits: F.when(F.size(hits) == 0, c).otherwise(less(hits)))

            return F.transform(F.slice(state["cells"], k * CELLS + 1, CELLS), one)

        plus = F.size(F.filter(single, lambda x: x["n"] == 1))
        return F.when(F.size(single) == 0, F.struct(state["cells"].alias("cells"), state["ours"].alias("ours"), state["theirs"].alias("theirs"), F.lit(False).alias("more"))).otherwise(
            F.struct(
                F.flatten(F.array(*[sub_table(k, shift) for k, shift in enumerate(_SHIFTS)])).alias("cells"),
                (state["ours"] + plus).alias("ours"),
                (state["theirs"] + F.size(single) - plus).alias("theirs"),
                F.lit(True).alias("more"),
            )
        )

    def step(state: Column, _: Column) -> Column:
        return F.when(state["more"], let(F.array_distinct(F.filter(state["cells"], pure)), lambda single: remove(state, single))).otherwise(state)

    def result(state: Column) -> Column:
        clean = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["d"] == 0))
        return F.struct(clean.alias("ok"), state["ours"].alias("ours"), state["theirs"].alias("theirs"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, result)


def _difference(a: Column, b: Column, table_a: Column, table_b: Column) -> Column:
    """(ok, ours, theirs) of two sets of digests by their tables; a table that fails is retried as four, each with a quarter of its digests."""
    none = F.array().cast("array<bigint>")
    nothing = F.filter(F.array(F.struct(none.alias("a"), none.alias("b"))), lambda _: F.lit(False))

    def counted(ours: Column, theirs: Column, failed: Column) -> Column:
        return F.struct(ours.alias("ours"), theirs.alias("theirs"), failed.alias("failed"))

    def retry(state: Column, shift: Column) -> Column:
        """Peel the quarters of the tables that failed before; a failed table carries its own digests, so others are not looked at again."""

        def quarter(k: int):
            def of(found: Column) -> Column:
                return F.filter(found, lambda d: F.call_function("shiftrightunsigned", d, shift).bitwiseAND(F.lit(3).cast("bigint")) == k)

            return lambda t: F.struct(of(t["a"]).alias("a"), of(t["b"]).alias("b"))

        def add(acc: Column, t: Column) -> Column:
            def judge(p: Column) -> Column:
                return F.when(p["ok"], counted(acc["ours"] + p["ours"], acc["theirs"] + p["theirs"], acc["failed"])).otherwise(
                    counted(acc["ours"], acc["theirs"], F.array_append(acc["failed"], t))
                )

            return let(peel(_subtract(sketch(t["a"]), sketch(t["b"]))), judge)

        again = F.flatten(F.transform(state["failed"], lambda t: F.array(*[quarter(k)(t) for k in range(4)])))
        return F.aggregate(again, counted(state["ours"], state["theirs"], nothing), add)

    def first(p: Column) -> Column:
        whole = F.array(F.struct(a.alias("a"), b.alias("b")))
        return F.when(p["ok"], counted(p["ours"], p["theirs"], nothing)).otherwise(counted(F.lit(0), F.lit(0), whole))

    shifts = F.array(*[F.lit(6 + 2 * k) for k in range(TRIES - 1)])
    start = let(peel(_subtract(table_a, table_b)), first)
    ended = F.aggregate(shifts, start, lambda state, shift: F.when(F.size(state["failed"]) == 0, state).otherwise(retry(state, shift)))
    return let(ended, lambda e: F.struct((F.size(e["failed"]) == 0).alias("ok"), e["ours"].alias("ours"), e["theirs"].alias("theirs")))


def likeness(a: Column, b: Column, table_a: Column, table_b: Column) -> Column:
    """Shared digests over all digests of two versions, from what peeling recovers."""

    def share(p: Column) -> Column:
        every = F.size(a) + p["theirs"]
        return F.when(~p["ok"], 0.0).when(every == 0, 1.0).otherwise((F.size(a) - p["ours"]) / every)

    return let(_difference(a, b, table_a, table_b), share)


def written(table: Column) -> Column:
    """The fingerprint as text."""
    return F.array_join(F.transform(table, lambda c: F.concat_ws(":", c["n"], F.lower(F.hex(c["d"])), F.lower(F.hex(c["c"])))), ",")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's ``key``, ``text`` and ``digests``, and ``next_text`` and ``next_digests`` of the row after it by key.

    Rows are dealt into ranges of the numeric key by its quantiles, and each range gets the
    first row of the range after it, so no order over the whole table is needed.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.stat.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
    within = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("_key"), body.alias("_text"), digests(body).alias("_digests"))
    base = base.withColumn("_range", F.when(F.col("_key").isNull(), -1).otherwise(within))
    first = base.groupBy("_range").agg(F.min(F.struct("_key", "_text", "_digests")).alias("_first"))
    whole = Window.orderBy("_range")  # one row a range
    after = first.select("_range", F.coalesce(F.lead("_first").over(whole), F.first("_first").over(whole)).alias("_first"))
    ends = after.select(F.lit(None).cast(base.schema["_key"].dataType).alias("_key"), F.col("_first._text").alias("_text"), F.col("_first._digests").alias("_digests"), "_range", F.lit(True).alias("_end"))
    rows = base.withColumn("_end", F.lit(False)).unionByName(ends)
    order = Window.partitionBy("_range").orderBy("_end", F.col("_key").asc_nulls_first(), "_text")
    ahead = F.lead(F.struct("_text", "_digests")).over(order)
    led = rows.select("_key", "_text", "_digests", "_end", ahead.alias("_next")).where(~F.col("_end"))
    return led.select(F.col("_key").alias(key), F.col("_text").alias("text"), F.col("_digests").alias("digests"), F.col("_next._text").alias("next_text"), F.col("_next._digests").alias("next_digests"))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the text replaced by the start of the next one."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``."""
    rows = with_next(docs, key, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))

    def compared(x: Column) -> Column:
        own, other, after = x["own"], x["other"], x["after"]
        return F.struct(
            written(own["table"]).alias("fingerprint"),
            written(other["table"]).alias("edited_fingerprint"),
            likeness(own["set"], other["set"], own["table"], other["table"]).alias("near_edited"),
            likeness(own["set"], after["set"], own["table"], after["table"]).alias("near_next"),
        )

    def tabled(found: Column) -> Column:
        return let(found, lambda d: F.struct(d.alias("set"), sketch(d).alias("table")))

    each = F.struct(tabled(F.col("digests")).alias("own"), tabled(digests(F.col("edited"))).alias("other"), tabled(F.col("next_digests")).alias("after"))
    found = rows.select(key, F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), let(each, compared).alias("_found"))
    return found.select(key, "n_chars", "edited_sha256", *[F.col(f"_found.{n}").alias(n) for n in ("fingerprint", "edited_fingerprint", "near_edited", "near_next")])
