"""Secrets in text: single patterns, and credentials whose parts stand apart.

Base spans are those of three patterns, each leftmost and non-overlapping: ``assign``
(a named value), ``access`` (an access key id) and ``hex``. Beyond them a credential may
be given in parts: an identifier, a secret and an endpoint. Weak candidates for a part
(shorter ids, mixed tokens, short assigned values, addresses) mean nothing alone. They are
reported, as ``part_id``, ``part_secret`` and ``part_endpoint``, only where a
complementary part lies within ``scope`` code points: an identifier needs a secret and a
secret an identifier or an endpoint that it is no part of; an endpoint needs a base span, or
an identifier and a secret. A token within an identifier is that identifier's value and no secret. A mixed token has 12 signs or more, among them letters and
digits, or small letters before capitals; of those under 20 signs, dates, and words and
numbers joined by ``-``, ``/`` or ``_``, are none. A token of small letters or of capitals
alone is a word.

The join of intervals runs inside the row: a sweep over the text's parts in order, one
forward and one back, carries the last place of each role. All expressions are built-in
SQL functions, nothing is shuffled, and a row's cost depends on its own text alone.

Null text counts as empty and has no spans. Rows are scanned one by one, so ties and
repeated rows do not matter; other columns pass through, and result columns replace those
of the same name. Places are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import packed, unpacked

# The patterns of the base spans (kind, pattern, group that must be so long, least length).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
)
# Weak candidates: kind, pattern, least length of the match.
_SIGN = "[A-Za-z0-9+/_-]"
_ORDINARY = rf"(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|(?:[A-Za-z]+|[0-9]+)(?:[-/_](?:[A-Za-z]+|[0-9]+))*(?!{_SIGN}))"
WEAK = (
    ("part_id", r"(?<![A-Za-z0-9])(?:A[A-Z]{2}A[A-Z0-9]{8,}|(?:id|user|login|account|client_?id)[\x20]*[:=][\x20]*[A-Za-z0-9._@-]{4,})", 8),
    ("part_secret", rf"(?<!{_SIGN})(?:(?=[+/_A-Za-z-]*[0-9])(?=[+/_0-9-]*[A-Za-z])(?:{_SIGN}{{20,}}|(?!{_ORDINARY}){_SIGN}{{12,19}})|(?=[A-Za-z+/_-]*[a-z][A-Z])[A-Za-z+/_-]{{12,}})(?!{_SIGN})", 12),
    ("part_endpoint", r"(?:https?|ftp|s3|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(?<![\w.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])", 6),
    # an assigned value of any length; one that is long enough is a base span
    ("part_secret", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[^\s"'<>,;]+""", 1),
)
KINDS = [kind for kind, *_ in BASE + WEAK] + ["part_secret"]
_TOKEN, _NAMED, _INNER = len(BASE) + 1, len(BASE) + 3, len(BASE) + 4  # part_secret: a token, an assigned value, a token within an endpoint
_IDENTIFIER, _SECRET, _ENDPOINT = 0, 1, 2
_ROLE = {"assign": _SECRET, "access": _IDENTIFIER, "hex": _SECRET, "part_id": _IDENTIFIER, "part_secret": _SECRET, "part_endpoint": _ENDPOINT}
_SPAN = "struct<start:int,kind:int,end:int>"
_FAR = 1 << 30
_NEAR = ("id", "secret", "base", "end")


def _gate(k: int, text: Column) -> Column:
    """A cheap condition that any match implies."""
    kind = KINDS[k]
    if kind == "assign" or k == _NAMED:
        low = F.lower(text)
        return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    if kind == "access":
        return text.contains("AKIA")
    if kind == "part_endpoint":
        return text.contains("://") | text.rlike(r"[a-z0-9]:[0-9]{2}")
    if kind == "part_id":
        return text.rlike(r"(?<![A-Za-z0-9])A[A-Z]{2}A[A-Z0-9]{8}|(?:id|user|login|account)[\x20]*[:=]")
    return F.lit(True)


def _places(kind: int, hits: Column, gaps: Column, sized: Column, least: int) -> Column:
    """Spans of the matches, from the lengths of what lies between them."""
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), sized.alias("sized"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["sized"]) >= least, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def _sweep(parts: Column, back: bool) -> Column:
    """For each part the distance to the nearest identifier, secret, base span and endpoint before it (behind it, if ``back``)."""
    line = F.reverse(parts) if back else parts
    near = "array<struct<id:int,secret:int,base:int,end:int>>"
    start = F.struct(*[F.lit(-_FAR).alias(n) for n in _NEAR], F.array().cast(near).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at, edge = (-p["end"], -p["start"]) if back else (p["start"], p["end"])
        role = F.element_at(F.array(*[F.lit(_ROLE[k]) for k in KINDS]), p["kind"] + 1)
        gone = F.struct(*[(at - acc[n]).alias(n) for n in _NEAR])
        return F.struct(
            F.when(role == _IDENTIFIER, F.greatest(acc["id"], edge)).otherwise(acc["id"]).alias("id"),
            F.when(role == _SECRET, F.greatest(acc["secret"], edge)).otherwise(acc["secret"]).alias("secret"),
            F.when(p["kind"] < len(BASE), F.greatest(acc["base"], edge)).otherwise(acc["base"]).alias("base"),
            F.when(role == _ENDPOINT, F.greatest(acc["end"], edge)).otherwise(acc["end"]).alias("end"),
            F.array_append(acc["out"], gone).alias("out"),
        )

    out = F.aggregate(line, start, step, lambda acc: acc["out"])
    return F.reverse(out) if back else out


def find_secrets(docs: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """Add ``secret_spans``: all spans as structs (start, kind, end), in order; ``kind`` is a name of ``KINDS``."""
    held = docs.select(packed(docs, "secret_spans"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rules = [(kind, pattern, group, least) for kind, pattern, group, least in BASE] + [(kind, pattern, 0, least) for kind, pattern, least in WEAK]
    body = F.col("_text")
    none = F.array().cast("array<string>")
    hits = held.select(
        "*", *[F.when(_gate(k, body), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"_hit_{k}") for k, (_, pattern, *_) in enumerate(rules)]
    )
    empty = F.array().cast(f"array<{_SPAN}>")
    spans = hits.select(
        "*",
        *[
            F.when(
                F.size(f"_hit_{k}") > 0,
                _places(k, F.col(f"_hit_{k}"), F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(group)), least),
            )
            .otherwise(empty)
            .alias(f"_span_{k}")
            for k, (_, pattern, group, least) in enumerate(rules)
        ],
    )
    base = F.concat(*[F.col(f"_span_{k}") for k in range(len(BASE))])
    within = F.transform(f"_span_{_TOKEN}", lambda t: F.struct(t["start"], F.when(F.exists(f"_span_{KINDS.index('part_endpoint')}", lambda e: (e["start"] <= t["start"]) & (t["start"] < e["end"])), F.lit(_INNER)).otherwise(F.lit(_TOKEN)).alias("kind"), t["end"]))
    # a part is no complement of itself: a token within an identifier is its value, and an identifier within an assigned value is that value
    ids, named = f"_span_{KINDS.index('part_id')}", f"_span_{_NAMED}"
    apart = lambda spans: lambda w: ~F.exists(spans, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    tokens = F.filter(within.cast(f"array<{_SPAN}>"), apart(ids))
    others = [F.filter(ids, apart(named))] + [F.col(f"_span_{k}") for k in range(len(BASE), len(rules)) if k not in (_TOKEN, KINDS.index("part_id"))]
    # a weak candidate that overlaps a base span is that span
    weak = F.filter(F.concat(*others, tokens), apart("_base"))
    parts = spans.withColumn("_base", base).select("_row", "_base", weak.alias("_weak"))
    parts = parts.withColumn("_parts", F.when(F.size("_weak") == 0, F.array_sort("_base")).otherwise(F.array_sort(F.concat("_base", "_weak"))))
    swept = parts.select(
        "_row",
        "_parts",
        F.when(F.size("_weak") > 0, F.arrays_zip(F.col("_parts").alias("part"), _sweep(F.col("_parts"), False).alias("ahead"), _sweep(F.col("_parts"), True).alias("back"))).alias("_near"),
    )

    def linked(x: Column) -> Column:
        near = {n: F.least(x["ahead"][n], x["back"][n]) <= scope for n in _NEAR}
        kind = x["part"]["kind"]
        return (
            F.when(kind < len(BASE), True)
            .when(kind == KINDS.index("part_id"), near["secret"])
            .when(kind == _INNER, near["id"])
            .when((kind == _TOKEN) | (kind == _NAMED), near["id"] | near["end"])
            .otherwise(near["base"] | (near["id"] & near["secret"]))
        )

    kept = F.when(F.col("_near").isNull(), F.col("_parts")).otherwise(F.transform(F.filter("_near", linked), lambda x: x["part"]))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    return swept.select(*unpacked(swept), named.alias("secret_spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_secrets(text: Column, spans: Column, mask: str = "<secret>") -> Column:
    """The text with its spans replaced; overlapping spans are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.when(fresh, F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(fresh, F.concat(gap, F.lit(mask))).otherwise("")).alias("out"))

    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)
