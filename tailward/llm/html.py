"""Main text of web pages by wrapper induction over the pages of a host.

Each page's tree is aligned with that of its host's first page by simple tree matching
(the largest order-preserving match of nodes with equal tags). A text that stands
unchanged at its aligned place on nearly all of the host's pages is template; what varies
is content. Of the varying slots, those in menus, headers, footers, asides, forms,
notices, adverts and comments, told by tag, role or class, are left out; where a page has
an article or main element, only its slots count.

Votes of all pages are summed by Spark per host and node, so a host with a third of all
pages is spread like any other. Hosts with fewer than ``min_pages`` pages have no template.

Null or empty html gives an empty text. Pages without a host in their url form one group
without a template. Repeated rows are extracted one by one and each votes. Other columns
pass through, and result columns replace those of the same name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailward.session import stage

from .columns import broadcast_if_small, packed, unpacked

# Element names of the HTML standard, and words that sites name their parts by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
CLOSES_P = BLOCK - frozenset("body html dd dt li td th tr tbody thead tfoot".split())
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPE = frozenset("ul ol menu dl table div article section main body html td th".split())
DROPPED = frozenset("head nav footer aside form button select option dialog svg math canvas object audio video label datalist".split()) | RAW
MAIN = frozenset(("article", "main"))
PART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|header|masthead|cookies?\w*|consent"
    r"|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|comments?|comment\w+|replies|disqus|related|recommended|widgets?"
    r"|pagination|pager|legal|copyright|login|signup|search)(?:$|[\s_\d-])"
)
PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DEEPEST = 200  # further nested elements become siblings, as browsers do

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """An element, or a text when it has no tag. ``texts`` is the range of the page's texts below it."""

    __slots__ = ("tag", "kids", "dropped", "texts", "shape")

    def __init__(self, tag: str, dropped: bool = False):
        self.tag, self.kids, self.dropped, self.texts, self.shape = tag, [], dropped, (0, 0), 0


def _is_part(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_main):
        return True
    if not attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and tag not in ("body", "html") and PART_NAMES.search(value):
            return True
        if (name == "role" and value in PART_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def parse(page: str) -> tuple[Node, list[str]]:
    """The page's tree and its texts in page order, character references decoded."""
    root = Node("#root")
    stack, texts, at, in_main = [root], [], 0, 0

    def say(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        if text.strip():
            leaf = Node("")
            leaf.texts = (len(texts), len(texts) + 1)
            stack[-1].kids.append(leaf)
            texts.append(text)
        elif text and stack[-1].kids and texts:
            texts[-1] += " "

    def close(depth: int) -> None:
        nonlocal in_main
        for node in stack[depth:]:
            in_main -= node.tag in MAIN
        del stack[depth:]

    def open_depth(tags, stop=frozenset()) -> int | None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in stop:
                return None
        return None

    find = _TOKEN.search
    while m := find(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = open_depth((tag,))
            if depth is not None:
                close(depth)
            continue
        if tag in CLOSES_P:
            depth = open_depth(("p",), SCOPE)
            if depth is not None:
                close(depth)
        elif tag in CLOSED_BY:
            depth = open_depth(CLOSED_BY[tag].split(), SCOPE - {"td", "th"} if tag == "tr" else SCOPE - frozenset(CLOSED_BY[tag].split()))
            if depth is not None:
                close(depth)
        node = Node(tag, _is_part(tag, m[3], in_main > 0))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
        if tag not in VOID and not m[3].endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
            in_main += tag in MAIN
    if at < len(page):
        say(page[at:])
    return root, texts


_shapes: dict[tuple, int] = {}
_parts: list[tuple[str, tuple[int, ...], int]] = []  # of each shape: tag, shapes of its children, number of nodes
_matched: dict[tuple[int, int], int] = {}


def shape(node: Node) -> int:
    """Number the subtree's form without its texts, and set the range of texts below it."""
    kids = tuple(map(shape, node.kids))
    if node.tag:
        filled = [k.texts for k in node.kids if k.texts[0] < k.texts[1]]
        node.texts = (filled[0][0], filled[-1][1]) if filled else (0, 0)
    key = (node.tag, kids)
    if key not in _shapes:
        _shapes[key] = len(_parts)
        _parts.append((node.tag, kids, 1 + sum(_parts[k][2] for k in kids)))
    node.shape = _shapes[key]
    return node.shape


def _trim(a, b) -> tuple[int, int]:
    """Lengths of the equal start and, beyond it, the equal end of two lists."""
    most = min(len(a), len(b))
    start = next((k for k in range(most) if a[k] != b[k]), most)
    end = next((k for k in range(most - start) if a[-1 - k] != b[-1 - k]), most - start)
    return start, end


def matching(a: int, b: int) -> int:
    """Number of nodes in the largest order-preserving match of two forms."""
    if a == b:
        return _parts[a][2]
    if _parts[a][0] != _parts[b][0]:
        return 0
    if (a, b) in _matched:
        return _matched[a, b]
    for row in _rows(np.zeros(len(_parts[b][1]) + 1, np.int64), _parts[a][1], _parts[b][1]):
        pass
    n = 1 + int(row[-1])
    if len(_matched) < 1_000_000:  # remembered to save time alone
        _matched[a, b] = n
    return n


def _rows(row: np.ndarray, x: Sequence[int], y: Sequence[int]) -> Iterator[np.ndarray]:
    """Best match of starts of two child lists: ``row``, for what is before ``x``, and one for each start of ``x``, over all starts of ``y``."""
    yield row
    kinds = {j: k for k, j in enumerate(dict.fromkeys(y))}
    place = np.array([kinds[j] for j in y], int)
    weights: dict[int, np.ndarray] = {}
    for i in x:
        if i not in weights:
            if len(weights) * len(kinds) > 1_000_000:
                weights.clear()
            weights[i] = np.array([matching(i, j) for j in kinds], np.int64)
        row = np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[i][place]))])
        yield row


def _matched_places(x: Sequence[int], y: Sequence[int]) -> list[tuple[int, int]]:
    """Places matched in the best match of two child lists, from their ends.

    Every ``step``-th row is kept and the rows between are computed again, so lists of any length
    take memory for some ``2 * sqrt(len(x))`` rows, and all take the same path.
    """
    step = math.isqrt(len(x)) + 1
    kept = [row for k, row in enumerate(_rows(np.zeros(len(y) + 1, np.int64), x, y)) if k % step == 0]
    out: list[tuple[int, int]] = []
    i, j, first, rows = len(x), len(y), len(x) + 1, []
    while i and j:
        if i - 1 < first:
            first = (i - 1) // step * step
            rows = list(_rows(kept[first // step], x[first:i], y))
        at, before = rows[i - first], rows[i - 1 - first]
        if at[j] == before[j]:
            i -= 1
        elif at[j] == at[j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def align(a: Node, b: Node, found: dict[int, int]) -> None:
    """Add to ``found``, for each text below ``a``, the text of ``b`` at its aligned place."""
    if a.tag != b.tag:
        return
    if a.shape == b.shape:
        (s, e), (t, _) = a.texts, b.texts
        found.update(zip(range(s, e), range(t, t + e - s), strict=True))
        return
    x, y = [k.shape for k in a.kids], [k.shape for k in b.kids]
    start, end = _trim(x, y)
    for i in range(start):
        align(a.kids[i], b.kids[i], found)
    for i in range(end):
        align(a.kids[-1 - i], b.kids[-1 - i], found)
    m, n = len(x) - start - end, len(y) - start - end
    if not m or not n:
        return
    for i, j in _matched_places(x[start : start + m], y[start : start + n]):
        align(a.kids[start + i], b.kids[start + j], found)


def blocks(root: Node, texts: list[str]) -> list[tuple[list[int], str]]:
    """Blocks of text outside the dropped parts, with the numbers of their texts; only those in an article or main element, if it has one."""
    out: list[tuple[bool, list[int], str]] = []
    run: list[int] = []

    def flush(inside: bool) -> None:
        if run:
            text = " ".join("".join(texts[k] for k in run).split())
            if text:
                out.append((inside, run.copy(), text))
            run.clear()

    def walk(node: Node, inside: bool) -> None:
        for kid in node.kids:
            if not kid.tag:
                run.append(kid.texts[0])
            elif kid.dropped:
                if kid.tag in BLOCK:
                    flush(inside)
            elif kid.tag in BLOCK:
                flush(inside)
                within = inside or kid.tag in MAIN
                walk(kid, within)
                flush(within)
            else:
                if kid.tag == "br" and run:
                    texts[run[-1]] += " "
                walk(kid, inside)

    walk(root, False)
    flush(False)
    main = [(k, t) for inside, k, t in out if inside]
    return main or [(k, t) for _, k, t in out]


_references: dict[str, tuple[Node, list[str]]] = {}


def _reference(page: str) -> tuple[Node, list[str]]:
    if page not in _references:
        if len(_references) >= 32:
            _references.clear()
        root, texts = parse(page)
        shape(root)
        _references[page] = root, [t.strip() for t in texts]
    return _references[page]


def slots(page: str, reference: str) -> list[dict]:
    """The page's blocks, each with the reference text that stands unchanged at its place, or -1."""
    if not page:
        return []
    if len(_parts) > 100_000 or len(_matched) >= 1_000_000:
        for known in (_shapes, _parts, _matched, _references):
            known.clear()
    root, texts = parse(page)
    found: dict[int, int] = {}
    if reference:
        model, constant = _reference(reference)
        shape(root)
        align(root, model, found)
        found = {k: j for k, j in found.items() if texts[k].strip() == constant[j]}
    return [{"ref": found[k[0]] if all(i in found for i in k) else -1, "text": t} for k, t in blocks(root, texts)]


def extract_main_text(
    pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", min_pages: int = 5, constant_share: float = 0.9
) -> DataFrame:
    """Put ``text``, the page's main text, one block a line, in the place of ``html``.

    Text standing at its place on at least ``constant_share`` of a host's pages is template.
    """

    @F.arrow_udf("array<struct<ref int, text string>>")
    def find(page: pa.Array, reference: pa.Array) -> pa.Array:
        rows = [slots(p.as_py() or "", r.as_py() or "") for p, r in zip(page, reference, strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("ref", pa.int32()), ("text", pa.string())])))

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][\w+.-]*://([^/:?#]+)", 1)), F.lit(""))
    held = pages.select(packed(pages, "text", html), F.col(key).alias("_key"), F.col(html).cast("string").alias("_html"), host.alias("_host"))
    named = held.where((F.col("_host") != "") & (F.length("_html") > 0))
    first = named.groupBy("_host").agg(F.min_by("_html", F.struct("_key", "_html")).alias("_first"), F.count("*").alias("_pages"))
    first = broadcast_if_small(stage(first, "first_pages"), F.octet_length("_first"))
    joined = held.join(first, "_host", "left").select("_row", "_host", "_pages", find("_html", "_first").alias("_blocks"))
    slotted = stage(joined, "slots")
    votes = (
        slotted.where(F.col("_pages") >= min_pages)
        .select("_host", "_pages", F.explode(F.array_distinct(F.transform("_blocks", lambda b: b["ref"]))).alias("ref"))
        .where("ref >= 0")
        .groupBy("_host", "ref")
        .agg(F.count("*").alias("n"), F.max("_pages").alias("pages"))
        .where(F.col("n") >= constant_share * F.col("pages"))
    )
    template = stage(votes.groupBy("_host").agg(F.collect_list("ref").alias("_template")), "template")
    template = broadcast_if_small(template, 4 * F.size("_template"))
    content = F.filter("_blocks", lambda b: ~F.array_contains(F.coalesce("_template", F.array().cast("array<int>")), b["ref"]))
    text = F.array_join(F.transform(content, lambda b: b["text"]), "\n")
    return slotted.join(template, "_host", "left").select(*unpacked(slotted), F.coalesce(text, F.lit("")).alias("text"))
