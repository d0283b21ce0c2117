"""Fill-in-middle against a plain Python version, and its exact way back."""

from __future__ import annotations

import hashlib
import re

import pytest
from llm_data import no_docs, odd_docs, sentences  # noqa: F401

from tailward.llm import middle
from tailward.llm.middle import fill_in_middle, restore


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return "plain", len(units), text, None, None
    if h[3] % 100 < 20:
        return "spm", len(units), f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return "psm", len(units), f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


@pytest.mark.parametrize("size", [1, 700, 1 << 19])
def test_equals_the_plain_version(spark, sentences, monkeypatch, size):
    """Also where a batch is worked on in many slices, down to single rows."""
    monkeypatch.setattr(middle, "SLICE", size)
    texts = sentences(300, 5) + ["", None, "a", "<", "<P", "<P<S", "M>x<", "has <M> inside", "\x00\n\u0085 é漢🙂", "🙂", "S>P>M>"] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = restore(fill_in_middle(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.form, r.n, r.output, r.prefix_chars, r.middle_chars) == plain_version(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("score", "form").withColumnRenamed("_found", "_h")
    rows = restore(fill_in_middle(docs)).collect()
    assert len(rows) == docs.count() and all(r.restored == (r.text or "") for r in rows)
    assert set(rows[0].asDict()) == {"doc_id", "text", "_row", "_h", "form", "n", "output", "prefix_chars", "middle_chars", "restored"}
    for r in rows:
        assert (r.form, r.n, r.output, r.prefix_chars, r.middle_chars) == plain_version(r.doc_id, r.text)
    assert restore(fill_in_middle(no_docs)).count() == 0


def test_broken_outputs_are_not_restored(spark):
    rows = [("<P>a<S>b", "psm"), (None, "psm"), ("x", None), ("<P>a<S>c<M>b", "psm"), ("x", "plain")]
    got = restore(spark.createDataFrame(rows, "output string, form string")).collect()
    assert [r.restored for r in got] == [None, None, None, "abc", "x"]
