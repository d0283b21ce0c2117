"""Byte-level pair encoding against the library of the rank files, and its exact way back."""

from __future__ import annotations

import hashlib
import random
import time
from array import array

import public_tokenizers
import pytest
import tiktoken
from llm_data import no_docs, odd_docs, sentences  # noqa: F401

from tailward.llm import bytepairs
from tailward.llm.bytepairs import Ranks, decode_ids, encode_texts, load_ranks, untrained
from tailward.llm.queries import QUERIES


@pytest.fixture(scope="module")
def ranks():
    return Ranks(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(ranks.tokens)}, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefgh") for _ in range(700))
    points = [chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(32, 0x250)])) for _ in range(3000)]
    return [
        "I don't, we'll  they've\n\n\tend ", " ", "   x", "x   ", "a b  c\u0085d", "\x01\x02\x03 a\x01b\x02", "12345 ½ ٣٤", "漢字かな交じり文 한국어 текст",
        "'S's''s", "🙂🙃 👩‍👩‍👧", "<|endoftext|> x", letters, "a" * 4000, "ab" * 900 + "!" * 300, letters + " " * 90 + letters, "𞓐𞓑 𲎯 \U000116d0", *("".join(points[k : k + 30]) for k in range(0, 3000, 30)),
    ]


@pytest.mark.parametrize("memo", [0, bytepairs.MEMO_BYTES])
def test_equals_the_library(spark, ranks, encoding, sentences, monkeypatch, memo):
    monkeypatch.setattr(bytepairs.frequent_words, "__defaults__", ("text", memo))
    texts = sentences(60, 3) + odd_texts()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in decode_ids(encode_texts(docs, ranks), ranks).collect():
        assert r.ids == encoding.encode_ordinary(r.text)
        assert bytes(r.decoded) == r.text.encode()


def test_query_equals_the_library(spark, ranks, encoding, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op13_byte_pairs"](spark, sf_dir).collect():
        ids = encoding.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, ranks, encoding, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("score", "ids").withColumnRenamed("_found", "decoded")
    rows = decode_ids(encode_texts(docs, ranks), ranks).collect()
    assert len(rows) == docs.count() and all(r.ids == encoding.encode_ordinary(r.text or "") for r in rows)
    assert encode_texts(no_docs, ranks).count() == 0
    unknown = spark.createDataFrame([(None,), ([],), ([5, None, 60000, 6],)], "ids array<int>")
    assert [bytes(r.decoded) for r in decode_ids(unknown, ranks).collect()] == [b"", b"", ranks.tokens[5] + ranks.tokens[6]]


def test_ranks_that_are_not_trained_are_refused(spark, ranks, no_docs):
    assert untrained(ranks) == []
    bad = Ranks([bytes([k]) for k in range(256)] + [b"abc"])
    assert untrained(bad) == [256]
    with pytest.raises(ValueError):
        encode_texts(no_docs, bad)


def test_words_that_occur_once_are_cheap(spark, ranks, encoding, monkeypatch):
    """400,000 distinct words in one task: folds of 100 microseconds a word took over 40 s."""
    monkeypatch.setattr(bytepairs.frequent_words, "__defaults__", ("text", 0))
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("aeinrst") for _ in range(10)) for _ in range(20_000)) for _ in range(20)]
    coded = encode_texts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), ranks)
    began = time.monotonic()
    rows = coded.collect()
    assert time.monotonic() - began < 25
    assert [r.ids for r in rows] == [encoding.encode_ordinary(r.text) for r in rows]


def test_every_character_and_a_full_table(ranks, encoding, monkeypatch):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[k : k + 50_000]) for k in range(0, len(points), 50_000)] + ["".join(f"a{c} {c}" for c in points[:70_000])]
    monkeypatch.setattr(bytepairs, "MEMO_BYTES", 10_000)
    ids = bytepairs.PieceIds(ranks.tokens, {})
    for text in texts + odd_texts():
        assert list(array("I", ids.of_texts([bytepairs.pieces(text)])[0])) == encoding.encode_ordinary(text)


def test_long_and_short_pieces_merge_alike(ranks):
    rng = random.Random(7)
    ids = bytepairs.PieceIds(ranks.tokens, {})
    for _ in range(300):
        piece = bytes(rng.choice(b"aetonsh \n\xc3\xa9") for _ in range(rng.randrange(2, 90)))
        ((_, short),) = [(p, f) for p, f in bytepairs._short_parts(ids.pairs, len(ids.rank), ids.bytes[list(piece)][None]) if len(p)]
        assert short[0].tolist() == bytepairs._long_parts(ids.rank, piece)


def test_rows_beyond_a_slice(spark, ranks):
    """Rows of more ids than are looked up at once, beside empty ones, keep their places."""
    lists = [[], [5] * 600_000, [], [6, None, 7] * 100_000, [8], []] * 2
    rows = spark.createDataFrame([(k, ids) for k, ids in enumerate(lists)], "id int, ids array<int>").coalesce(1)
    got = {r.id: (r.size, bytes(r.head)) for r in decode_ids(rows, ranks).selectExpr("id", "octet_length(decoded) AS size", "substring(decoded, 1, 20) AS head").collect()}
    for k, ids in enumerate(lists):
        whole = b"".join(ranks.tokens[i] for i in ids if i is not None)
        assert got[k] == (len(whole), whole[:20])
