"""Parts of a credential against brute force over all pairs of parts, and names wherever they stand in a template."""

from __future__ import annotations

import random

import pytest

from tailward.llm.contamination import find_contamination
from tailward.llm.secrets import find_secrets


def kinds(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [[(s.kind, r.text[s.start : s.end]) for s in r.secret_spans] for r in find_secrets(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("text", ["see ASIAQWERTY1234567890 in the list", "client_id=prod-2024-eu7-frontendA9 only", "account: Q4-RE2024-INV-00093412-B paid", "user: Ab12Cd34Ef56Gh78Ij90"])
def test_an_identifier_is_no_complement_of_itself(spark, text):
    assert kinds(spark, [text]) == [[]]


def test_an_identifier_and_another_secret_are_both_reported(spark):
    (found,) = kinds(spark, ["client_id=prod-2024-eu7-frontendA9 and then x7Kq92LmP04zTr81Vb53"])
    assert found == [("part_id", "client_id=prod-2024-eu7-frontendA9"), ("part_secret", "x7Kq92LmP04zTr81Vb53")]


def test_parts_match_brute_force(spark):
    """Every pair of parts within the scope, looked at one by one."""
    rng = random.Random(9)
    part = {"id": "user: bobby7", "secret": "password: hunter2", "end": "db.example.com:5432"}
    texts, wanted = [], []
    for _ in range(60):
        text, spans = "", []
        for _ in range(rng.randrange(1, 6)):
            text += " " + "lorem " * rng.choice([1, 5, 20, 33, 34, 60])
            kind = rng.choice(list(part))
            spans.append((kind, len(text), len(text) + len(part[kind])))
            text += part[kind]
        near = lambda a, b: max(a[1], b[1]) - min(a[2], b[2]) <= 200
        has = lambda a, kind: any(b is not a and b[0] == kind and near(a, b) for b in spans)
        keep = {"id": lambda a: has(a, "secret"), "secret": lambda a: has(a, "id") or has(a, "end"), "end": lambda a: has(a, "id") and has(a, "secret")}
        texts.append(text)
        wanted.append([(f"part_{'endpoint' if a[0] == 'end' else a[0]}", text[a[1] : a[2]], a[1]) for a in spans if keep[a[0]](a)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [[(s.kind, r.text[s.start : s.end], s.start) for s in r.secret_spans] for r in find_secrets(docs).orderBy("doc_id").collect()]
    assert got == wanted


ITEM = "Anna has 12 marbles. Anna wins 7 marbles. Anna loses 4 marbles. How many marbles does Anna have?"


def matches(spark, docs, items=(ITEM,)):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = find_contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), bench).collect()
    return {(r.doc_id, r.item_id): r.agreeing for r in rows}


def test_names_that_begin_sentences_are_slots(spark):
    again = "Zoe has 31 marbles. Zoe wins 8 marbles. Zoe loses 9 marbles. How many marbles does Zoe have?"
    mixed = "Zoe has 31 marbles. Max wins 8 marbles. Eva loses 9 marbles. How many marbles does Tom have?"
    assert matches(spark, [again, "Some words before. " + again + " And some after.", "x " + ITEM, mixed]) == {(0, 0): 1.0, (1, 0): 1.0, (2, 0): 1.0}


def test_other_capitals_are_the_same_words(spark):
    item = "The train to Oslo leaves at 9 and the second train from there needs 3 hours for all of its long way back home"
    lower, title = item.lower(), item.title()
    changed = "the train to bergen leaves at 7 and the second train from there needs 5 hours for all of its long way back home"
    assert matches(spark, [lower, changed, title.replace("The Train", "the train"), item.replace("needs", "took")], [item]).keys() >= {(0, 0), (1, 0)}
