"""Texts are dealt over all tasks before they are read; blocks of characters as difflib finds them."""

import difflib
import random

import pytest

import regulith.plans  # noqa: F401
from regulith.operators import grouping
from regulith.registry import QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["legal_articles", "char_ratios", "grounding_verdicts", "unit_rules", "snippets", "document_gate", "fallback_units", "sanitized_text", "legal_normaliser", "candidate_groups", "document_dedup", "ocr_shares"])
def test_texts_are_dealt_over_all_tasks(spark, name):
    assert "RepartitionByExpression [doc_id" in QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()


def test_likeness_is_that_of_difflib():
    g = random.Random(3)
    for k in range(600):
        signs = ("ab ", "abcdefghij klm", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab")[k % 3]
        a = "".join(g.choice(signs) for _ in range(g.choice((1, 5, 40, 199, 200, 201, 450))))
        b = list(a) if k % 2 else [g.choice(signs) for _ in range(g.choice((0, 3, 199, 200, 300)))]
        for _ in range(g.randrange(9)):
            if b:
                b[g.randrange(len(b))] = g.choice("xyz" + signs)
        b = "".join(b[len(b) // 2 :] + b[: len(b) // 2] if k % 5 == 0 else b)
        assert grouping._likeness(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_gate_makes_a_text_plain_once(spark):
    plan = QUERIES["document_gate"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    # the sign that only making a text plain replaces: in the title and in the text
    assert plan.count("Â°") == 2


def test_letters_are_counted_where_they_are_asked_for():
    seen = grouping.Seen()
    for t in ("one two three four five six", "seven eight nine ten eleven twelve") * 20:
        seen.add(t)
    assert seen.near("one two three four five six")[0] == 0 and seen.counted == 0
    assert len(seen.near("one two three four five six", 0.9)) == 20 and seen.counted == 40
