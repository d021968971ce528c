"""Collocations against plain counting, at every cycle length and with pages split in two steps."""

import collections
import random
import re

import pytest

from regulith.llm import collocations as co


def brute_counts(rows):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    return n, f


def brute(rows, least=10, top=2000):
    n, f = brute_counts(rows)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(x == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for (x, q), b in f.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out.sort()
    got, rank = [], collections.Counter()
    for lang, score, a, p, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(got)


def texts(seed, n=260):
    g = random.Random(seed)
    words = ["Aa", "b", "é", "cc", "dd\xa0d", "\x1ce", "f", "G", "日本", "x" * 40] + [f"r{i}" for i in range(30)]
    weights = [12, 10, 8, 6, 4, 4, 3, 3, 2, 1] + [0.3] * 30
    rows = []
    for i in range(n):
        parts = [g.choices(words, weights)[0] + g.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", "!?", " "]) for _ in range(g.randrange(0, 30))]
        rows.append((i, "".join(parts), g.choice(["fr", "en", None, "und", "a\nb"])))
    rows += [(1000, None, "fr"), (1001, "", None), (None, "aa b " * 30, "en"), (5, "late one only. " * 9, "fr"), (5, "late one only. " * 9, "fr"), (6, " ".join(["aa"] * 3000), "long")]
    return rows


@pytest.fixture
def docs_of(make_docs):
    return lambda rows, parts=3: make_docs(rows).repartition(parts)


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_against_plain_counting(docs_of, shards):
    rows = texts(shards)
    got = co.collocations(docs_of(rows), shards=shards).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert got[0].__fields__ == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_small_limits_and_shared_places(docs_of, monkeypatch):
    """Pages split up in two steps, many buckets, small chunks, and a table so small that all phrases share places."""
    monkeypatch.setattr(co, "BUCKET_BYTES", 500)
    monkeypatch.setattr(co, "FAN", 3)
    monkeypatch.setattr(co, "CHUNK", 300)
    rows = texts(9)
    assert sorted(tuple(r) for r in co.collocations(docs_of(rows, 2), least=5, top=7).collect()) == brute(rows, 5, 7)


def test_places_taken_early(make_docs, monkeypatch):
    """Words of the last shard only start late; other pairs have long taken their pairs' places: their triples still count every shard."""
    monkeypatch.setattr(co, "SLOTS", 1024)
    g = random.Random(7)
    common, late = [f"c{i}" for i in range(30)], [f"late{i}" for i in range(8)]
    rows = [(i, " ".join(g.choices(late if i % 3 == 2 else common, k=300)), "fr") for i in range(150)]
    n, f = brute_counts(rows)
    got = co.frequent_phrases(make_docs(rows).coalesce(1), least=10).collect()
    assert {(r.level, r.phrase): r.f for r in got if r.level} == {(len(p), " ".join(p)): c for (_, p), c in f.items() if c >= 10}


def test_all_frequent_phrases(docs_of):
    rows = texts(11)
    n, f = brute_counts(rows)
    got = co.frequent_phrases(docs_of(rows), least=4).collect()
    assert {(r.level, r.lang, r.phrase): r.f for r in got if r.level} == {(len(p), lang, " ".join(p)): c for (lang, p), c in f.items() if c >= 4}
    total = collections.Counter()
    for r in got:
        if not r.level:
            total[r.lang] += r.f
    assert total == +n


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 10**12 - 7, 10**12 + 3, 9 * 10**12
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r")).select(co._score().alias("s")).first()
    assert row.s == 1000000 * a * a // (left * right)


def test_empty(docs_of):
    assert co.collocations(docs_of([(1, "x", "fr")]).limit(0)).count() == 0
    assert co.collocations(docs_of([(1, None, "fr"), (2, " .. ", None)])).count() == 0
