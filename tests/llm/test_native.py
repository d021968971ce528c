"""Exact dedup, mixing, fingerprints, licences, chat formatting."""

import hashlib
import random
import re
from collections import defaultdict

import xxhash

from regulith.llm import chat, exact_dedup, fingerprints, licenses, mixing

SAME = ["doc_id", "text", "lang", "source"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_exact_dedup(make_docs, rows_of, long_text):
    rows = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, long_text), (6, long_text), (6, long_text), (None, "a"), (None, "z"), (7, "A")]
    for hot in ({}, {"hot_share": 0.0, "hot_rows": 2}):  # both ways: by content sort, and as a hot text
        got = rows_of(exact_dedup.mark_copies(make_docs(rows), **hot))
        keep = {"a": 2, "": 4, long_text: 6, "z": None, "A": 7}
        size = {"a": 3, "": 2, long_text: 3, "z": 1, "A": 1}
        by = defaultdict(list)
        for r in got:
            by[r.text_sha256].append(r)
        assert len(got) == len(rows)
        for text, k in keep.items():
            group = by[sha(text)]
            assert {(r.keep_id, r.group_size) for r in group} == {(k, size[text])}
            assert [r.doc_id for r in group if r.kept] == [k]
    left = exact_dedup.drop_copies(make_docs(rows))
    assert left.columns == make_docs(rows).columns and left.count() == 5
    assert exact_dedup.mark_copies(make_docs(rows).limit(0)).count() == 0


def water_fill(sizes, weights, cap):
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over


def test_mixing(make_docs, rows_of, long_text):
    rows = [(i, "w " * (i % 37), None, f"s{i % 5}" if i % 3 else "s0") for i in range(900)] + [(900, "one two\x0bthree", None, None), (901, None, None, "tiny"), (902, "x", None, "tiny"), (None, "y", None, "s1"), (903, long_text, None, "s2")]
    got = rows_of(mixing.mix_copies(make_docs(rows)))
    assert len(got) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[source[r.doc_id]] += r.taken
    for s in ("s0", "s1", "s3", "s4"):
        assert abs(taken[s] - want[s]) <= 36 + 1e-6  # the largest document
    again = rows_of(mixing.mix_copies(make_docs(list(reversed(rows)))))
    assert [(r.doc_id, r.taken) for r in got] == [(r.doc_id, r.taken) for r in again]
    # rows equal in id and size but not in text: a rerun takes the same ones
    twins = [(5, f"{a} {b}", None, "s0") for a in "abc" for b in "xyz"] + [(6, "q w e", None, "s1")] * 4 + [(None, f"n {i}", None, "s2") for i in range(9)]
    first, again = (sorted(r.text for r in mixing.mix_rows(make_docs(x)).collect()) for x in (twins, twins[::-1]))
    assert first == again and len(first) > 0
    mixed = mixing.mix_rows(make_docs(rows))
    assert mixed.columns == make_docs(rows).columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_copies(make_docs(rows).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_copies(make_docs([(1, None, None, None)])).collect()] == [0]


def xx(*parts):
    import struct

    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p) if isinstance(p, int) else struct.pack("<i", p[0]), h)
    return h - ((h >> 63) << 64)


def brute_links(text):
    """Closed syncmers as (position, hash), and links, by definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    t = [xx(w) for w in words]
    found = []
    for i in range(len(words) - 3):
        inner = [xx(t[i + k], t[i + k + 1]) for k in range(3)]
        if min(inner) in (inner[0], inner[2]):
            found.append((i, xx(inner[0], inner[2])))
    if len(found) > 1:
        return found, {xx(h, g, (q - p,)) for (p, h), (q, g) in zip(found, found[1:], strict=False)}
    if found:
        return found, {xx(found[0][1])}
    return found, {xx(*t)} if t else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(make_docs, rows_of, long_text, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 3)
    g = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    passage = " ".join(g.choices(words, k=40))
    rows = [(i * 7, " ".join(g.choices(words, k=i * 3)) + (" " + passage if i % 3 == 0 else "")) for i in range(40)]
    rows += [(10**6 + i, f"close ids {i} " * 3) for i in range(30)]  # ids that cluster
    rows += [(400, long_text), (401, None), (402, ""), (403, "one"), (404, "two words"), (405, " \t\v "), (None, "last of all words here"), (7, "same id"), (7, "same id, other text"), (14, rows[2][1])]
    want = brute_pairs(rows)
    for given in (rows, list(reversed(rows))):
        got = fingerprints.fingerprint_pairs(make_docs(given)).collect()
        mine = sorted(((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got))
        assert mine == sorted(want)
    prints = {}
    text = {(r.n_chars, r.edited_sha256): r for r in got}
    assert len(text) >= len(rows) - 2
    for r in got:
        assert len(r.fingerprint) % 16 == 0 and len(r.fingerprint) <= 65 * 16
        prints.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert prints[""] == {0, 4}  # without words
    assert fingerprints.fingerprint_pairs(make_docs(rows).limit(0)).count() == 0
    (one,) = fingerprints.fingerprint_pairs(make_docs([(5, "a b c d e f g h i")])).collect()
    assert one.near_next == 1.0  # its own successor


def brute_pairs(rows):
    order = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (-r[0], r[1])) + [(None, t or "") for i, t in rows if i is None]
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        f, e, n = (brute_links(x)[1] for x in (t, edited, after))
        out.append((i is None, i or 0, len(t), sha(edited), round(jaccard(f, e), 9), round(jaccard(f, n), 9)))
    return out


def test_anchors_are_closed_syncmers(make_docs):
    text = " ".join(f"w{i * i % 101}" for i in range(300))
    rows = [(1, text), (2, "x y " + text), (3, "a b"), (4, text + " other words at the end"), (5, text + " and others at the end")]
    got = fingerprints.with_links(make_docs(rows), "text", "f").collect()
    found = {r.doc_id: [(x.pos, x.hash) for x in r.f_anchors] for r in got}
    for i, t in rows:
        assert (found[i], {r.doc_id: set(r.f) for r in got}[i]) == brute_links(t)
    # context-free: the same anchors, two words later
    assert len(found[1]) > 100 and [(p + 2, h) for p, h in found[1]] == [x for x in found[2] if x[0] >= 2]


def test_licenses(make_docs, rows_of, long_text):
    mit = dict(reversed([k for k in licenses.known_texts() if len(k[1]) > 500]))["MIT"]
    odd = mit.replace("<year> <copyright holders>", "2020 Somebody").upper().replace("sublicense", "sublicence").replace("  ", " ")
    rows = [(1, mit), (2, odd), (3, "Some text.\nReleased under the MIT Licence\nmore"), (4, None), (5, ""), (6, long_text), (6, long_text), (None, "Licensed under CC BY-NC 4.0."), (8, mit + " And more.")]
    got = {r.doc_id: r for r in licenses.scan(make_docs(rows)).collect()}
    assert licenses.scan(make_docs(rows)).count() == len(rows)
    assert got[1].text_license == got[2].text_license == "MIT" and got[1].text_digest == got[2].text_digest
    assert got[3].text_license is None and got[3].line_licenses == "MIT"
    assert got[None].text_license == "CC-BY-NC-4.0"
    assert got[4].text_license is None and got[4].text_digest == got[5].text_digest and got[8].text_license is None
    assert licenses.scan(make_docs(rows).limit(0)).count() == 0


def test_whole_licences(make_docs):
    known = licenses.known_texts()
    whole = [(i, t.upper().replace("\n", "  \n")) for i, (_, t) in enumerate(known) if len(t) > 400]
    got = {r.doc_id: r.text_license for r in licenses.scan(make_docs(whole)).collect()}
    assert all(got[i] == known[i][0] for i, _ in whole)
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC"} <= set(got.values())
    # a text known under two names goes to the first in order; any line of the caller's texts is found
    mine = (("Zed", "All rights are waived by the author."), ("Alpha", "ALL RIGHTS are waived, by the author"))
    rows = [(1, "first\nAll rights are waived by the author.\nlast"), (2, "all rights are waived by the author"), (3, None)]
    got = {r.doc_id: (r.text_license, r.line_licenses) for r in licenses.scan(make_docs(rows), mine).collect()}
    assert got == {1: (None, "Alpha"), 2: ("Alpha", "Alpha"), 3: (None, "")}


def test_chat_round_trip(spark, long_text):
    import itertools
    import random

    g = random.Random(3)
    bits = ["</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<", "[", "|>", "<<SYS>>", "hello there ", "é😀", "\n", "s>", "\\<"]
    turns = []
    for conv in range(40):
        for t in range(g.randrange(1, 30)):
            role = "system" if t == 0 and conv % 2 else g.choice(["user", "assistant", "tool\n<|x|>"])
            turns.append((conv, t, role, "".join(g.choices(bits, k=g.randrange(0, 120)))))
    turns += [(100, 0, "system", "alone"), (101, 0, "assistant", None), (102, 0, "assistant", long_text), (103, 1, "user", "b"), (103, 1, "assistant", "a"), (103, 1, "assistant", "a"), (104, None, None, "n")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(turns, schema)
    windows = chat.windows(df)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    key = lambda t: (t[1] is None, t[1] or 0, (t[2] or "").encode(), (t[3] or "").encode())
    for conv, group in itertools.groupby(sorted(turns, key=lambda t: t[0]), key=lambda t: t[0]):
        want = [(t[2] or "", t[3] or "") for t in sorted(group, key=key)]
        assert [(x.role, x.text) for x in back[conv].turns] == want
        assert back[conv].loss_text == "".join(x for r, x in want if r == "assistant")
    whole = windows.collect()
    assert all(w.n_tokens <= chat.BUDGET or w.conv_id == 102 for w in whole) or max(w.n_tokens for w in whole if w.conv_id != 102) < 2 * chat.BUDGET
    assert any(w.window_no > 1 for w in whole)
    assert chat.windows(df.limit(0)).count() == 0 and chat.digests(df.limit(0)).count() == 0


def test_chat_probe(spark):
    (r,) = chat.digests(chat.probe(spark)).collect()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))
