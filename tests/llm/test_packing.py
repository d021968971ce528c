"""Packing: ids as the library's, gapless sequences, reductions against exhaustive search."""

import collections
import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from regulith.llm import packing, tokens


def test_ids_equal_the_librarys():
    with open(packing.MODEL, "rb") as f:
        own = tokens.Tokenizer(f.read())
    g = random.Random(1)
    bits = ["'s", "'", "'t", "'re", "'ll", "r", "e", " ", "  ", "\n", "\t", " ", "　", "a", "É", "日本", "1", "²", "٣", ".", "!", "''", "<|endoftext|>", "<|end", "😀", "é", "​", "Word", "ve", "\r\n", "\x1c", "\x85", "_", "\0"]
    texts = ["".join(g.choices(bits, k=g.randrange(0, 14))) for _ in range(6000)]
    texts[7] = None
    for text, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == own.library.encode(text or "", add_special_tokens=False).ids, text


def best(sizes, capacity):
    """Fewest bins by exhaustive search."""

    @functools.cache
    def search(left):
        if not left:
            return 0
        first, rest = left[-1], left[:-1]  # the longest goes with any subset that fits
        found = set()

        def extend(i, room, out):
            found.add(out)
            for k in range(i, len(rest)):
                if rest[k] <= room and (k == i or rest[k] != rest[k - 1]):
                    extend(k + 1, room - rest[k], (*out, k))

        extend(0, capacity - first, ())
        return 1 + min(search(tuple(s for k, s in enumerate(rest) if k not in out)) for out in found)

    return search(tuple(sorted(sizes)))


def test_reduction_keeps_the_best_and_shrinks():
    g = random.Random(3)
    fixed = 0
    for _ in range(400):
        capacity = g.choice([10, 20, 37])
        sizes = [g.randint(g.choice([1, capacity // 4]), capacity) for _ in range(g.randint(1, 11))]
        count = np.bincount(sizes, minlength=capacity + 1)
        groups = packing.reduce(count, capacity)
        rest = np.repeat(np.arange(capacity + 1), count).tolist()
        own = sum(x.times for x in groups)
        fixed += own
        assert own + best(rest, capacity) == best(sizes, capacity), sizes
        taken = collections.Counter(s for x in groups for _ in range(x.times) for s, k in x.runs for _ in range(k))
        assert taken + collections.Counter(rest) == collections.Counter(sizes)
        assert all(x.left >= 0 and sum(s * k for s, k in x.runs) + x.left == capacity for x in groups)
    assert fixed > 400


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_best_fit_of_counts_equals_best_fit_of_pieces():
    g = random.Random(4)
    for _ in range(300):
        capacity = g.choice([10, 31, 64])
        sizes = [g.randint(1, capacity) for _ in range(g.randint(1, 60))]
        groups = packing.best_fit(np.bincount(sizes, minlength=capacity + 1), capacity)
        assert sorted(x.left for x in groups for _ in range(x.times)) == plain_best_fit(sizes, capacity)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_without_gaps(seed):
    g = random.Random(seed)
    counts = {g.randint(1, 1024): g.choice([1, 3, 1000, 10**6]) for _ in range(200)}
    counts = {s: min(n, 300) for s, n in counts.items()} if seed % 2 else counts
    p = packing.plan(counts)
    total = sum(s * n for s, n in counts.items())
    assert p.sequences >= -(-total // 1024) and len(p.key) < 30_000
    if seed % 2:
        length = np.repeat(list(counts), list(counts.values()))
        number = np.concatenate([np.arange(n) for n in counts.values()])
        sequence, offset = p.place(length, number)
        order = np.lexsort((offset, sequence))
        s, o, z = sequence[order], offset[order], length[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + z)[:-1][~first[1:]]).all() and (o + z).max() <= 1024
        assert set(s.tolist()) == set(range(p.sequences))


def test_packing_of_documents(make_docs, long_text):
    texts = ["a few words", None, "", long_text, "a few words", "x <|endoftext|> y", "Éa 日本 's 'll"] + [f"{i} thing" * i for i in range(40)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(1, None), (5, "same id")]
    library = Tokenizer.from_file(packing.MODEL)
    want = collections.Counter()
    for doc, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at, size = 0, (len(ids) - 1) % 1024 + 1
        piece = 0
        while at < len(ids):
            want[doc, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, size, piece = at + size, 1024, piece + 1
    docs = make_docs(rows).repartition(5)
    got = packing.pack_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) == -(-sum(r.length for r in got) // 1024)
    seq = packing.sequences(docs).collect()
    assert len(seq) == len(by) and all(len(r.ids) == sum(r.lengths) <= 1024 for r in seq)
    assert packing.pack_documents(make_docs(rows).limit(0)).count() == 0
