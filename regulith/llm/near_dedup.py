"""Near-duplicates by improved consistent weighted sampling (ICWS).

A text is the multiset of its five-word shingles (lower-cased words between
white space), weighted by TF-IDF. The inverse document frequency is 1 up to a
share of COMMON of all rows and falls with the logarithm above, to FLOOR at
least, so only shingles that a tenth of the corpus repeats count for less; there
are at most (mean shingles / COMMON) of them, which bounds what is broadcast.

ICWS draws HASHES samples of each text; each is the same for two texts with a
probability equal to their weighted Jaccard similarity. (r, c, beta) of a
shingle come from a table of 2**16 triples by 16 bits of its hash. Samples are
banded ROWS at a time; texts that share a band are candidates, and candidates
are verified by the exact weighted Jaccard similarity of whole texts, 0.8 or
more. Texts whose total weights differ by more can't reach it and are left out.

Equal texts are one node from the start. In a band bucket of up to SMALL nodes
all pairs are candidates. In a larger one all are compared with LEADERS leaders,
which merges what is much alike. The texts of large buckets that hold several
classes after that meet by an exact prefix filter: with shingles in one fixed
order, rare ones first, two texts of similarity SIMILAR share a shingle before
the rest of either text weighs less than SIMILAR of it. All pairs of different
classes that share such a shingle are candidates if what is left of both texts
from that shingle on could reach it (at the first one they share it must).
Where a shingle has more than MANY texts outside one class, these meet MANY
leaders first, then four times as many, until all texts have led, so no pair is
left out.

Before texts are gathered, candidates pass an exact bound: each bit in which two
bitmaps of hashed shingles differ, and each shingle that one text alone holds,
adds its weight to the difference of the two, which SIMILAR limits.
Classes are connected components of verified links, found by alternating
large-star and small-star steps with lineage cut in the checkpoint folder.

Defined cases: null text counts as empty; a text without words is
like equal texts only; a text of one to four words has all its words as its only shingle; a
row with a null id is a class of its own with a null class id; of rows
that share an id, which count as one document, one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of
from .words import chunks, distinct_words

SHINGLE = 5
SIMILAR = 0.8
HASHES, ROWS = 40, 4
COMMON, FLOOR = 0.1, 0.25
SMALL = 32
LEADERS = 4
MANY = 2048
BITS = 512
#: Counters by which shingles are put in order; what meets in one counter changes the cost only.
SLOTS = 1 << 20
#: Rows of ids, and of texts, that a task may hold before a table of few rows takes more partitions.
TASK_ROWS, TASK_TEXTS = 50_000, 5_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of at most 65,536 texts: number of the text, 48-bit hash, count; sorted by text, then hash."""
    if len(texts) > 1 << 16:
        raise ValueError("too many texts at once")
    words, index, ends = distinct_words(texts)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[index]
    n = np.diff(ends)
    s = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        s[: len(h) - k] = _mix(s[: len(h) - k] ^ h[k:]) if len(h) > k else s[: len(h) - k]
    text = np.repeat(np.arange(len(n)), n)
    ok = np.arange(len(h)) + SHINGLE <= ends[text + 1]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):  # all words of a text that has fewer than a shingle
        more = n[short] > k
        whole[more] = _mix(whole[more] ^ h[ends[short[more]] + k])
    # text number above, 48 bits of hash below: one plain sort
    key = np.concatenate([text[ok], short]).astype(np.uint64) << np.uint64(48) | np.concatenate([s[ok], whole]) >> np.uint64(16)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    counts = np.diff([*new, len(key)])
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & _LOW, counts


class Idf:
    """Inverse document frequencies of the common shingles; 1 for all others."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, rows: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        share = df[order] / max(rows, 1)
        self.values = np.clip(np.log(1 / np.maximum(share, 1e-12)) / np.log(1 / COMMON), FLOOR, 1.0)

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
            hit = self.hashes[at] == s
            out[hit] = self.values[at[hit]]
        return out


class Frequent:
    """Lossy counts: every shingle that a share of the rows holds, with at most that share of the rows missing in its count."""

    def __init__(self, share: float):
        self.share, self.rows = share, 0
        self.h, self.n, self.lost = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def add(self, s: np.ndarray, rows: int) -> None:
        h, n = np.unique(s, return_counts=True)
        new, lost = n.astype(float), np.full(len(h), self.share * self.rows)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hit = self.h[at] == h
            self.n[at[hit]] += new[hit]
            h, new, lost = h[~hit], new[~hit], lost[~hit]
        self.rows += rows
        h, n, lost = np.concatenate([self.h, h]), np.concatenate([self.n, new]), np.concatenate([self.lost, lost])
        stay = np.flatnonzero(n + lost >= self.share * self.rows)
        stay = stay[np.argsort(h[stay])]
        self.h, self.n, self.lost = h[stay], n[stay], lost[stay]


def common_shingles(docs: DataFrame, rows: int) -> Idf:
    """Exact document frequencies of the shingles that more than COMMON of all rows hold.

    Each partition proposes what a quarter of that share of its rows may hold;
    proposals below three quarters of the share in sum are out, and what is
    left, a bounded list, is counted exactly in a second pass (only if there is
    any). Neither step depends on how the rows are dealt out.
    """
    texts = docs.select(F.lit(0).alias("z"), text_of().alias("text"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Frequent(COMMON / 4)
        for part in chunks(batches):
            found.add(shingles(part.column(1))[1], part.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(found.h.view(np.int64)), pa.array(found.n.astype(np.int64))], ["h", "n"])

    frequent = texts.mapInArrow(propose, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= 0.75 * COMMON * rows).select("h")
    found = np.array([r.h for r in frequent.collect()], np.int64).view(np.uint64)
    if not len(found):
        return Idf(found, np.zeros(0), rows)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(found))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for part in chunks(batches):
            s = shingles(part.column(1))[1]
            at = np.minimum(np.searchsorted(shared.value, s), len(shared.value) - 1)
            total += np.bincount(at[shared.value[at] == s], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.view(np.int64)), pa.array(total)], ["h", "n"])

    exact = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > COMMON * rows).collect()
    return Idf(np.array([r.h for r in exact], np.int64).view(np.uint64), np.array([r.n for r in exact], float), rows)


def bitmaps(text: np.ndarray, s: np.ndarray, n: int) -> pa.Array:
    """For each of n texts, which of BITS cells its shingles fall in."""
    cells = np.zeros((n, BITS), bool)
    cells[text, (s % np.uint64(BITS)).astype(np.int64)] = True
    return pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(cells, axis=1, bitorder="little").view(np.int64).ravel()), BITS // 64).cast(pa.list_(pa.int64()))


class Sampler:
    """ICWS with a table of (r, c, beta)."""

    def __init__(self, hashes: int = HASHES, rows: int = ROWS, seed: int = 11):
        g = np.random.default_rng(seed)
        self.r, log_c, self.beta = g.gamma(2, 1, 1 << 16), np.log(g.gamma(2, 1, 1 << 16)), g.random(1 << 16)
        self.log_c = log_c
        value = log_c + self.r * self.beta - self.r  # of weight 1, where t is 0
        order = np.argsort(value, kind="stable")
        self.sorted = value[order]
        self.rank = np.empty(1 << 16, np.uint64)
        self.rank[order] = np.arange(1 << 16, dtype=np.uint64)
        self.rank <<= np.uint64(48)
        self.seeds = g.integers(1, 1 << 62, hashes).astype(np.uint64)
        self.rows = rows

    def samples(self, s: np.ndarray, w: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Samples ``[hash, text]`` of texts whose shingles begin at ``begin``."""
        other = np.flatnonzero(w != 1.0)
        log_w = np.log(w[other])
        out = np.empty((len(self.seeds), len(begin)), np.uint64)
        for k, seed in enumerate(self.seeds):
            h = _mix(s ^ seed)
            at = (h >> np.uint64(48)).astype(np.int64)
            key = self.rank[at] | (h & _LOW)
            if len(other):
                a, hh = at[other], h[other]
                t = np.floor(log_w / self.r[a] + self.beta[a])
                value = self.log_c[a] - self.r[a] * (t - self.beta[a]) - self.r[a]
                rank = np.minimum(np.searchsorted(self.sorted, value), (1 << 16) - 1).astype(np.uint64) << np.uint64(48)
                key[other] = rank | (np.where(t == 0, hh, _mix(hh ^ t.astype(np.int64).view(np.uint64))) & _LOW)
            out[k] = np.minimum.reduceat(key, begin)
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        """Band keys ``[text, band]``."""
        keys = []
        for b in range(0, len(samples), self.rows):
            key = np.full(samples.shape[1], b + 1, np.uint64)
            for row in samples[b : b + self.rows]:
                key = _mix(key ^ row) + np.uint64(b + 1)
            keys.append(key)
        return np.stack(keys, 1)


def signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """``doc_id, dig, w, bits, bands`` of every row with an id; ``dig`` is the text's md5, ``w`` its total weight, ``bits`` the bitmap of shingles of weight 1."""
    shared = docs.sparkSession.sparkContext.broadcast((idf, Sampler()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sampler = shared.value
        width = len(sampler.seeds) // sampler.rows
        for part in chunks(batches, 2):
            text, s, n = shingles(part.column(2))
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(s) else np.zeros(0, int)
            idfs = idf.of(s)
            w, plain = n * idfs, idfs == 1.0
            keys = sampler.bands(sampler.samples(s, w, begin)) if len(s) else np.zeros((0, width), np.uint64)
            some = np.zeros(part.num_rows, np.int32)
            some[text[begin]] = width  # a text without words has no bands
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.bincount(text, w, part.num_rows)), bitmaps(text[plain], s[plain], part.num_rows), bands], ["doc_id", "dig", "w", "bits", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text_of())).alias("dig"), text_of().alias("text"))
    return rows.filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, dig binary, w double, bits array<long>, bands array<long>")


def similarities(a: pa.Array, b: pa.Array, idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(a)
    text, s, count = shingles(pa.concat_arrays([a, b]))
    w = count * idf.of(s)
    pair = text % n
    key = pair.astype(np.uint64) << np.uint64(48) | s
    order = np.argsort(key)
    key, pair, w = key[order], pair[order], w[order]
    both = np.flatnonzero(key[1:] == key[:-1])
    shared = np.bincount(pair[both], np.minimum(w[both], w[both + 1]), n)
    return shared / np.maximum(np.bincount(pair, w, n) - shared, 1e-12)


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf) -> DataFrame:
    """The pairs ``a, b`` whose texts (``id, text``) are similar."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 3):
            like = similarities(part.column(2), part.column(3), shared.value) >= SIMILAR - 1e-9
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(like))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def packed(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """In as few partitions as ``rows`` rows need; a table of many rows keeps what it has."""
    return df.coalesce(max(1, -(-rows // each)))


def components(edges: DataFrame, rows: int) -> DataFrame:
    """``node, label`` (least node of the component) of every node that has a link; ``rows``: how many links there are."""
    pack = lambda df: packed(df, rows)
    edges = cut(pack(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()))
    state = None
    while True:
        both = pack(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pack(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        edges = cut(pack(pack(small.select("e.*").filter("u <> v")).distinct()))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    stars = pack(edges.groupBy("u").agg(F.min("v").alias("label")))
    return pack(stars.select(F.col("u").alias("node"), "label").unionByName(stars.select(F.col("label").alias("node"), "label").distinct()))


def _could(a: str, b: str, more: Column | None = None) -> Column:
    """Whether texts with weights ``w`` and bitmaps ``bits`` (in structs a and b) that differ by ``more`` besides can be similar."""
    wa, wb = F.col(f"{a}.w"), F.col(f"{b}.w")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(BITS // 64)])
    if more is not None:
        differ = differ + more
    return (F.least(wa, wb) >= F.greatest(wa, wb) * (SIMILAR - 1e-9)) & (differ <= (wa + wb) * ((1 - SIMILAR) / (1 + SIMILAR) + 1e-9))


def candidate_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs to verify, of rows ``key, n, id, w, bits``: all of small buckets, those with a leader in large ones."""
    this = F.struct("id", "w", "bits")
    groups = buckets.filter(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(this).alias("g"))
    pairs = groups.select(F.explode("g").alias("x"), "g").select("x", F.explode("g").alias("y")).filter((F.col("x.id") < F.col("y.id")) & _could("x", "y"))
    large = buckets.filter(F.col("n") > SMALL)
    leaders = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("o"), "id", "w", "bits")) for i in range(LEADERS)]
    lead = large.groupBy("key").agg(F.array_distinct(F.array(*(x.dropFields("o") for x in leaders))).alias("leaders"))
    star = large.join(lead, "key").select(this.alias("x"), F.explode("leaders").alias("y")).filter((F.col("x.id") != F.col("y.id")) & _could("x", "y"))
    return pairs.unionByName(star).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def prefixes(texts: DataFrame, idf: Idf) -> DataFrame:
    """Of each text (``id, class, text``) the shingles of which two similar texts share one: ``key, id, class, w, left, alone, bits``.

    ``left`` is the weight from the shingle on, ``alone`` that of all shingles
    that no other text holds, ``bits`` the bitmap of the others of weight 1.
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    texts = texts.select("id", "text", "class")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for part in chunks(batches):
            n += np.bincount((shingles(part.column(1))[1] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        n = n.reshape(-1, len(wide))
        some = np.flatnonzero(n.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x) for x in n[some].T)], ["row", *wide])

    # a slot that one text alone fills joins nothing; the driver receives SLOTS numbers at most
    wide = [f"n{i}" for i in range(32)]
    often = texts.mapInArrow(count, ", ".join(f"{x} long" for x in ["row", *wide])).groupBy("row").agg(*(F.sum(x).alias(x) for x in wide)).toArrow()
    held = np.zeros((SLOTS // len(wide), len(wide)), np.uint32)
    held[often.column("row").to_numpy()] = np.minimum(np.stack([often.column(x).to_numpy() for x in wide], 1), np.iinfo(np.uint32).max)
    held = np.where(held > 1, held, 0).ravel()
    held = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text, s, n = shingles(part.column(1))
            idfs = shared.value.of(s)
            w = n * idfs
            often = held.value[(s % np.uint64(SLOTS)).astype(np.int64)]
            total, alone = np.bincount(text, w, part.num_rows), np.bincount(text, w * (often == 0), part.num_rows)
            plain = (idfs == 1.0) & (often > 0)
            bits = bitmaps(text[plain], s[plain], part.num_rows)
            order = np.lexsort((s, often, text))
            text, s, w, often = text[order], s[order], w[order], often[order]
            begin = np.concatenate([[0.0], np.cumsum(total)[:-1]])
            left = total[text] - (np.cumsum(w) - w - begin[text])
            stay = (left >= (SIMILAR - 1e-6) * total[text]) & (often > 0)
            at = text[stay]
            columns = [pa.array(s[stay].view(np.int64)), part.column(0).take(pa.array(at)), part.column(2).take(pa.array(at)), pa.array(total[at]), pa.array(left[stay]), pa.array(alone[at]), bits.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "class", "w", "left", "alone", "bits"])

    return texts.mapInArrow(run, "key long, id long, class long, w double, left double, alone double, bits array<long>")


def cross_pairs(buckets: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different classes in buckets as ``prefixes`` gives them, and the keys of those that need another turn.

    Texts outside a bucket's largest class meet all texts, or in buckets of
    more than ``MANY * 4**turn`` texts about as many leaders.
    """
    most = MANY * 4**turn
    sizes = buckets.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c"))
    info = cut(sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "class")).alias("top")).filter("n > top.c"))
    this = F.struct("id", "w", "left", "alone", "bits", "class")
    rows = cut(buckets.join(info, "key").select("key", "n", "top.class", this.alias("x")).toDF("key", "n", "top", "x"))
    chance = F.pmod(F.xxhash64("x.id", F.lit(turn)), F.lit(1 << 20)) < F.lit(most << 20) / F.col("n")
    lead = rows.filter((F.col("n") <= most) | chance).select("key", F.col("x").alias("y"))
    rest = rows.filter(F.col("x.class") != F.col("top")).select("key", "x")
    w = F.col("x.w") + F.col("y.w")
    reach = F.least("x.left", "y.left") >= w * (SIMILAR / (1 + SIMILAR) - 1e-6)
    met = lead.join(rest, "key").filter((F.col("x.class") != F.col("y.class")) & reach & _could("x", "y", F.col("x.alone") + F.col("y.alone")))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), info.filter(F.col("n") > most).select("key")


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, dig, class_id, class_size, kept``: a row per input row; the row with the class's least id is kept."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    idf = common_shingles(docs, docs.count())
    signed = cut(signatures(docs, idf))
    nodes = cut(signed.groupBy("dig").agg(F.min(F.struct("doc_id", "w", "bits", "bands")).alias("x")).select("dig", F.col("x.doc_id").alias("id"), "x.w", "x.bits", "x.bands"))
    first = nodes.select(F.explode("bands").alias("key"), "id", "w", "bits")
    sizes = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = cut(first.join(sizes, "key"))
    members = buckets.filter(F.col("n") > SMALL).select("key", "id")
    pairs = cut(candidate_pairs(buckets))
    # later steps compare texts of large buckets only, so the texts are gathered once
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct()
    wanted = ids.join(nodes.select("id", "dig"), "id").select(F.col("id").alias("doc_id"), "dig")
    marked = docs.select("doc_id", F.unhex(F.md5(text_of())).alias("dig"), text_of().alias("text"))
    found = marked.join(wanted, ["doc_id", "dig"], "left_semi").dropDuplicates(["doc_id", "dig"])
    texts = cut(found.select(F.col("doc_id").alias("id"), "text"))
    links, labels, done, linked = None, None, None, 0

    def classed(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("class", F.col("id"))
        return rows.join(labels, rows.id == labels.node, "left").withColumn("class", F.coalesce("label", "id")).drop("node", "label")

    def verify(pairs: DataFrame) -> None:
        nonlocal links, labels, done, linked
        if done is not None:
            pairs = cut(pairs.join(done, ["a", "b"], "left_anti"))
        n = pairs.count()
        done = pairs if done is None else done.unionByName(pairs)
        if not n:
            return
        more = cut(verified(packed(pairs, n), texts, idf))
        if new := more.count():
            links = more if links is None else links.unionByName(more)
            linked += new
            labels = cut(components(links, linked))

    verify(pairs)
    # large buckets of one class are done with, as classes only merge
    open_keys = classed(members).groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key")
    open_ids = cut(classed(members.join(open_keys, "key", "left_semi").select("id").distinct()))
    if n := open_ids.count():
        # counts of shingles meet in few tasks, so that each sends a slot once
        rare = cut(prefixes(cut(packed(texts.join(open_ids, "id"), n, TASK_TEXTS)), idf))
        turn = 0
        while not rare.isEmpty():
            pairs, again = cross_pairs(rare, turn)
            verify(cut(pairs))
            rare = rare.join(again, "key", "left_semi").drop("class")
            rare = cut(rare.join(classed(rare.select("id").distinct()), "id"))
            turn += 1
    found = nodes.select("dig", "id") if labels is None else nodes.join(labels, nodes.id == labels.node, "left").select("dig", F.coalesce("label", "id").alias("id"))
    placed = signed.select("doc_id", "dig").join(found, "dig").select("doc_id", "dig", F.col("id").alias("class_id"))
    sizes = placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    placed = placed.join(sizes, "class_id")
    again = Window.partitionBy("doc_id", "class_id").orderBy("dig")
    stay = placed.filter("doc_id = class_id").withColumn("kept", F.row_number().over(again) == 1)
    gone = placed.filter("doc_id <> class_id").withColumn("kept", F.lit(False))
    alone = docs.filter("doc_id IS NULL").select("doc_id", F.unhex(F.md5(text_of())).alias("dig"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    columns = ["doc_id", "dig", "class_id", "class_size", "kept"]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in (stay, gone, alone)])


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that stay: one of each class. (Rows of one id and text stay or go together.)"""
    stay = near_classes(docs).filter("kept").select(F.col("doc_id").alias("d"), F.col("dig").alias("g"))
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.unhex(F.md5(text_of(F.col("text").cast("string")))) == F.col("g")), "left_semi")
