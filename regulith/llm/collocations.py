"""Phrase collocations by dynamic itemset counting.

The texts are dealt into shards that are scanned in a cycle. Words are counted
from the first scan on. As soon as both subphrases of a longer phrase (without
its last and without its first word) have reached the threshold in what is
counted so far, the longer phrase is counted too, from the next shard on, until
each shard has been counted once; so phrases of all lengths are counted in the
same scans, and a phrase that cannot reach the threshold is never counted.

Which words and pairs have reached the threshold, and after which scan, is sent
to the tasks as a table of fixed size (``SLOTS`` bytes a length, two places a
phrase). Two phrases that share places can only start a longer one earlier than
needed: it still counts every shard exactly once, so counts stay exact.

Tasks send counts in pages, compressed tables of the phrases of one bucket. The
number of buckets follows from the bytes of text, so that one holds a bounded
number of phrases; beyond ``FAN`` buckets, pages are split up in two steps. What
is counted so far is merged a bucket at a time and written to the shared folder.

Defined cases: null and empty texts have no words; a null lang is ``und``;
repeated rows count as often as they stand there; null ids are read like any
other (ids are not used); very long texts are counted whole; an empty table
gives an empty result; other columns, whatever their names, are not read.
Counts are below 10^13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, shared_folder, text_of
from .words import chunks

LEAST, WORDS, TOP, INSIDE = 10, 3, 2000, 50
SHARDS = 3
#: Bytes of text a bucket, buckets in one step, bytes of text that a task counts at once.
BUCKET_BYTES, FAN, CHUNK = 8 << 20, 1024, 8 << 20
SLOTS, NEVER = 1 << 22, 255
STATE = "level int, bucket int, page binary, block int, mask long, kind string"

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\n" + word)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of what stands left and right."""
    with np.errstate(over="ignore"):
        h = (left ^ (left >> np.uint64(31))) * _A + (right ^ (right >> np.uint64(29))) * _B
        return (h ^ (h >> np.uint64(32))) * _B


def _places(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(slots - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(24)) & low).astype(np.int64)


def _started(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The scan from which on longer phrases may build on each phrase, NEVER if on none."""
    a, b = _places(h, len(table))
    return np.maximum(table[a], table[b])


def _distinct(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes below ``size``, the place of each code among them, and their counts."""
    if size > 8 * len(codes) + (1 << 20):
        return np.unique(codes, return_inverse=True, return_counts=True)
    count = np.bincount(codes, minlength=size)
    found = np.flatnonzero(count)
    place = np.zeros(size, np.int64)
    place[found] = np.arange(len(found))
    return found, place[codes], count[found]


def _page(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _rows(page: bytes) -> pa.Table:
    return pa.ipc.open_stream(page).read_all()


def _pages(level: int, rows: pa.Table, buckets: int, wide: int) -> Iterator[tuple[int, int, bytes]]:
    """``(level, bucket // wide, page)`` of rows with a column ``bucket``."""
    key = rows.column("bucket").to_numpy() // wide
    order = np.argsort(key, kind="stable")
    rows, key = rows.take(pa.array(order)), key[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield level, int(key[a]), _page(rows.slice(a, b - a))


class Scan:
    """Counts of one chunk of texts in scan number ``step``."""

    def __init__(self, step: int, shards: int, buckets: int, started: list[np.ndarray]):
        self.step, self.shards, self.buckets, self.started = step, shards, buckets, started
        self.wide = -(-buckets // FAN)

    def _active(self, since: np.ndarray) -> np.ndarray:
        since = since.astype(np.int16)
        return (since <= self.step) & (self.step < since + self.shards)

    def _out(self, level: int, lang: pa.Array, key: pa.Array, count: np.ndarray, start: np.ndarray, h: np.ndarray):
        bucket = (((h * _A) >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int32)
        rows = pa.table({"lang": lang, "key": key, "count": pa.array(count.astype(np.int64)), "start": pa.array(start.astype(np.uint8)), "bucket": pa.array(bucket)})
        yield from _pages(level, rows, self.buckets, self.wide)

    def pages(self, langs: pa.Array, texts: pa.Array) -> Iterator[tuple[int, int, bytes]]:
        texts = texts.cast(pa.large_binary())
        full = pc.greater(pc.binary_length(texts), 0)
        texts, langs = texts.filter(full), langs.filter(full)
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        firsts = offsets[:-1] - offsets[0]
        kind = _KIND[data]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[firsts] = inside[firsts]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return
        cuts = kind == 2
        cuts[firsts] = True
        piece = np.searchsorted(np.flatnonzero(cuts), starts, "right")
        ends = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, np.count_nonzero(inside))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
        by_lang = langs.dictionary_encode()
        m = len(by_lang.dictionary)
        lang_of_text = by_lang.indices.to_numpy().astype(np.int64)
        code = words.indices.to_numpy().astype(np.int64) * m + lang_of_text[np.searchsorted(firsts, starts, "right") - 1]
        found, at, count = _distinct(code, len(words.dictionary) * m)
        word, lang = found // m, found % m
        names, prefix = words.dictionary.to_pylist(), [x.encode() for x in by_lang.dictionary.to_pylist()]
        h = np.fromiter((_word_hash(prefix[b], names[a]) for a, b in zip(word.tolist(), lang.tolist(), strict=True)), np.uint64, len(found))

        def lang_at(i: np.ndarray) -> pa.Array:
            return by_lang.dictionary.take(pa.array(lang[i]))

        def word_at(i: np.ndarray) -> pa.Array:
            return words.dictionary.take(pa.array(word[i]))

        u = len(found)
        if self.step < self.shards:
            every = np.arange(u)
            yield from self._out(1, lang_at(every), word_at(every), count, np.zeros(u), h)
        if not self.step or len(at) < 2:
            return
        since = _started(h, self.started[0])
        left, right = at[:-1], at[1:]
        pair = np.where(piece[1:] == piece[:-1], np.maximum(since[left], since[right]), NEVER)
        on = self._active(pair)
        if on.any():
            codes, count = np.unique(left[on] * u + right[on], return_counts=True)
            a, b = codes // u, codes % u
            key = pc.binary_join_element_wise(word_at(a), word_at(b), pa.scalar(b" ", pa.large_binary()))
            yield from self._out(2, lang_at(a), key, count, np.maximum(since[a], since[b]), _joined(h[a], h[b]))
        if self.step < 2 or len(at) < 3:
            return
        whole = np.flatnonzero(pair != NEVER)
        got = np.full(len(pair), NEVER, np.uint8)
        # not before the pair itself: where its places were taken earlier by others, the scans before its start were not counted
        got[whole] = np.maximum(_started(_joined(h[left[whole]], h[right[whole]]), self.started[1]), pair[whole])
        on = np.flatnonzero(self._active(np.maximum(got[:-1], got[1:])))
        if len(on):
            pairs, which = np.unique(left[on] * u + right[on], return_inverse=True)
            codes, one, count = np.unique(which * u + at[on + 2], return_index=True, return_counts=True)
            first, c = pairs[codes // u], codes % u
            a, b = first // u, first % u
            key = pc.binary_join_element_wise(word_at(a), word_at(b), word_at(c), pa.scalar(b" ", pa.large_binary()))
            start = np.maximum(got[:-1], got[1:])[on[one]]
            yield from self._out(3, lang_at(a), key, count, start, _joined(_joined(h[a], h[b]), h[c]))


_PAGE = "level int, bucket int, page binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["level", "bucket", "page"])


def _scanned(shard: DataFrame, scan: Scan) -> DataFrame:
    """Pages of one bucket each of what the shard counts."""
    shared = shard.sparkSession.sparkContext.broadcast(scan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=CHUNK):
            if rows := list(shared.value.pages(part.column(0), part.column(1))):
                yield _batch(rows)

    pages = shard.select("lang", "text").mapInArrow(run, _PAGE)
    if scan.wide == 1:
        return pages

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        size = 0
        for batch in batches:
            for level, page in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(level, []).append(_rows(page))
                size += held[level][-1].nbytes
                if size >= 4 * CHUNK:
                    yield _batch([p for k, rows in held.items() for p in _pages(k, pa.concat_tables(rows), scan.buckets, 1)])
                    held, size = {}, 0
        if held:
            yield _batch([p for k, rows in held.items() for p in _pages(k, pa.concat_tables(rows), scan.buckets, 1)])

    return pages.repartition("level", "bucket").mapInArrow(split, _PAGE)


def _merged(pages: DataFrame, step: int, shards: int, least: int, slots: int) -> DataFrame:
    """Rows of STATE: what is still being counted, what is done, and where phrases that reach the threshold stand in the table."""
    schema = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("page", pa.binary()), ("block", pa.int32()), ("mask", pa.int64()), ("kind", pa.string())])

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        level, bucket = key[0].as_py(), key[1].as_py()
        rows = pa.concat_tables([_rows(p) for p in part.column("page").to_pylist()])
        sums = rows.group_by(["lang", "key", "bucket"], use_threads=False).aggregate([("count", "sum"), ("start", "min")]).rename_columns(["lang", "key", "bucket", "count", "start"]).select(["lang", "key", "count", "start", "bucket"])
        count, start = sums.column("count").to_numpy(), sums.column("start").to_numpy().astype(np.int16)
        over, reached = start + shards <= step + 1, count >= least
        out: list[tuple] = []
        if not over.all():
            out.append((level, bucket, _page(sums.filter(pa.array(~over))), None, None, "open"))
        if (over & reached).any():
            out.append((level, bucket, _page(sums.filter(pa.array(over & reached))), None, None, "done"))
        if level == 1 and over.any():  # all words of a lang, frequent or not
            n = sums.filter(pa.array(over)).group_by("lang", use_threads=False).aggregate([("count", "sum")]).rename_columns(["lang", "count"])
            out.append((0, bucket, _page(n.append_column("key", pa.array([b""] * len(n), pa.large_binary()))), None, None, "done"))
        if level < WORDS and reached.any():
            some = sums.filter(pa.array(reached))
            parts = [(lang.encode(), k.split(b" ")) for lang, k in zip(some.column("lang").to_pylist(), some.column("key").to_pylist(), strict=True)]
            h = np.array([_word_hash(lang, ws[0]) for lang, ws in parts], np.uint64)
            for i in range(1, level):
                h = _joined(h, np.array([_word_hash(lang, ws[i]) for lang, ws in parts], np.uint64))
            places = np.unique(np.concatenate(_places(h, slots)))
            block = places >> 6
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            masks = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), edges).view(np.int64)
            out += [(level, bucket, None, b, m, "mask") for b, m in zip(block[edges].tolist(), masks.tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return pages.groupBy("level", "bucket").applyInArrow(merge, STATE)


def frequent_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> DataFrame:
    """``level, lang, phrase, f``: all phrases of up to three words that occur ``least`` times, and at level 0 each lang's number of words."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    texts.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).write.partitionBy("shard").parquet(f"{folder}/shards")
    dealt = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/shards")
    size = dealt.agg(F.sum(F.octet_length("text")).alias("n")).head().n or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    started = [np.full(SLOTS, NEVER, np.uint8) for _ in range(WORDS - 1)]
    last, step = shards - 1, 0  # the last scan that something needs
    while step <= last:
        pages = _scanned(dealt.filter(F.col("shard") == step % shards), Scan(step, shards, buckets, started))
        if step:
            pages = pages.unionByName(_state(spark, folder, step - 1, "open").select("level", "bucket", "page"))
        _merged(pages, step, shards, least, SLOTS).write.partitionBy("kind").parquet(f"{folder}/state/step={step}")
        masks = _state(spark, folder, step, "mask").groupBy("level", "block").agg(F.bit_or("mask").alias("mask")).collect()  # at most SLOTS / 64 rows a level
        for level, table in enumerate(started, 1):
            own = [r for r in masks if r.level == level]
            bits = np.unpackbits(np.array([r.mask for r in own], np.int64).view(np.uint8), bitorder="little").reshape(-1, 64)
            places = (np.array([r.block for r in own], np.int64)[:, None] * 64 + np.arange(64))[bits.astype(bool)]
            new = places[table[places] == NEVER]
            table[new] = step + 1
            if len(new):
                last = max(last, step + shards)
        if step:
            remove(spark, f"{folder}/state/step={step - 1}/kind=open")
        step += 1
    remove(spark, f"{folder}/shards")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _rows(page)
                for b in pa.table({"level": pa.array([level] * len(rows), pa.int32()), "lang": rows.column("lang"), "phrase": rows.column("key").cast(pa.string()), "f": rows.column("count")}).to_batches():
                    yield b

    done = spark.read.schema(f"{STATE}, step int").parquet(f"{folder}/state").filter("kind = 'done'")
    return done.select("level", "page").mapInArrow(explode, "level int, lang string, phrase string, f long")


def _state(spark: SparkSession, folder: str, step: int, kind: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{folder}/state/step={step}").filter(F.col("kind") == kind)


def _score() -> Column:
    """floor(1000000 a a / (l r)) in decimals, which hold the products."""
    a, left, right = (F.col(c).cast("decimal(13,0)") for c in ("a", "l", "r"))
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (a * a), left * right)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: of each lang the ``top`` phrases by score."""
    found = frequent_phrases(docs, least, shards)

    def of(level: int, phrase: str, f: str) -> DataFrame:
        return found.filter(F.col("level") == level).select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))

    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    head, tail = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    triples = of(3, "phrase", "a").withColumns({"first": first, "last": last, "head": head, "tail": tail})
    longest = triples.select("lang", "a", F.explode(F.array("head", "tail")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = (
        of(2, "phrase", "a")
        .join(longest, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
        .drop("longer")
        .withColumns({"first": first, "last": last})
        .join(of(1, "first", "l"), ["lang", "first"])
        .join(of(1, "last", "r"), ["lang", "last"])
    )
    early = triples.join(of(1, "first", "l"), ["lang", "first"]).join(of(2, "tail", "r"), ["lang", "tail"]).withColumn("early", F.struct(_score().alias("score"), F.lit(1).alias("k"), "l", "r")).drop("l", "r")
    both = early.join(of(2, "head", "l"), ["lang", "head"]).join(of(1, "last", "r"), ["lang", "last"]).withColumn("best", F.least("early", F.struct(_score().alias("score"), F.lit(2).alias("k"), "l", "r")))
    columns = ["lang", "phrase", "a"]
    rated = pairs.select(*columns, "l", "r", _score().alias("score")).unionByName(both.select(*columns, "best.l", "best.r", "best.score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = rated.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = found.filter("level = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists WHERE len(ws) > 0),
words AS (SELECT lang, ws[i] AS w, count(*) AS f FROM spots GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM words GROUP BY lang),
pairs AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM spots WHERE i < len(ws) GROUP BY ALL HAVING count(*) >= 10),
triples AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM spots WHERE i + 1 < len(ws) GROUP BY ALL HAVING count(*) >= 10),
inner2 AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM triples UNION ALL SELECT lang, w2, w3, f FROM triples) GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM pairs p JOIN words x ON x.lang = p.lang AND x.w = p.w1 JOIN words y ON y.lang = p.lang AND y.w = p.w2
  LEFT JOIN inner2 o ON o.lang = p.lang AND o.w1 = p.w1 AND o.w2 = p.w2 WHERE o.f IS NULL OR 100 * o.f < 50 * p.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM triples t JOIN words x ON x.lang = t.lang AND x.w = t.w1 JOIN pairs y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM triples t JOIN pairs x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN words y ON y.lang = t.lang AND y.w = t.w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE pick = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
