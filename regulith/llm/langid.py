"""Language identification with interpolated Kneser-Ney character models.

One model of order ORDER per language over the letters of lower-cased words
(each word with its end; contexts do not cross words). Discounted probabilities
and back-off masses are stored in sorted arrays of 64-bit n-gram hashes, one
column per language. A text gets the language of the lowest cross-entropy per
letter over all its words. Its score is a logistic function of the margin to
the second language and the number of letters, calibrated on rows that the
models have not seen. So is rejection: a text goes if its cross-entropy, less the
median and shrunk for short texts, is above what all but ``FALSE`` of such rows
show (the conformal quantile, which bounds the share of labelled texts that are
rejected); with fewer than 1 / FALSE rows to calibrate on there is no such bound
and nothing is rejected for its cost.

Training takes the ``PER_LANG`` rows of each language with the smallest hash of
their id (a documented, bounded sample of labelled rows): those of crc32 fold 0
for counts, of fold 2 for calibration, never fold 1. The prediction reads whole
texts of all rows and nothing but the text.

Defined cases: null texts, empty texts and texts without a letter are ``und``
with score 0 and rejected; without any labelled row everything is ``und``; a
single known language gets score 1; ties go to the first language in code point
order; repeated rows and null ids are predicted like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold
from .words import chunks, distinct_words, sums

ORDER = 4
PER_LANG = 400
#: Share of labelled texts that may be rejected, and the letters at which a text's excess counts for 0.7 of itself.
FALSE, SHORT = 0.001, 20
#: Distinct words that are handled at once.
BLOCK = 8_000
UND = "und"
_END = 0x110000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(_END)), bool, _END)
    return _letters


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _MULT
    return h ^ (h >> np.uint64(29))


def _units(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the words, each word with an end mark: symbols, place in the word, number of the word. Words without letters have none."""
    codes = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = codes == 10
    word = np.cumsum(ends) - ends
    letter = letters()[codes]
    any_letter = np.zeros(len(words), bool)
    any_letter[word[letter]] = True
    keep = letter | (ends & any_letter[word])
    sym = np.where(ends, _END, codes)[keep].astype(np.uint64)
    word = word[keep]
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
    place = np.arange(len(word)) - np.repeat(begin, np.diff([*begin, len(word)]))
    return sym, place, word


def _grams(sym: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each symbol, n = 1 to order; 0 where the word is too short."""
    out = []
    for n in range(1, order + 1):
        h = np.full(len(sym), n, np.uint64)
        for back in range(n - 1, -1, -1):
            h = _mix(h, np.concatenate([np.zeros(back, np.uint64), sym])[: len(sym)])
        h[place < n - 1] = 0
        out.append(h)
    return out


def _contexts(sym: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the contexts (the n - 1 symbols before), as ``_grams`` hashes them."""
    before = np.concatenate([np.zeros(1, np.uint64), sym[:-1]]) if len(sym) else sym
    return [np.zeros(len(sym), np.uint64), *(g for g in _grams(before, place - 1, order)[: order - 1])]


@dataclass
class Models:
    """Kneser-Ney models of all languages in sorted hash arrays."""

    langs: list[str]
    order: int = ORDER
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: tuple[float, float] = (4.0, 0.0)
    middle: float = 0.0
    limit: float = np.inf

    def fit(self, counts: dict[str, tuple[list[str], np.ndarray]]) -> Models:
        """From the words of each language and their counts."""
        # one language and block of words at a time: what is kept are distinct n-grams
        found: list[list[tuple]] = [[] for _ in range(self.order)]
        symbols: set[int] = set()
        for lang in self.langs:
            words, n = counts[lang]
            blocks: list[list[tuple]] = [[] for _ in range(self.order)]
            for a in range(0, len(words), BLOCK):
                sym, place, word = _units(words[a : a + BLOCK])
                symbols |= set(np.unique(sym).tolist())
                weight = n[a + word].astype(float)
                grams, ctx = _grams(sym, place, self.order), _contexts(sym, place, self.order)
                for k in range(self.order):
                    ok = place >= k
                    h, first, inverse = np.unique(grams[k][ok], return_index=True, return_inverse=True)
                    shorter = grams[k - 1][ok][first] if k else h
                    blocks[k].append((h, ctx[k][ok][first], shorter, np.bincount(inverse, weight[ok], len(h)), np.bincount(inverse, (weight * (place == k))[ok], len(h))))
            self._count(blocks, found)
        self.base = np.full(len(self.langs), 1.0 / (len(symbols) + 1))
        for found_n in found:
            keys = np.unique(np.concatenate([f[0] for f in found_n]))
            cks = np.unique(np.concatenate([f[2] for f in found_n]))
            p, lam = np.zeros((len(keys), len(self.langs)), np.float32), np.ones((len(cks), len(self.langs)), np.float32)
            for j, (h, a, cu, m) in enumerate(found_n):
                p[np.searchsorted(keys, h), j] = a
                lam[np.searchsorted(cks, cu), j] = m
            self.grams.append((keys, p))
            self.contexts.append((cks, lam))
        return self

    def _count(self, blocks: list[list[tuple]], found: list[list[tuple]]) -> None:
        """Discounted probabilities and back-off masses of one language, for each order."""
        merged = []
        for parts in blocks:
            h, ctx, shorter, w, begins = (np.concatenate(x) for x in zip(*parts, strict=True))
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            merged.append((h, ctx[first], shorter[first], np.bincount(inverse, w, len(h)), np.bincount(inverse, begins, len(h))))
        for k, (h, ctx, _, w, begins) in enumerate(merged):
            if k == self.order - 1:
                c = w
            else:  # how many symbols stand before it; what begins a word counts as often as it does
                c = np.bincount(np.searchsorted(h, merged[k + 1][2]), minlength=len(h)) + begins
            ones, twos = (c == 1).sum(), (c == 2).sum()
            cut = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))
            cu, ci = np.unique(ctx, return_inverse=True)
            total = np.bincount(ci, c, len(cu))
            less = np.minimum(c, cut)
            found[k].append((h, (c - less) / total[ci] if len(h) else c, cu, np.bincount(ci, less, len(cu)) / np.maximum(total, 1e-9)))

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        sorted_keys, values = table
        if not len(sorted_keys):
            return np.full((len(keys), values.shape[1]), missing, np.float32)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        got = values[at]
        got[sorted_keys[at] != keys] = missing
        return got

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log-probability of each word under each language, and its number of symbols."""
        out, n = np.zeros((len(words), len(self.langs))), np.zeros(len(words), np.int64)
        for at in range(0, len(words), BLOCK):
            sym, place, word = _units(words[at : at + BLOCK])
            few = len(words[at : at + BLOCK])
            n[at : at + few] = np.bincount(word, minlength=few)
            if not len(sym):
                continue
            p = np.tile(self.base.astype(np.float32), (len(sym), 1))
            for k, (g, c) in enumerate(zip(_grams(sym, place, self.order), _contexts(sym, place, self.order), strict=True)):
                deep = np.flatnonzero(place >= k)
                p[deep] = self._look(self.grams[k], g[deep], 0.0) + self._look(self.contexts[k], c[deep], 1.0) * p[deep]
            logs = -np.log(np.maximum(p, 1e-12))
            for j in range(len(self.langs)):
                out[at : at + few, j] = np.bincount(word, logs[:, j], few)
        return out, n

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text and language, and the number of symbols."""
        words, index, ends = distinct_words(texts)
        cost, n = self.words(words)
        long = sums(n[index].astype(float), ends)
        return sums(cost[index], ends) / np.maximum(long, 1)[:, None], long

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, n = self.entropies(texts)
        best = np.argmin(h, axis=1)
        low = h[np.arange(len(h)), best]
        score = self.score(h, n)
        none = n == 0
        langs = [UND if x else self.langs[b] for x, b in zip(none, best, strict=True)]
        return langs, np.where(none, 0.0, score), none | (self.excess(low, n) > self.limit)

    def excess(self, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far the cross-entropy of texts of n letters is above the median."""
        return (low - self.middle) * np.sqrt(n / (n + SHORT))

    def features(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        two = np.sort(h, axis=1)[:, :2]
        return (two[:, 1] - two[:, 0]) * np.sqrt(np.maximum(n, 1))

    def score(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        if len(self.langs) < 2:
            return np.ones(len(h))
        a, b = self.slope
        return 1 / (1 + np.exp(-np.clip(a * self.features(h, n) + b, -30, 30)))

    def calibrate(self, held: pa.Table) -> Models:
        """Fit the score (ridge logistic regression by Newton steps) and the rejection limit on ``lang, text`` rows."""
        parts = [self.entropies(part.column(1)) for part in chunks(held.to_batches(), most=1 << 19)]
        h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        truth = held.column(0).to_pylist()
        use = n > 0
        if not use.any():
            return self
        best = np.argmin(h, axis=1)
        right = np.array([self.langs[b] == t for b, t in zip(best, truth, strict=True)])
        low = h[np.arange(len(h)), best]
        self.middle = float(np.median(low[use]))
        rank = int(np.ceil((use.sum() + 1) * (1 - FALSE)))
        self.limit = float(np.sort(self.excess(low[use], n[use]))[rank - 1]) if rank <= use.sum() else np.inf
        if len(self.langs) > 1:
            x = np.stack([self.features(h, n)[use], np.ones(use.sum())], 1)
            y, w = right[use].astype(float), np.array([1.0, 0.0])
            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                grad = x.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
                # short steps: where all rows are right, a full one overshoots
                w = w - np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad), -0.25, 0.25)
            self.slope = (float(max(w[0], 0.05)), float(w[1]))
        return self


def train(docs: DataFrame, per_lang: int = PER_LANG, order: int = ORDER) -> Models:
    """Models from a bounded sample: the ``per_lang`` rows a language and fold with the smallest id hash."""
    fold = crc_fold()
    first = Window.partitionBy("lang", "fold").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", fold.alias("fold")).filter(F.coalesce("fold", F.lit(0)) != 1)
    ids = known.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= per_lang).select(F.col("doc_id").alias("d"), F.col("fold").alias("f"), F.col("lang").alias("l"))
    # at most per_lang ids for each language and fold, so the ids are few and the texts stay where they are
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))).select("lang", F.coalesce("f", F.lit(0)).alias("fold"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang))
                for part in chunks([own], most=1 << 20):
                    found, index, _ = distinct_words(part.column(1))
                    n = np.bincount(index, minlength=len(found))
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([found[i] for i in some], pa.string()), pa.array(n[some])], ["lang", "word", "n"])

    words = rows.filter("fold = 0").select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, tuple[list[str], np.ndarray]] = {}
    langs = sorted(set(words.column("lang").to_pylist()))
    lang = np.array(words.column("lang").to_pylist(), dtype=object)
    word, n = words.column("word").to_pylist(), words.column("n").to_numpy()
    for x in langs:
        at = np.flatnonzero(lang == x)
        at = at[np.argsort([word[i] for i in at], kind="stable")]
        counts[x] = ([word[i] for i in at], n[at])
    models = Models(langs, order).fit(counts) if langs else Models([])
    if langs:
        held = rows.filter("fold = 2").select("lang", "text").toArrow()
        if held.num_rows:
            models.calibrate(held)
    return models


SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            lang, score, rejected = shared.value.predict(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows, with all their columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, at):
            _, _, rejected = shared.value.predict(part.column(at))
            yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
