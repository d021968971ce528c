"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Every word gives the network word inputs (a hashed, learned embedding and the
word's smoothed log-odds in the training rows) and character inputs (the mean
of hashed, learned embeddings of its character n-grams and their strongest
log-odds). Two GRUs read windows of LENGTH words that overlap by half, forward
and backward; attention pools their states into a logit per window. The score
of a text is a calibrated logistic function of its highest window, over all
overlapping windows of the whole text.

Training is plain numpy on the driver over a bounded sample of labelled rows
(``PER_CLASS``: the most rows of label 1 and of label 0, by smallest id hash),
never rows of crc32 fold 1. A label holds for a document, not for its windows,
so in each epoch a document trains by its currently highest window (label 0
also by a random one). A fifth of the sample is kept aside to set the cut: the
logit of best F0.5 becomes score 0.7.

Defined cases: null and empty texts and texts without a word score 0; rows with
null labels do not train; with labels of one kind only, every score is the
share of label 1 in the sample; repeated rows and null ids are scored like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold
from .langid import _END, _mix, _units
from .words import chunks, distinct_words

PER_CLASS = {1: 800, 0: 1600}
LENGTH, STEP = 24, 12
HIDDEN, EMBED = 8, 4
WORD_ROWS, GRAM_ROWS, ODDS_ROWS = 1 << 13, 1 << 14, 1 << 18
SIZES = (3, 4, 5)
EPOCHS, STEPS, BATCH, RATE = 8, 640, 64, 0.02
CUT = 0.7
_FEATURES = 2 + 2 * EMBED
_BLOCK = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Words:
    """Hashes of distinct words and of their character n-grams (n-grams of word i: ``grams[at[i]:at[i + 1]]``)."""

    word: np.ndarray
    grams: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Words:
        sym, place, owner = _units(words)
        whole = np.full(len(words), 7, np.uint64)
        grams, owners = [], []
        if len(sym):
            begin = np.flatnonzero(place == 0)
            whole[owner[begin]] = np.bitwise_xor.reduceat(_mix(_mix(np.uint64(11) + place.astype(np.uint64), sym), sym), begin)
            for n in SIZES:
                m = len(sym) - n + 1
                if m <= 0:
                    continue
                h = np.where(place[:m] == 0, np.uint64(n), np.uint64(n + 16))  # what begins a word is told from what stands inside
                for k in range(n):
                    h = _mix(h, sym[k : k + m])
                ok = (owner[:m] == owner[n - 1 :]) & (sym[:m] != _END)
                grams.append(h[ok])
                owners.append(owner[:m][ok])
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(o, kind="stable")
        return Words(whole, g[order], np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(words)))]).astype(np.int64))

    def take(self, i: np.ndarray) -> Words:
        n = self.at[i + 1] - self.at[i]
        at = np.concatenate([[0], np.cumsum(n)])
        pick = np.arange(at[-1]) + np.repeat(self.at[i] - at[:-1], n)
        return Words(self.word[i], self.grams[pick], at)

    def pooled(self, values: np.ndarray, how: np.ufunc) -> np.ndarray:
        """``values`` of the n-grams reduced for each word, 0 for words without any."""
        out = np.zeros((len(self.word), *values.shape[1:]), values.dtype)
        some = np.flatnonzero(self.at[1:] > self.at[:-1])
        if len(some):
            out[some] = how.reduceat(values, self.at[some], axis=0)
        return out


def _row(h: np.ndarray, rows: int) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (rows - 1)


def _windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of texts with words ``ends[i]:ends[i+1]``: first word, length, text."""
    n = np.diff(ends)
    count = np.where(n > 0, np.maximum(1, -(-(n - LENGTH) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = ends[text] + nth * STEP
    return first, np.minimum(LENGTH, ends[text + 1] - first), text


@dataclass
class Network:
    """Parameters and numpy passes of the network."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    word_odds: np.ndarray = field(default_factory=lambda: np.zeros(ODDS_ROWS, np.float32))
    gram_odds: np.ndarray = field(default_factory=lambda: np.zeros(ODDS_ROWS, np.float32))
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        g = np.random.default_rng(seed)
        draw = lambda *shape, by=0.3: (g.standard_normal(shape) * by).astype(np.float32)
        p = {"words": draw(WORD_ROWS, EMBED, by=0.05), "grams": draw(GRAM_ROWS, EMBED, by=0.05), "attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"x{d}": draw(_FEATURES, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return Network(p)

    def features(self, w: Words) -> np.ndarray:
        odds = w.pooled(self.gram_odds[_row(w.grams, ODDS_ROWS)], np.maximum)
        n = np.maximum(w.at[1:] - w.at[:-1], 1)[:, None]
        chars = w.pooled(self.p["grams"][_row(w.grams, GRAM_ROWS)], np.add) / np.sqrt(n)
        return np.concatenate([self.word_odds[_row(w.word, ODDS_ROWS)][:, None], odds[:, None], self.p["words"][_row(w.word, WORD_ROWS)], chars], 1).astype(np.float32)

    def _gru(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of a GRU over ``x[t]`` (gate inputs); masked steps leave the state as it is."""
        k = HIDDEN
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((len(x), x.shape[1], k), np.float32)
        for t in range(len(x)):
            v = h @ u
            zr = _sigmoid(x[t, :, : 2 * k] + v[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            new = np.tanh(x[t, :, 2 * k :] + r * v[:, 2 * k :])
            if keep is not None:
                keep.append((h, z, r, new, v[:, 2 * k :]))
            h = h + mask[t] * ((1 - z) * (new - h))
            out[t] = h
        return out

    @staticmethod
    def _gru_back(d: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        k = HIDDEN
        dx, du, dh = np.empty((*d.shape[:2], 3 * k), np.float32), np.zeros_like(u), np.zeros_like(d[0])
        for t in range(len(d) - 1, -1, -1):
            h, z, r, new, v = kept[t]
            dh = dh + d[t]
            inner = mask[t] * dh
            dn = inner * (1 - z) * (1 - new**2)
            dz = -inner * (new - h) * z * (1 - z)
            dr = dn * v * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], 1)
            dv = np.concatenate([dz, dr, dn * r], 1)
            du += h.T @ dv
            dh = dh - inner * (1 - z) + dv @ u.T
        return dx, du

    def _pool(self, hs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(mask[:, :, 0] > 0, hs @ self.p["attend"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        c = (a[:, :, None] * hs).sum(0)
        return c @ self.p["out"] + self.p["bias"][0], a, c

    def logits(self, feats: np.ndarray, index: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logit of each window of words ``index[first:first + size]``."""
        xf, xb = feats @ self.p["xf"] + self.p["cf"], feats @ self.p["xb"] + self.p["cb"]
        out = np.empty(len(first), np.float32)
        for a in range(0, len(first), _BLOCK):
            at, mask = _places(index, first[a : a + _BLOCK], size[a : a + _BLOCK])
            f = self._gru(xf[at], mask, self.p["hf"])
            b = self._gru(xb[at[::-1]], mask[::-1], self.p["hb"])[::-1]
            out[a : a + _BLOCK] = self._pool(np.concatenate([f, b], 2), mask)[0]
        return out

    def step(self, words: Words, at: np.ndarray, mask: np.ndarray, y: np.ndarray, state: dict, keep: np.ndarray) -> None:
        """One gradient step on windows of word numbers ``at[t, window]``; ``keep``: 0 or 1 for each word used."""
        p = self.p
        used, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        w = words.take(used)
        feats = self.features(w)
        # what was learnt of single words and n-grams is left out at random, so the rows' own words are not learnt by heart
        feats[:, 2:] *= keep[: len(used), None]
        x = feats[local]
        kf: list = []
        kb: list = []
        f = self._gru(x @ p["xf"] + p["cf"], mask, p["hf"], kf)
        b = self._gru((x @ p["xb"] + p["cb"])[::-1], mask[::-1], p["hb"], kb)[::-1]
        hs = np.concatenate([f, b], 2)
        logit, a, c = self._pool(hs, mask)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        grads = {"out": c.T @ d, "bias": np.array([d.sum()], np.float32)}
        dc = d[:, None] * p["out"]
        da = (dc * hs).sum(2)
        de = a * (da - (a * da).sum(0))
        grads["attend"] = np.einsum("tb,tbh->h", de, hs)
        dh = a[:, :, None] * dc + de[:, :, None] * p["attend"]
        dxf, grads["hf"] = self._gru_back(dh[:, :, :HIDDEN], mask, p["hf"], kf)
        dxb, grads["hb"] = self._gru_back(dh[::-1, :, HIDDEN:], mask[::-1], p["hb"], kb)
        dxb = dxb[::-1]
        dx = dxf @ p["xf"].T + dxb @ p["xb"].T
        for name, g in (("f", dxf), ("b", dxb)):
            grads[f"x{name}"] = x.reshape(-1, _FEATURES).T @ g.reshape(-1, 3 * HIDDEN)
            grads[f"c{name}"] = g.sum((0, 1))
        for name, g in grads.items():  # Adam
            m, v, t = state.setdefault(name, [np.zeros_like(g), np.zeros_like(g), 0])
            t += 1
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            state[name][2] = t
            p[name] -= RATE * 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        dw = np.zeros((len(used), _FEATURES), np.float32)
        np.add.at(dw, local.ravel(), dx.reshape(-1, _FEATURES))
        dw[:, 2:] *= keep[: len(used), None]
        n = w.at[1:] - w.at[:-1]
        for name, rows, g in (
            ("words", _row(w.word, WORD_ROWS), dw[:, 2 : 2 + EMBED]),
            ("grams", _row(w.grams, GRAM_ROWS), np.repeat(dw[:, 2 + EMBED :] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)),
        ):  # Adagrad on the rows touched
            total = np.zeros_like(p[name])
            np.add.at(total, rows, g)
            touched = np.unique(rows)
            s = state.setdefault(name, np.full(p[name].shape, 1e-6, np.float32))
            s[touched] += total[touched] ** 2
            p[name][touched] -= RATE * total[touched] / np.sqrt(s[touched])

    def raw(self, texts: pa.Array) -> np.ndarray:
        """Highest window logit of each text, -inf without words."""
        distinct, index, ends = distinct_words(texts)
        first, size, text = _windows(ends)
        out = np.full(len(texts), -np.inf, np.float64)
        if len(first):
            np.maximum.at(out, text, self.logits(self.features(Words.of(distinct)), index, first, size))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.scale
        z = self.raw(texts)
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(a * np.where(np.isneginf(z), 0, z) + b, -30, 30))))


def _places(index: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers ``[t, window]`` and mask of windows; what lies behind a window's end repeats its last word, masked."""
    t = np.arange(LENGTH)[:, None]
    return index[first + np.minimum(t, size - 1)], (t < size)[:, :, None].astype(np.float32)


class _Odds:
    """Smoothed log-odds of label 1 for each hash row, by the documents that hold it; 0 below four documents."""

    def __init__(self, y: np.ndarray):
        self.y, self.counts = y, [np.zeros(ODDS_ROWS), np.zeros(ODDS_ROWS)]

    def add(self, rows: np.ndarray, doc: np.ndarray) -> None:
        """Rows of whole documents."""
        pair = np.unique(doc.astype(np.int64) * ODDS_ROWS + rows)
        d, r = pair // ODDS_ROWS, pair % ODDS_ROWS
        for label, counts in zip((1, 0), self.counts, strict=True):
            np.add.at(counts, r[self.y[d] == label], 1)

    def values(self) -> np.ndarray:
        one, zero = self.counts
        odds = np.log((one + 1) / (self.y.sum() + 2)) - np.log((zero + 1) / ((1 - self.y).sum() + 2))
        return np.where(one + zero >= 4, np.clip(odds, -3, 4), 0).astype(np.float32)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Network:
    """Train on whole texts and their labels."""
    y = labels.astype(np.float64)
    net = Network.fresh(seed)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        aside[rng.permutation(of)[: len(of) // 5]] = True
    distinct, index, ends = distinct_words(texts)
    words = Words.of(distinct)
    place = np.cumsum(~aside) - 1  # numbers of the rows that learn
    word_odds, gram_odds = _Odds(y[~aside]), _Odds(y[~aside])
    for i in np.flatnonzero(~aside):
        own = np.unique(index[ends[i] : ends[i + 1]])
        some = words.take(own)
        word_odds.add(_row(some.word, ODDS_ROWS), np.full(len(own), place[i]))
        gram_odds.add(_row(some.grams, ODDS_ROWS), np.full(len(some.grams), place[i]))
    net.word_odds, net.gram_odds = word_odds.values(), gram_odds.values()

    first, size, owner = _windows(ends)
    mine = np.flatnonzero(~aside[owner])
    state: dict = {}
    for epoch in range(EPOCHS):
        feats = net.features(words)
        if epoch == 0:  # before anything is learnt: where the log-odds are highest
            total = np.concatenate([[0], np.cumsum(np.maximum(feats[index, 0], 0) + np.maximum(feats[index, 1], 0))])
            z = total[first + size] - total[first]
        else:
            z = net.logits(feats, index, first, size)
        order = mine[np.lexsort((z[mine], owner[mine]))]
        top = order[np.concatenate([owner[order][1:] != owner[order][:-1], [True]])] if len(order) else order
        clean = mine[y[owner[mine]] == 0]
        extra = rng.choice(clean, min(len(clean), len(top) // 2)) if len(clean) else clean
        windows = np.concatenate([top, extra])
        one, zero = windows[y[owner[windows]] == 1], windows[y[owner[windows]] == 0]
        for _ in range(STEPS // EPOCHS if len(one) and len(zero) else 0):  # batches hold as many windows of either label
            i = np.concatenate([rng.choice(one, BATCH // 2), rng.choice(zero, BATCH // 2)])
            at, mask = _places(index, first[i], size[i])
            net.step(words, at, mask, y[owner[i]], state, (rng.random(at.size) < 0.5).astype(np.float32))
    z = np.full(len(y), -np.inf)
    if len(first):
        np.maximum.at(z, owner, net.logits(net.features(words), index, first, size))
    net.scale = _calibrated(z[aside & np.isfinite(z)], y[aside & np.isfinite(z)])
    return net


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that put the logit of best F0.5 at score CUT."""
    edge = np.log(CUT / (1 - CUT))
    if not len(z) or y.min() == y.max():
        return 1.0, float(edge - 1.0)
    order = np.argsort(-z)
    hit = np.cumsum(y[order])
    # F0.5: a clean document called toxic costs more than one missed
    f = 1.25 * hit / (np.arange(1, len(z) + 1) + 0.25 * y.sum())
    best = int(np.argmax(f))
    low = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    # between the last that counts as 1 and the next, and never below even odds
    middle = max((z[order[best]] + low) / 2, 0.0)
    spread = max(float(np.std(z)), 0.1)
    return 2.0 / spread, float(edge - 2.0 / spread * middle)


def train(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None) -> Network:
    """A network from a bounded sample: of each label the ``per_class`` rows outside fold 1 with the smallest id hash."""
    per_class = per_class or PER_CLASS
    known = labels.filter(F.col("toxic").isin(0, 1) & F.coalesce(crc_fold() != 1, F.lit(False))).select(F.col("doc_id").alias("d"), F.col("toxic").alias("y"))
    first = Window.partitionBy("y").orderBy(F.xxhash64("d"), "d")
    most = max(per_class.values())
    ids = known.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= most).filter(F.when(F.col("y") == 1, F.col("rn") <= per_class[1]).otherwise(F.col("rn") <= per_class[0])).drop("rn")
    # at most the sample's size of ids, so they are broadcast and the texts stay where they are
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("d")).select("d", "y", "text").toArrow().sort_by([("d", "ascending"), ("y", "ascending")])
    return fit(sample.column("text").combine_chunks(), np.array(sample.column("y").to_pylist(), np.float64))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            s = shared.value.scores(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
