"""SentencePiece encoding and decoding.

The pieces of a public model stand in an Aho-Corasick automaton. One pass over
the text follows the automaton; at each position the output links give every
piece that ends there, and each relaxes the best score of its end (Viterbi).
The segmentation with the highest sum of scores wins, ties by fewer pieces of
later start. What no piece covers is encoded by its UTF-8 bytes.

Blanks are written as the model writes them and one is put in front. No piece
of such a model holds a word's letters and a following blank, so the best
segmentation is the concatenation of those of the blank-led words; these are
kept in a cache of bounded size. A word mark that the text itself contains is
encoded as bytes, which makes decoding exact for every text.

Defined cases: null texts have no pieces and decode to null; empty texts have
no pieces and decode to the empty text; lone surrogates cannot occur in Spark
strings; repeated rows and null ids are encoded like any other.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words kept with their ids, and the longest that is kept.
CACHE, CACHE_CHARS = 500_000, 64
_WORD = re.compile(" +[^ ]*")


class _Cache(dict):
    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        got = array("i", self.pieces.segment(word.replace(MARK, "\0" + MARK).replace(" ", MARK) if MARK in word else word.replace(" ", MARK))).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got


class Pieces:
    """A model's pieces, their scores and byte pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes_at = [0] * 256
        self.out: list[bytes] = []
        usual: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_at[value] = i
                self.out.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                usual[piece] = (i, sp.get_score(i))
                self.out.append(piece.replace(MARK, " ").encode())
        self.load(usual)

    def load(self, usual: dict[str, tuple[int, float]]) -> None:
        self.usual = usual
        if any(MARK in p.lstrip(MARK) for p in usual):
            raise ValueError("a piece goes over a word's end")
        self.byte_score = min((s for _, s in usual.values()), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in usual.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in usual if len(p) == 1)
        self.cache = _Cache(self)

    def segment(self, text: str) -> list[int]:
        """Best segmentation of a marked text. A NUL before a mark says that the mark is the text's own."""
        if self.single.issuperset(text):  # every position can be reached: nothing but links to relax
            n = len(text)
            best, back = [0.0, *[float("-inf")] * n], [None] * (n + 1)
            for end, link in self.automaton.iter(text):
                end += 1
                if (s := best[end - link[0]] + link[2]) > best[end]:
                    best[end] = s
                    back[end] = link
            ids: list[int] = []
            while n:
                size, i, _ = back[n]
                ids.append(i)
                n -= size
            return ids[::-1]
        return self._segment_any(text)

    def _segment_any(self, text: str) -> list[int]:
        own = set()
        if "\0" + MARK in text:
            parts = text.split("\0" + MARK)
            at = 0
            for p in parts[:-1]:
                at += len(p)
                own.add(at)
                at += 1
            text = MARK.join(parts)
        n = len(text)
        low = float("-inf")
        best, back = [low] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        done = 0
        for end, (size, i, score) in self.automaton.iter(text) if n else ():
            end += 1
            for x in range(done + 1, end):  # no piece ends here: bytes carry on
                self._bytes(text, x, best, back)
            done = max(done, end - 1)
            begin = end - size
            if best[begin] == low:
                self._bytes(text, begin, best, back)
            if own and not own.isdisjoint(range(begin, end)):
                continue
            if (s := best[begin] + score) > best[end]:
                best[end], back[end] = s, (begin, i)
        for x in range(done + 1, n + 1):
            self._bytes(text, x, best, back)
        ids: list[int] = []
        while n:
            begin, i = back[n]
            ids += (i,) if i >= 0 else [self.bytes_at[b] for b in reversed(text[begin:n].encode())]
            n = begin
        return ids[::-1]

    def _bytes(self, text: str, end: int, best: list, back: list) -> None:
        s = best[end - 1] + self.byte_score * len(text[end - 1].encode())
        if s > best[end]:
            best[end], back[end] = s, (end - 1, -1)

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, _WORD.findall(" " + text))) if text else b""

    def decode(self, ids: memoryview | list[int]) -> str:
        return b"".join(map(self.out.__getitem__, ids)).decode()[1:]


_loaded: dict[str, Pieces] = {}


def pieces_of(name: str, model: bytes) -> Pieces:
    """One automaton for each worker process and model."""
    if name not in _loaded:
        _loaded[name] = Pieces(model)
    return _loaded[name]


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read()
    name = hashlib.sha256(data).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(data)
    return lambda: pieces_of(name, shared.value)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""
    get = _model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            got = [None if t is None else get().encode(t) for t in part.column(1).to_pylist()]
            offsets, at = array("i", [0]), 0
            for x in got:
                at += len(x or b"") // 4
                offsets.append(at)
            values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(x or b"" for x in got))])
            nulls = pa.array([x is None for x in got]) if None in got else None
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=nulls)
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    get = _model(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else get().decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_pieces, n_bytes, ids_sha256, decoded_sha256, exact``.

    ``ids_sha256`` is over the ids as 32-bit little-endian integers, ``n_bytes``
    counts the pieces that stand for single bytes, ``exact`` is whether the
    decoded text is the text itself.
    """
    get = _model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            pieces = get()
            singles = bytes_mask(pieces)
            rows: list[tuple] = []
            for text in part.column(1).to_pylist():
                ids = pieces.encode(text or "")
                back = pieces.decode(memoryview(ids).cast("i")) if ids else ""
                n = len(ids) // 4
                single = pc.sum(singles.take(pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(ids)]))).as_py() if n else 0
                rows.append((n, single, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_pieces", "n_bytes", "ids_sha256", "decoded_sha256", "exact"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_sha256 string, decoded_sha256 string, exact boolean")


def bytes_mask(pieces: Pieces) -> pa.Array:
    single = set(pieces.bytes_at)
    return pa.array([int(i in single) for i in range(len(pieces.out))], pa.int32())
