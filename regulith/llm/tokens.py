"""Ids of whole texts by a byte-level BPE tokenizer, a distinct word at a time.

Such a tokenizer cuts a text into words by one fixed rule and encodes each word
alone. So the words of a chunk of texts are found with array operations on code
points, each distinct word is encoded once by the library, and the ids are
gathered back. Texts that hold one of the tokenizer's added tokens, and
tokenizers with another rule, are encoded by the library as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words kept with their ids, and the longest (in bytes) that is kept.
CACHE, CACHE_BYTES = 1_000_000, 48
_LINE = re.compile(r" ?\S+")
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


class Tokenizer:
    def __init__(self, config: bytes):
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Library.from_str(config.decode())
        said = json.loads(config)
        rule = said.get("pre_tokenizer") or {}
        self.by_words = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and not said.get("normalizer") and said["model"].get("type") == "BPE"
        self.added = [x["content"] for x in said.get("added_tokens", ())]
        self.rule = ByteLevel(add_prefix_space=False)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.cache: dict[bytes, bytes] = {}
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _kinds_of(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points as the library's own rule sees them: with what they stand in one word."""
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            for p in np.unique(points[kinds == UNKNOWN]).tolist():
                with_ = [len(self.rule.pre_tokenize_str(c + chr(p))) == 1 for c in "a1!"]
                self.kinds[p] = with_.index(True) if True in with_ else SPACE
            kinds = self.kinds[points]
        return kinds

    def _words(self, data: bytes, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words begin, and the number of words before each text; ``firsts`` are the texts' byte positions."""
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        if n == len(data):
            at, doc = None, firsts
        else:
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            at = np.cumsum(width) - width
            doc = np.searchsorted(at, firsts)
        kinds = self._kinds_of(points)
        first = np.zeros(n + 1, bool)
        first[doc] = True
        first = first[:n]
        begins = first.copy()
        begins[1:] |= kinds[1:] != kinds[:-1]
        # the last of several blanks stands alone or, if it is a plain one, with what follows
        ends = np.flatnonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE) & ~first[1:]) + 1
        begins[ends - 1] = True
        begins[ends] = points[ends - 1] != 0x20
        # 's 't 're 've 'm 'll 'd
        marks = np.flatnonzero((points == 0x27) & begins)
        marks = marks[marks + 1 < n]
        marks = marks[(kinds[marks + 1] == LETTER) & ~first[marks + 1]]
        if len(marks):
            one = points[marks + 1]
            then = np.minimum(marks + 2, n - 1)
            two = np.where((marks + 2 < n) & (kinds[then] == LETTER) & ~first[then], points[then], 0)
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            short = np.isin(one, [ord(c) for c in "stmd"])
            hit = marks[long | short]
            after = hit + 2 + long[long | short]
            begins[hit + 1] = False
            after = after[after < n]
            begins[after[(kinds[after] == LETTER)]] = True
        starts = np.flatnonzero(begins)
        return (starts if at is None else at[starts]), np.searchsorted(starts, np.append(doc, n))

    def _encode_new(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, in few calls: words without blanks inside are encoded as lines of one text."""
        out: list[bytes] = [b""] * len(words)
        lines = [i for i, w in enumerate(words) if self.line is not None and _LINE.fullmatch(w.decode())]
        alone = {*range(len(words))}.difference(lines)
        for a in range(0, len(lines), 4000):
            some = lines[a : a + 4000]
            got = np.array(self.library.encode_batch_fast([b"\n".join([b"", *(words[i] for i in some)]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(got == self.line)
            if len(cuts) != len(some):
                alone.update(some)
                continue
            data = got.tobytes()
            begins, ends = ((cuts + 1) * 4).tolist(), [*(cuts[1:] * 4).tolist(), len(data)]
            for i, x, y in zip(some, begins, ends, strict=True):
                out[i] = data[x:y]
        for i in sorted(alone):
            out[i] = array("I", self.library.encode(words[i].decode(), add_special_tokens=False).ids).tobytes()
        return out

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        ids = list(map(self.cache.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
        for i, x in zip(new, self._encode_new([words[i] for i in new]), strict=True):
            ids[i] = x
            if len(words[i]) <= CACHE_BYTES:
                self.cache[words[i]] = x
        return ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of each text; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        slow = np.zeros(len(texts), bool) if self.by_words else np.ones(len(texts), bool)
        for added in self.added:
            slow |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        for i in np.flatnonzero(slow).tolist():
            out[i] = self.whole(texts[i].as_py())
        rest = np.flatnonzero(~slow & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        for i in np.flatnonzero(~slow).tolist():
            out[i] = np.zeros(0, np.uint32)
        if not len(rest):
            return out
        texts = texts if len(rest) == len(texts) else texts.take(pa.array(rest))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()
        starts, words_before = self._words(data, offsets[:-1] - offsets[0])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        index = words.indices.to_numpy()
        ids = self._encode_words(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        size = sizes[index]
        ends = np.cumsum(size)
        got = flat[np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - size), size) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[words_before]
        for k, i in enumerate(rest.tolist()):
            out[i] = got[cuts[k] : cuts[k + 1]]
        return out


_loaded: dict[str, Tokenizer] = {}


def tokenizer_of(name: str, config: bytes) -> Tokenizer:
    """One tokenizer for each worker process and file."""
    if name not in _loaded:
        _loaded[name] = Tokenizer(config)
    return _loaded[name]


def shared_tokenizer(df: DataFrame, path: str):
    """A function for tasks that gives the tokenizer of a file the driver reads (a few MB)."""
    with open(path, "rb") as f:
        config = f.read()
    name = hashlib.sha256(config).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(config)
    return lambda: tokenizer_of(name, shared.value)
