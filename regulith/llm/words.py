"""Texts as distinct words: what per-word models need of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held at once as words (a longer text is held alone, whole).
CHUNK = 4 << 20


def chunks(batches: Iterable[pa.RecordBatch], text: int = 1, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The lower-cased words between white space: distinct ones, the number of each in order, and where each text begins (one more at the end)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    words, index = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
    if "" in words:  # what stands before leading and behind trailing white space
        real = index != words.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        index = index[real]
    return words, index, ends


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between consecutive ends."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]
