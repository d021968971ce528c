"""One pass over a text for all markers of a lexicon.

An automaton of all markers reads each text once and sets a bit for each marker
that the text holds; a group of markers is then a bit test, and how many of a
group a text holds is a bit count, both inside generated code. Texts go through
Arrow in batches; the bits come back as a few long columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bits of a long that are used: its sign stays out of it.
BITS = 62


@cache
def _automaton(markers: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, m in enumerate(markers):
        found.add_word(m, i)
    found.make_automaton()
    return found


class Lexicon:
    """Numbered markers: ``bits`` of a text, tests of them as SQL over a struct of that name."""

    def __init__(self, markers: Iterable[str]):
        self.markers = tuple(dict.fromkeys(m for m in markers if m))
        self.number = {m: i for i, m in enumerate(self.markers)}
        self.words = -(-len(self.markers) // BITS)
        self.type = StructType([StructField(f"w{i}", LongType()) for i in range(self.words)])

    def bits(self, text: Column) -> Column:
        """A struct of longs with the bit of each marker that the text holds; none for null."""
        markers, words = self.markers, self.words

        @F.pandas_udf(self.type)
        def held(texts: pd.Series) -> pd.DataFrame:
            found = _automaton(markers)
            rows: list[int] = []
            numbers: list[int] = []
            for row, t in enumerate(texts):
                for _, i in found.iter(t) if t else ():
                    rows.append(row)
                    numbers.append(i)
            out = np.zeros((len(texts), words), np.int64)
            if rows:
                at = np.unique(np.array(rows, np.int64) * len(markers) + np.array(numbers, np.int64))
                row, number = at // len(markers), at % len(markers)
                np.add.at(out, (row, number // BITS), np.int64(1) << (number % BITS))
            return pd.DataFrame(out, columns=[f"w{i}" for i in range(words)])

        return held(text)

    def count(self, bits: str, markers: Iterable[str]) -> str | None:
        """SQL for how many of the markers a text holds, from its bits; None if one is not of the lexicon."""
        masks: dict[int, int] = {}
        for m in dict.fromkeys(markers):
            if m not in self.number:
                return None
            i = self.number[m]
            masks[i // BITS] = masks.get(i // BITS, 0) | 1 << i % BITS
        return "(" + " + ".join(f"bit_count({bits}.w{w} & {mask}L)" for w, mask in masks.items()) + ")"


def strings_of(*values) -> Iterable[str]:
    """All strings in nested tuples and lists."""
    for v in values:
        if isinstance(v, str):
            yield v
        elif isinstance(v, (tuple, list)):
            yield from strings_of(*v)
