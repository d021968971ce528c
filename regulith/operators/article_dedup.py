"""DD2, DD3 while extracting: a statement repeated within its article, then within its document.

The order of a document's statements decides, so they are folded within the row.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.text import ACCENTED, PLAIN
from . import grouping

#: Keys of a document shorter than this are not compared beyond their article.
LEAST = 35
_FOLD = str.maketrans(ACCENTED, PLAIN)


@lru_cache(grouping.TEXTS)
def _folded(text: str) -> str:
    return grouping.statement_key(text).translate(_FOLD)


def kept_of(rows: list[tuple], text_key: bool = True, least: int = LEAST) -> list[tuple[int, int, str]]:
    """``seq, kept_seq, reason`` of rows ``seq, article, kind, text, snippet``, in order of ``seq``.

    EXACT_ARTICLE: the same text in the article, of whatever type. PREFIX_ARTICLE:
    of the article and type, one that it extends or nearly repeats. EXACT_DOC: of
    the type, the same text without accents, or (also where ``text_key`` is off)
    the same text and citation. PREFIX_DOC: of the type, one that it extends.
    Only what is kept is compared with. Nulls count as empty, a null type as AUTRE.
    """
    exact: dict[tuple, int] = {}
    near: dict[tuple, tuple[grouping.Seen, list[tuple[int, str]]]] = {}
    out = []

    def like(group: tuple, text: str, same) -> int | None:
        seen, before = near.setdefault(group, (grouping.Seen(), []))
        return next((before[i][0] for i in seen.near(text) if same(text, before[i][1])), None)

    def keep(group: tuple, seq: int, text: str) -> None:
        seen, before = near.setdefault(group, (grouping.Seen(), []))
        seen.add(text)
        before.append((seq, text))

    either = lambda a, b: grouping.runtime_prefix_duplicate(a, b) or grouping.runtime_overlap_duplicate(a, b)
    for seq, article, kind, text, snippet in sorted(rows, key=lambda r: r[0]):
        kind = (kind or "").strip().upper() or "AUTRE"
        key = grouping.statement_key(text or "")
        plain, cited = _folded(text or ""), _folded(snippet or "")
        long = len(plain) >= least
        found, reason = exact.get(("article", article, key)), "EXACT_ARTICLE"
        if found is None:
            found, reason = like(("article", article, kind), key, either), "PREFIX_ARTICLE"
        if found is None and long and text_key:
            found, reason = exact.get(("doc", kind, plain)), "EXACT_DOC"
        if found is None and long:
            found, reason = like(("doc", kind), plain, grouping.runtime_prefix_duplicate), "PREFIX_DOC"
        if found is None and long:
            found, reason = exact.get(("doc", kind, plain, cited)), "EXACT_DOC"
        if found is not None:
            out.append((seq, found, reason))
            continue
        out.append((seq, seq, "KEPT"))
        exact["article", article, key] = seq
        keep(("article", article, kind), seq, key)
        if long:
            exact.setdefault(("doc", kind, plain), seq)
            exact.setdefault(("doc", kind, plain, cited), seq)
            keep(("doc", kind), seq, plain)
    return out


_KEPT = StructType([StructField("seq", LongType()), StructField("kept_seq", LongType()), StructField("reason", StringType())])


@F.pandas_udf(ArrayType(_KEPT))
def _kept(seqs: pd.Series, articles: pd.Series, kinds: pd.Series, texts: pd.Series, snippets: pd.Series) -> pd.Series:
    rows = (list(zip(*map(list, r), strict=True)) for r in zip(seqs, articles, kinds, texts, snippets, strict=True))
    return pd.Series([[dict(zip(_KEPT.names, x, strict=True)) for x in kept_of(r)] for r in rows])


def dedup(df: DataFrame, items: str, key: str = "doc_id") -> DataFrame:
    """``seq, kept_seq, reason`` of each statement of ``items array<struct<seq, article, kind, text, snippet>>``."""
    x = df.filter(F.col(f"`{items}`").isNotNull())
    i = lambda c, t: F.col(f"`{items}`.`{c}`").cast(f"array<{t}>")
    got = _kept(i("seq", "bigint"), i("article", "string"), i("kind", "string"), i("text", "string"), i("snippet", "string"))
    return x.select(F.col(f"`{key}`").alias(key), F.explode(got).alias("x")).select(key, "x.*")
