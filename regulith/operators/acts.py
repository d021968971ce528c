"""Acts of a gazette's issue: where they start, which belong together, which only appoint persons."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..rules import fr_requirements as fr
from . import requirement_rules as rr

# How an act and an article begin.
ACT = re.compile(r"(?im)^[ \t]*(?:(?:loi|d[ée]cret(?:-loi)?|arr[êe]t[ée](?:\s+conjoint)?)\b|(?:d[ée]cision|circulaire|convention|r[èe]glement)(?:\s+n[°o]\s*\d+|\s+(?:du|portant|relative|fixant)\b))[^\n]*")
ARTICLE = re.compile(r"(?i)(?<![\w'’])(?:article|art\.?)\s*(?:n\s*)?(?:premier|unique|1er|\d+(?:[-.]\d+)*)\b")
LEAST, HEAD = 30, 300


def acts_of(text: str) -> list[tuple[str, int, int, str]]:
    """SG2: ``title, start, end, text`` of each act. A head with articles before the first act stays; an act without an article is joined to the next that begins with one; without any article the whole is one document."""
    text = text or ""
    starts = [(m.start(), m.group().strip()) for m in ACT.finditer(text)]
    bounds = [s for s, _ in starts[1:]] + [len(text)]
    blocks = [(title, s, e, text[s:e].strip()) for (s, title), e in zip(starts, bounds, strict=True)] if starts else []
    blocks = [b for b in blocks if len(b[3]) >= LEAST]
    head = text[: starts[0][0]].strip() if starts else ""
    if len(head) >= LEAST and ARTICLE.search(head):
        blocks.insert(0, ("DOCUMENT_PREFIX", 0, starts[0][0], head))
    if not any(ARTICLE.search(b[3]) for b in blocks):
        return [("DOCUMENT", 0, len(text), text)]
    out: list[tuple[str, int, int, str]] = []
    waiting = None
    for b in blocks:
        if waiting is not None:
            if ARTICLE.search(b[3][:HEAD]):
                b = (waiting[0], waiting[1], b[2], f"{waiting[3]}\n\n{b[3]}")
            else:
                out.append(waiting)
            waiting = None
        if ARTICLE.search(b[3]):
            out.append(b)
        else:
            waiting = b
    return out if waiting is None else [*out, waiting]


@F.pandas_udf(ArrayType(StructType([StructField("title", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("text", StringType())])))
def split_acts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("title", "start", "stop", "text"), a, strict=True)) for a in acts_of(t)])


def individual(title: str | Column, text: str | Column) -> Column:
    """SG6: an act that only appoints, moves or discharges named persons."""
    text = F.col(text) if isinstance(text, str) else text
    # an element's fields are made once, however many markers are looked for in them
    plain = F.array(F.struct(rr.plain(F.substring(text, 1, 1200)).alias("head"), rr.plain(title).alias("title")))
    some = lambda c, markers: reduce(or_, (F.contains(c, F.lit(m)) for m in markers))
    return F.exists(plain, lambda p: (some(p["title"], fr.INDIVIDUAL_ACTS) | some(p["head"], fr.INDIVIDUAL_ACTS)) & some(p["head"], fr.PERSONS) & ~some(p["head"], fr.GENERAL_ACTS))
