"""Segmentation of documents: pages, articles, chunks, units, data rows.

What windows and array functions can express is written with them; chunk and
unit packing are folds over one text and run as small per-row helpers inside
``mapInPandas``, a batch of texts at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import UNICODE

MAX_CHUNK, OVERLAP = 1200, 180
MIN_UNIT, MAX_UNIT = 20, 900
SLICE = 4 << 20  # bytes of text that are split at once

HEADER = r"(?:article\s+(?:premier|1er|unique|\d+)|art\.\s*\d+)"


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """SG1: start and end of each page in the document's pages joined by a blank line."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 2).over(w), F.lit(0))
    return pages.withColumn("start_char", start).withColumn("end_char", start + F.length(text))


def split_articles(docs: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """SG3, SG4: articles of each document.

    The text is cut before every header; a header whose number falls back below
    one seen before is a reference and stays in the article it stands in; what
    is shorter than ``least`` is dropped; a document without headers is one article.
    """
    parts = F.split(F.col(text), UNICODE + rf"(?=(?:^|(?<=\n))\s*{HEADER}\s*[-:–—])")
    x = docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    label = F.regexp_extract("part", UNICODE + rf"^\s*({HEADER})", 1)
    number = F.when(label == "", None).when(F.lower(label).rlike("premier|1er|unique"), 1).otherwise(F.regexp_extract(label, r"(\d+)", 1).try_cast("int"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    seen = F.max("number").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("label", label).withColumn("number", number)
    x = x.withColumn("opens", F.when(F.col("number").isNotNull() & (seen.isNull() | (F.col("number") >= seen)), 1).otherwise(0))
    x = x.withColumn("article_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("doc_id", "article_no").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"), F.min_by("label", "pos").alias("label"), F.min_by("number", "pos").alias("number"))
    body = F.trim(F.array_join(F.transform("p", lambda y: y["part"]), ""))
    return g.select("doc_id", "article_no", F.when(F.col("article_no") > 0, F.col("label")).otherwise("").alias("label"), F.when(F.col("article_no") > 0, F.col("number")).alias("number"), body.alias("text")).filter(F.length("text") >= least)


def heading_of(df: DataFrame, doc: str, order: str, heading: Column) -> DataFrame:
    """SG5: the last heading before each row."""
    return df.withColumn("heading", F.last(heading, ignorenulls=True).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


# --- folds over one text ------------------------------------------------------

_ENDS = ((re.compile(r"[.;?!]\s"), 0.35), (re.compile(r":\s"), 0.45))
_LIST = re.compile(r"(?m)^\s*(?:[-*•▪◦]|[a-z]\)|\d+[).])\s+")
_SENTENCE = re.compile(r"(?<=[.;!?])\s+(?=[A-Z0-9À-Ý(])")


def safe_cuts(text: str, limit: int) -> list[str]:
    """CH2: pieces of at most ``limit``: cut behind a sentence end in the last part, else a colon, else a blank, else hard."""
    out = []
    while len(text) > limit:
        head, at = text[:limit], 0
        for pattern, share in _ENDS:
            found = [m.end() for m in pattern.finditer(head) if m.end() >= share * limit]
            if found:
                at = found[-1]
                break
        at = at or head.rfind(" ") + 1 or limit
        out.append(text[:at].strip())
        text = text[at:].lstrip()
    return [x for x in [*out, text.strip()] if x]


def pack(text: str, limit: int = MAX_CHUNK) -> list[str]:
    """CH1: paragraphs packed into chunks of at most ``limit``; a list stays with its paragraph as long as it fits."""
    chunks: list[str] = []
    for paragraph in re.split(r"\n{1,}(?!\s*(?:[-*•]|[a-z]\)|\d+[).])\s)", text or ""):
        for piece in safe_cuts(paragraph.strip(), limit) if paragraph.strip() else ():
            if chunks and len(chunks[-1]) + len(piece) + 1 <= limit:
                chunks[-1] += "\n" + piece
            else:
                chunks.append(piece)
    return chunks


def units_of(text: str, least: int = MIN_UNIT, most: int = MAX_UNIT) -> list[tuple[str, str]]:
    """UN1, UN6: units with the way they were found: list items with their intro, sentences, whole paragraphs, long cuts."""
    out: list[tuple[str, str]] = []
    seen: set[str] = set()
    for paragraph in re.split(r"\n{2,}|\n(?!\s*(?:[-*•]|[a-z]\)|\d+[).])\s)", text or ""):
        marks = list(_LIST.finditer(paragraph))
        if len(marks) >= 2:
            intro = " ".join(paragraph[: marks[0].start()].split())
            found = []
            for m, n in zip(marks, [*(x.start() for x in marks[1:]), len(paragraph)], strict=True):
                item = " ".join(paragraph[m.end() : n].split())
                found.append(f"{intro} {item}" if intro and len(intro) + len(item) < most else item)
            kind = "list_block"
        else:
            found = [" ".join(x.split()) for x in _SENTENCE.split(paragraph)]
            kind = "sentence_split" if len(found) > 1 else "paragraph_fallback"
        for unit in found:
            for piece in safe_cuts(unit, most):
                if len(piece) >= least and piece.lower() not in seen:
                    seen.add(piece.lower())
                    out.append((piece, kind if len(unit) <= most else "long_cut"))
    return out


def chunks(docs: DataFrame, keys: str = "doc_id long", text: str = "text", limit: int = MAX_CHUNK) -> DataFrame:
    """CH1, CH2: ``keys, chunk_no, chunk`` of every text."""
    names = [k.split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*k, n, c) for *k, t in b.itertuples(index=False) for n, c in enumerate(pack(t, limit), 1)]
            yield pd.DataFrame(rows, columns=[*names, "chunk_no", "chunk"])

    return docs.select(*names, text).mapInPandas(run, f"{keys}, chunk_no int, chunk string")


def with_overlap(chunked: DataFrame, keys: list[str], size: int = OVERLAP) -> DataFrame:
    """CH3: the end of the chunk before, from a word's beginning, in front of each chunk."""
    before = F.lag("chunk").over(Window.partitionBy(*keys).orderBy("chunk_no"))
    tail = F.regexp_replace(F.substring(before, -size, size), r"^\S*\s", "")
    tail = F.when(F.length(before) <= size, before).otherwise(tail)
    return chunked.withColumn("with_overlap", F.when(before.isNull(), F.col("chunk")).otherwise(F.concat(tail, F.lit("\n"), "chunk")))


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``most`` bytes of text: what a task holds follows from its text, not from the rows of a batch."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows] if b.num_rows else []
        for i, j in zip(edges, edges[1:], strict=False):
            yield b.slice(i, j - i)


def units(docs: DataFrame, keys: str = "doc_id long", text: str = "text") -> DataFrame:
    """UN1: ``keys, unit_no, unit, source`` of every text."""
    names = [k.split()[0] for k in keys.split(",")]

    schema = f"{keys}, unit_no int, unit string, source string"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, len(names), SLICE):
            rows = [(*k, n, u, s) for *k, t in zip(*part.to_pydict().values(), strict=True) for n, (u, s) in enumerate(units_of(t), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(run, schema)


DATA_KINDS = (("TARIFF", "tarif|prix|montant|redevance"), ("QUOTA", "quota|nombre|postes"), ("DEADLINE", "d[ée]lai|date|jours"))


def data_rows(docs: DataFrame, text: str = "text", kinds: tuple[tuple[str, str], ...] = DATA_KINDS) -> DataFrame:
    """LD1: rows of tariff, quota and deadline tables: bullets, ``key: value`` pairs and columns, with number and unit."""
    x = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    raw = F.trim(F.regexp_replace("raw", r"^\s*(?:[-*•]|\d+[).])\s+", ""))
    split = r"^([^:|\t]{2,80}?)\s*[:|\t]\s*(.+)$"
    label, value = F.regexp_extract(raw, split, 1), F.regexp_extract(raw, split, 2)
    number = F.replace(F.regexp_extract(value, r"(-?\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(value, r"-?\d+(?:[.,]\d+)?\s*(%|[\p{L}]+)", 1)
    kind = None
    for n, p in kinds:
        cond = F.lower(F.concat_ws(" ", label, value)).rlike(p)
        kind = F.when(cond, n) if kind is None else kind.when(cond, n)
    return x.filter(label != "").select("doc_id", (F.col("line_no") + 1).alias("line_no"), label.alias("label"), value.alias("value"), number.alias("number"), unit.alias("unit"), kind.otherwise("OTHER").alias("kind"))


def data_objects(rows: DataFrame) -> DataFrame:
    """LD1: the rows of each kind as one nested object per document."""
    return rows.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("line_no", "label", "value", "number", "unit"))).alias("rows"))
