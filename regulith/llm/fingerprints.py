"""Document fingerprints from closed syncmers over words.

A k-mer of four consecutive words is an anchor if, among the hashes of its
three inner two-word substrings, the least lies at the first or the last place
(closed syncmer). Whether a k-mer is an anchor depends on its own words alone,
so a passage has the same anchors wherever it stands. Anchors are matched by
position: a link is an anchor, the next anchor and how many words lie between
them, so two texts share a link where the same two anchors stand equally far
apart, wherever that is. Likeness is the Jaccard similarity of the sets of all
links of two texts. The fingerprint as text is a digest of all positions and
anchors, followed by the SKETCH least links.

Defined cases: null text counts as empty; a text without words has the empty
fingerprint, alike (1.0) only to another such; a text with one anchor has it as
its only link; one of one to three words, or without any anchor, has the hash of
all its words as its only link; very long texts are read whole. The next
document is that of the next lower id; rows that share an id stand in order of
their texts, rows equal in both are alike whichever comes first; null ids stand
last; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

SKETCH = 64
#: Rows of a run of consecutive ids that one task puts in order, and the most runs and cells of ids (their bounds are broadcast).
RUN_ROWS, MOST_RUNS = 4096, 65_536

def _none() -> Column:
    return F.array().cast("array<bigint>")


def _anchors(inner: Column) -> Column:
    """``array<struct<pos, hash>>`` of the closed syncmers, in order, from the hashes of all two-word substrings."""
    later = F.zip_with(F.slice(inner, 2, 1 << 30), F.slice(inner, 3, 1 << 30), lambda m, c: F.struct(m.alias("m"), c.alias("c")))
    mers = F.zip_with(inner, later, lambda a, x: F.when(x["c"].isNotNull() & (F.least(a, x["c"]) <= x["m"]), F.xxhash64(a, x["c"])))
    return F.filter(F.transform(mers, lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))), lambda x: x["hash"].isNotNull())


def _links(found: Column, whole: Column) -> Column:
    """Distinct hashes of each anchor, the next one and the words between them."""
    n = F.size(found)
    two = F.zip_with(F.slice(found, 1, n - 1), F.slice(found, 2, n - 1), lambda a, b: F.xxhash64(a["hash"], b["hash"], b["pos"] - a["pos"]))
    return F.when(n > 1, F.array_distinct(two)).when(n == 1, F.array(F.xxhash64(F.get(found, 0)["hash"]))).otherwise(whole)


def with_links(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``<out>``, the links (``array<bigint>``) of a text column, and ``<out>_anchors``, its anchors (``array<struct<pos, hash>>``)."""
    tokens = F.transform(F.split(F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"), lambda x: F.xxhash64(x))
    df = df.withColumn(f"{out}_t", F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), tokens).otherwise(_none()))
    t = F.col(f"{out}_t")
    df = df.withColumn(f"{out}_i", F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: F.xxhash64(a, b))).otherwise(_none()))
    whole = F.when(F.size(t) > 0, F.array(F.xxhash64(t))).otherwise(_none())
    df = df.withColumn(f"{out}_anchors", _anchors(F.col(f"{out}_i")))
    return df.withColumn(out, _links(F.col(f"{out}_anchors"), whole)).drop(f"{out}_t", f"{out}_i")


def as_text(links: Column, found: Column) -> Column:
    """Hexadecimal digits, 16 for each hash: of all positions and anchors, and of the least links; empty without words."""
    least = F.concat(F.array(F.xxhash64(found)), F.slice(F.array_sort(links), 1, SKETCH))
    return F.when(F.size(links) == 0, "").otherwise(F.concat_ws("", F.transform(least, lambda x: F.lpad(F.hex(x), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of links, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def in_runs(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (``doc_id, t``) in runs of consecutive ids, with ``run`` and ``ghost``, and the window in which each row's successor is next.

    The ids' range is cut into cells of equal width; a cell with many rows is cut
    again, so that ids which cluster don't meet in one run. The rows of the
    highest id of each run also go, as ghosts behind its rows, to the run
    before it (those of the highest id of all to the last run), so that a window
    within runs sees every successor. Only cells and the heads' ids are broadcast.
    """
    low, high, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, each = low or 0, max(RUN_ROWS, -(-rows // MOST_RUNS))
    width = max(1, -(-((high or 0) - low + 1) // MOST_RUNS))
    cell = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(-1)).cast("long")
    order = Window.orderBy("cell")
    cells = docs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # a run is a stretch of cells with about RUN_ROWS rows in all, or a part of a fuller cell
    cells = cells.withColumn("parts", F.least(F.ceil(F.col("n") / each), F.lit(width))).withColumn("parts", F.when(F.col("cell") < 0, 1).otherwise(F.col("parts")))
    cells = cells.withColumn("base", F.floor(F.sum(F.least(F.col("n"), F.lit(each))).over(order) / each) + F.coalesce(F.sum(F.col("parts")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = F.broadcast(cells.select(F.col("cell").alias("own"), "parts", "base"))
    part = F.when(F.col("own") < 0, 0).otherwise(F.floor((F.col("doc_id") - F.lit(low) - F.col("own") * F.lit(width)) * F.col("parts") / F.lit(width)))
    placed = docs.join(cells, cell == F.col("own")).select(*docs.columns, (F.col("base") + part).cast("long").alias("run"))
    down = Window.orderBy(F.col("run").desc())
    heads = (
        placed.groupBy("run")
        .agg(F.max("doc_id").alias("head"))
        .withColumn("to", F.coalesce(F.lag("run").over(down), F.min("run").over(Window.partitionBy())))
        .select(F.col("run").alias("head_run"), "head", "to")
    )
    placed = (
        placed.join(F.broadcast(heads), (F.col("run") == F.col("head_run")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
        .withColumn("run", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("run", F.lit(False).alias("ghost")))).otherwise(F.array(F.struct("run", F.lit(False).alias("ghost")), F.struct(F.col("to").alias("run"), F.lit(True).alias("ghost"))))))
        .select(*docs.columns, F.col("run.run").alias("run"), F.col("run.ghost").alias("ghost"))
    )
    return placed, Window.partitionBy("run").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "t")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses."""
    placed, after = in_runs(docs.select("doc_id", text_of().alias("t")))
    df = placed.withColumn("next_t", F.lead("t").over(after))
    df = with_links(df, "t", "f").withColumn("next_f", F.lead("f").over(after)).filter(~F.col("ghost"))
    df = df.withColumn("n_chars", F.length("t").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_t", F.lit(1), third))
    df = df.withColumn("e", F.when(third > 0, edited).otherwise(F.col("t"))).select("doc_id", "n_chars", "e", "f", "f_anchors", "next_f")
    df = with_links(df, "e", "g")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("e", 256).alias("edited_sha256"),
        as_text(F.col("f"), F.col("f_anchors")).alias("fingerprint"),
        as_text(F.col("g"), F.col("g_anchors")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )
