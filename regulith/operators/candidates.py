"""GR7: like candidates of one document become one, with a type, a quality and a status.

Which candidates are alike depends on their order, so groups are folded within
the row. What becomes of a group is then worked out from its members' structs in
expressions, a column a step.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as tx
from ..rules import fr_postcall as fr
from . import cascades as ca
from . import grouping
from . import postcall as pc

#: Fields of a candidate.
FIELDS = ("seq", "text", "kind", "snippet", "status", "confidence", "grounding", "grounding_verdict", "completeness", "completeness_verdict", "missing_exception", "type_match", "overlap", "quality", "error")


def compatible(a: str, b: str) -> bool:
    return a == b or any(a in g and b in g for g in fr.COMPATIBLE_TYPES)


@lru_cache(grouping.PAIRS)
def _alike(k: str, t: str, other_kind: str, other: str, least: float) -> bool:
    key = grouping.statement_key(t)
    like = compatible(k, other_kind) and (grouping.prefix_duplicate(t, other) or grouping.overlap_duplicate(t, other))
    return bool(key and key == grouping.statement_key(other)) or like or grouping.overlap(grouping.content(t), grouping.content(other)) >= least or grouping.alike(t, other, least)


def groups_of(seqs: list[int], kinds: list[str], texts: list[str], least: float) -> list[list[int]]:
    """Members of each group, in order: the same statement, a duplicate of a compatible type, or as like as ``least`` in words or characters."""
    seen, heads, out = grouping.Seen(), [], []
    for s, k, t in sorted(zip(seqs, kinds, texts, strict=True), key=lambda x: x[0]):
        k, t = (k or "AUTRE").strip().upper() or "AUTRE", (t or "").strip()
        for g in seen.near(t, least):
            if _alike(k, t, *heads[g], least):
                out[g].append(s)
                break
        else:
            seen.add(t)
            heads.append((k, t))
            out.append([s])
    return out


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _groups(seqs: pd.Series, kinds: pd.Series, texts: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([groups_of(list(s), list(k), list(t), x) for s, k, t, x in zip(seqs, kinds, texts, least, strict=True)])


def _rank(status: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s == "DRAFT", 3).when(s == "TO_VALIDATE", 2).when(s == "REJECT", 1).otherwise(0)


def _kind(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(kind)), F.lit("")), F.lit("AUTRE"))


def text_type(text: Column, otherwise: Column) -> Column:
    """Type of a plain text by the first type whose norms it holds, then by its wording."""
    order = ("INTERDICTION", "EXCEPTION", "RESPONSABILITE", "REGISTRE", "DECLARATION", "OBLIGATION", "CONDITION")
    return ca.first_match([(pc.any_cue(text, fr.TYPE_NORMS[t]), F.lit(t)) for t in order], F.coalesce(pc.inferred_type(text), otherwise))


def with_reading(df: DataFrame, text: str = "_text", source: str = "_source") -> DataFrame:
    """Add ``read``: what ``resolve`` reads from a candidate's text and source: the ``typed`` by its wording, whether it is ``descriptive``, why it is ``out`` of scope. Candidates that differ in nothing else can share it."""
    names = df.columns
    x = pc.with_plain(df, text, source, source).withColumns({"_norms": pc.hit_names(F.col("_plain"), fr.NORMS), "_told": pc.hit_names(F.col("_plain"), fr.DESCRIPTIONS)})
    descriptive = (F.size("_norms") == 0) & (F.col("_plain").contains("fait foi") | (F.size("_told") > 0))
    read = F.struct(text_type(F.col("_plain"), F.lit(None).cast("string")).alias("typed"), descriptive.alias("descriptive"), pc.out_of_scope().alias("out"))
    return x.select(*[F.col(f"`{n}`") for n in names], read.alias("read"))


def resolve(df: DataFrame, items: str, key: str = "doc_id", least: float = 0.9) -> DataFrame:
    """A row per group of ``items array<struct<FIELDS>>`` of each row.

    ``representative`` is the member with the best status, then confidence,
    grounding, completeness, then the first. Members of incompatible types are a
    conflict: the text's own type decides, else the most frequent, of equals the
    one of higher priority, and a draft goes back to validation. Penalties for
    duplicates, conflicts and what is out of scope lower the quality; ``kept`` is
    whether the group survives. A draft with a conflict, a missing exception or
    weak grounding is held back; a strong candidate is promoted. Candidates with
    ``error`` are no candidates; null or empty arrays give no row. Items may bring
    ``read`` of ``with_reading``; else it is read from each representative.
    """
    c = F.col
    x = df.select(F.col(f"`{key}`").alias(key), F.filter(F.coalesce(F.col(f"`{items}`"), F.array().cast(df.schema[items].dataType)), lambda i: ~F.coalesce(i["error"], F.lit(False))).alias("items"))
    x = x.withColumn("group", F.explode_outer(_groups("items.seq", "items.kind", "items.text", F.lit(least)))).filter(F.size(F.coalesce("group", F.array().cast("array<bigint>"))) > 0)
    x = x.withColumn("members", F.filter("items", lambda i: F.array_contains(c("group"), i["seq"]))).drop("items")
    score = lambda v: F.coalesce(v.cast("double"), F.lit(0.0))
    ranked = F.transform("members", lambda i: F.struct(-_rank(i["status"]), -score(i["confidence"]), -score(i["grounding"]), -score(i["completeness"]), i["seq"], i.alias("item")))
    x = x.withColumn("base", F.array_min(F.transform(ranked, lambda r: F.struct(r["col1"], r["col2"], r["col3"], r["col4"], r["seq"].alias("seq"))))["seq"])
    x = x.withColumn("m", F.get(F.filter("members", lambda i: i["seq"] == c("base")), F.lit(0)))
    x = x.withColumns({"kinds": F.transform("members", lambda i: _kind(i["kind"])), "_kind0": _kind(c("m.kind")), "_rank0": _rank(c("m.status")), "_status0": F.upper(F.trim(F.coalesce("m.status", F.lit(""))))})
    x = x.withColumn("_distinct", F.array_distinct("kinds"))
    if "read" in df.schema[items].dataType.elementType.names:
        x = x.withColumn("read", c("m.read"))
    else:
        x = with_reading(x.withColumns({"_text": c("m.text"), "_source": F.coalesce("m.snippet", F.lit(""))}))
    both = lambda a, b, g: a.isin(*g) & b.isin(*g)
    fits = lambda a, b: (a == b) | both(a, b, fr.COMPATIBLE_TYPES[0]) | both(a, b, fr.COMPATIBLE_TYPES[1])
    x = x.withColumns({"conflict": F.exists("_distinct", lambda a: F.exists("_distinct", lambda b: ~fits(a, b))), "_seen": F.coalesce("read.typed", "_kind0")})
    priority = F.create_map(*[F.lit(v) for kv in fr.TYPE_PRIORITY.items() for v in kv])
    often = F.array_max(F.transform("_distinct", lambda k: F.struct(F.size(F.filter("kinds", lambda o: o == k)).alias("n"), F.coalesce(priority[k], F.lit(0)).alias("p"), k.alias("k"))))["k"]
    x = x.withColumn("kind", F.when(~c("conflict"), c("_kind0")).when(c("_seen") != c("_kind0"), c("_seen")).otherwise(often))
    down = c("conflict") & (c("_rank0") >= 3)
    descriptive = (c("kind") == "AUTRE") & c("read.descriptive")
    x = x.withColumns({"_status1": F.when(down, "TO_VALIDATE").otherwise(c("_status0")), "scope": F.coalesce(c("read.out"), F.when(descriptive, "OUT_OF_SCOPE_AUTRE_DESCRIPTIVE"))})
    values = F.create_map(*[F.lit(v) for kv in fr.GROUP_PENALTIES.items() for v in kv])
    x = x.withColumn("penalties", F.array_compact(F.array(F.when(F.size("members") > 1, "DUPLICATE_GROUP"), F.when(c("conflict"), "TYPE_CONFLICT_GROUP"), c("scope"))))
    x = x.withColumn("quality", F.round(tx.clip01(score(c("m.quality")) - F.aggregate("penalties", F.lit(0.0), lambda s, p: s + F.coalesce(values[p], F.lit(0.0)))), 4))
    x = x.withColumn("_level", F.when(c("quality") >= 0.78, "DRAFT").when(c("quality") >= 0.50, "TO_VALIDATE").otherwise("REJECT"))
    x = x.withColumn("_status2", F.when((c("_level") == "TO_VALIDATE") & (_rank(c("_status1")) >= 3), "TO_VALIDATE").when((c("_level") == "DRAFT") & ~c("_status1").isin("TO_VALIDATE", "REJECT"), "DRAFT").otherwise(c("_status1")))
    verdict = F.upper(F.coalesce("m.grounding_verdict", F.lit("SOFT_FAIL")))
    blockers = ca.named([(c("conflict"), "TYPE_CONFLICT"), (F.coalesce("m.missing_exception", F.lit(False)), "MISSING_EXCEPTION"), ((verdict == "HARD_FAIL") | (score(c("m.grounding")) < 0.28), "GROUNDING_WEAK")])
    x = x.withColumn("blockers", blockers)
    x = x.withColumn("_held", (c("_level") == "DRAFT") & (F.size("blockers") > 0))
    strong = (
        ((c("_level") == "TO_VALIDATE") | c("_held"))
        & (F.size("blockers") == 0)
        & (verdict == "PASS")
        & (score(c("m.grounding")) >= 0.72)
        & (F.upper(F.coalesce("m.completeness_verdict", F.lit("SOFT_FAIL"))) == "PASS")
        & (score(c("m.completeness")) >= 0.85)
        & F.coalesce("m.type_match", F.lit(False))
        & (c("kind") != "AUTRE")
        & (c("quality") >= 0.84)
        & (score(c("m.overlap")) >= 0.16)
    )
    x = x.withColumns({"_strong": strong, "_gone": c("scope").isNotNull() | (c("_level") == "REJECT")})
    status = F.when(c("_strong") & (c("_status2") != "REJECT"), "DRAFT").when(c("_held") & ~c("_status2").isin("REJECT", "TO_VALIDATE"), "TO_VALIDATE").otherwise(c("_status2"))
    decision = F.when(c("_gone"), "REJECT").when(c("_strong"), "DRAFT").when(c("_held"), "TO_VALIDATE").otherwise(c("_level"))
    x = x.withColumns({"status": status, "decision": decision})
    said = ca.named(
        [
            (c("conflict"), "TYPE_CONFLICT_GROUP"),
            (c("conflict") & (c("_seen") != c("_kind0")), "TYPE_ARBITRATION_TEXT_MATCH"),
            (c("conflict") & (c("_seen") == c("_kind0")) & (c("kind") != c("_kind0")), "TYPE_ARBITRATION_FREQUENCY"),
            (c("conflict") & (c("_rank0") >= 3), "TYPE_CONFLICT_STATUS_DOWNGRADED"),
            (c("scope").isNotNull(), "OUT_OF_SCOPE"),
            (c("scope").isNull() & c("_held"), "QUALITY_DRAFT_BLOCKED_RISK"),
            (c("scope").isNull() & c("_strong"), "QUALITY_PROMOTED_TO_DRAFT_STRONG"),
            (c("scope").isNull() & (c("_level") == "REJECT"), "QUALITY_SCORE_REJECT"),
            (~c("_gone") & (c("_rank0") >= 3) & (c("status") == "TO_VALIDATE"), "QUALITY_STATUS_DOWNGRADED"),
        ]
    )
    reasons = F.transform(said, lambda r: F.when(r == "OUT_OF_SCOPE", c("scope")).otherwise(r))
    blocked = F.when(c("_held") & c("scope").isNull(), F.transform("blockers", lambda b: F.concat(F.lit("QUALITY_DRAFT_BLOCKED_"), b))).otherwise(F.array().cast("array<string>"))
    return x.select(key, F.array_min("group").alias("first_seq"), c("base").alias("representative"), "kind", F.size("members").alias("members"), "conflict", "quality", "decision", "status", (~c("_gone")).alias("kept"), F.concat(reasons, blocked).alias("reasons"))
