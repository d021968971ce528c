"""CF4: a statement with several obligations becomes one for each, with the rule that split it.

Rules are tried in order; the first that gives two statements or more decides.
Each rule's statements are a column of their own, arrays within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..rules import fr_snippets as fr
from . import citations as ci


def _item(x: Column) -> Column:
    return F.btrim(tx.spaces(x), F.lit(" .;"))


def _low(x: Column) -> Column:
    return F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def _rebuilt(part: Column, subject: Column) -> Column:
    """An item of a list under its subject and modal; one with a modal of its own stands for itself."""
    bare = tx.spaces(F.regexp_replace(_item(part), fr.ITEM_SIGN, ""))
    unlinked = F.when(subject.rlike(fr.LINK_END), F.regexp_replace(bare, fr.LINK, "")).otherwise(bare)
    return F.when(bare == "", "").when(bare.rlike(fr.MODAL), bare).otherwise(F.concat_ws(" ", subject, _low(unlinked)))


def split_statements(df: DataFrame, requirement: str = "requirement", kind: str = "kind") -> DataFrame:
    """Add ``parts array<struct<text, rule, source>>``; a statement that no rule splits, or of another type, stays one, with rule KEPT.

    DOCUMENT: a list of what a document must hold; WARNING: warn, then wait;
    AUXILIARY: one subject that is this and is that; MODAL: several modals of one
    subject; COMPOSITION: made up of this; and of that; COLON: a list behind a
    colon; LIST: obligations chained by semicolons; INFINITIVE: several actions of
    one modal. Null and empty texts have no parts.
    """
    c = F.col
    empty = F.array().cast("array<string>")
    names = df.columns
    x = df.withColumns({"_r": tx.spaces(requirement), "_k": F.upper(F.trim(F.coalesce(c(kind), F.lit(""))))})
    group = lambda p, i: tx.spaces(F.regexp_extract("_r", p, i))
    x = x.withColumns(
        {
            "_lines": F.filter(F.transform(F.split("_r", ";"), _item), lambda p: p != ""),
            "_modal": group(fr.MODAL_CHAIN, 1),
            "_body": _item(group(fr.MODAL_CHAIN, 2)),
            "_colon": group(fr.COLON_LIST, 1),
            "_listed": _item(group(fr.COLON_LIST, 2)),
            "_lead": group(fr.REPEATED_LEAD, 1),
            "_made": group(fr.COMPOSITION_CHAIN, 1),
            "_one": _item(group(fr.AUXILIARY_CHAIN, 3)),
            "_two": _item(group(fr.AUXILIARY_CHAIN, 5)),
        }
    )
    head = F.coalesce(F.get("_lines", F.lit(0)), F.lit(""))
    x = x.withColumns({"_intro": tx.spaces(F.regexp_extract(head, fr.DOCUMENT_INTRO, 1)), "_first": tx.spaces(F.regexp_extract(head, fr.DOCUMENT_INTRO, 2)), "_headed": tx.spaces(F.regexp_extract(head, fr.MODAL_CHAIN, 1))})
    rest = F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))

    def listed(part: Column) -> Column:
        bare = _item(F.regexp_replace(part, fr.LEADING_AND, ""))
        return F.when(bare == "", "").when(bare.rlike(fr.MODAL), bare).otherwise(F.concat_ws(" ", c("_intro"), _low(bare)))

    def chain(subject: str, body: str) -> Column:
        found = [F.filter(F.transform(F.split(c(body), p), _item), lambda q: q != "") for p in (fr.LIST_SPLIT, fr.AND_SPLIT, fr.COMMA_SPLIT)]
        return F.when(c(subject) != "", F.transform(F.coalesce(*[F.when(F.size(f) >= 2, f) for f in found], empty), lambda p: _rebuilt(p, c(subject)))).otherwise(empty)

    warned = group(fr.WARNING, 1)
    who = F.coalesce(F.nullif(F.trim(group(fr.WARNING, 2)), F.lit("")), F.lit(fr.WARNED))
    segments = F.transform(F.split(F.concat_ws(" ", group(fr.REPEATED_LEAD, 2), group(fr.REPEATED_LEAD, 3)), fr.REPEATED_SPLIT), _item)
    rules = {
        "DOCUMENT": F.when((F.size("_lines") >= 2) & (c("_intro") != ""), F.concat(F.array(F.concat_ws(" ", "_intro", _low(c("_first")))), F.transform(rest, listed))),
        "WARNING": F.when(warned != "", F.array(F.concat_ws(" ", F.trim(warned), who, F.lit(fr.WARN)), F.concat_ws(" ", F.trim(warned), who, F.lit(fr.WAIT), group(fr.WARNING, 3)))),
        "AUXILIARY": F.when((c("_one") != "") & (c("_two") != "") & (F.lower("_one") != F.lower("_two")), F.array(F.concat_ws(" ", group(fr.AUXILIARY_CHAIN, 1), group(fr.AUXILIARY_CHAIN, 2), "_one"), F.concat_ws(" ", group(fr.AUXILIARY_CHAIN, 1), group(fr.AUXILIARY_CHAIN, 4), "_two"))),
        "MODAL": F.when((c("_lead") != "") & (F.size(segments) >= 2), F.transform(F.filter(segments, lambda s: s.rlike(fr.MODAL_START)), lambda s: F.concat_ws(" ", c("_lead"), s))),
        "COMPOSITION": F.when(c("_made") != "", F.array(F.concat_ws(" ", "_made", _item(group(fr.COMPOSITION_CHAIN, 2))), F.concat_ws(" ", "_made", _item(group(fr.COMPOSITION_CHAIN, 3))))),
        "COLON": chain("_colon", "_listed"),
        "LIST": F.when((F.size("_lines") >= 2) & (c("_headed") != ""), F.concat(F.array(head), F.transform(rest, lambda p: _rebuilt(p, c("_headed"))))),
        "INFINITIVE": chain("_modal", "_body"),
    }
    x = x.withColumns({f"_rule_{n}": ci._distinct_statements(F.coalesce(e, empty)) for n, e in rules.items()})
    tried = [F.when(c("_k").isin(*fr.SPLITTABLE_TYPES) & (F.size(f"_rule_{n}") >= 2), F.struct(F.lit(n).alias("n"), c(f"_rule_{n}").alias("t"))) for n in rules]
    x = x.withColumn("_split", F.coalesce(*tried, F.struct(F.lit("KEPT").alias("n"), F.array("_r").alias("t"))))
    parts = F.transform("_split.t", lambda t: F.struct(t.alias("text"), c("_split.n").alias("rule"), c("_r").alias("source")))
    none = F.filter(parts, lambda p: F.lit(False))
    return x.select(*[F.col(f"`{n}`") for n in names], F.when(c("_r") == "", none).otherwise(parts).alias("parts"))
