"""Citations cut out of their sources, chains of actions split, and fall-backs of units.

A text's candidates form a lattice: the whole, its sentences, their clauses,
neighbouring clauses joined, each clause with the sentence's introduction, and
chains of actions split under their subject. All of it are arrays within the
row; every step is a column of its own, so that what several steps read is
computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..rules import fr_requirements, fr_snippets as fr
from . import requirement_rules as rr

EDGES = " ,;:-"
LAST = 24  # signs of a candidate's end that show whether it dangles: more than the longest such word


def _edged(x: Column) -> Column:
    return F.btrim(tx.spaces(x), F.lit(EDGES))


def _parts(x: Column, pattern: str, clean=_edged) -> Column:
    return F.filter(F.transform(F.split(x, pattern), clean), lambda p: p != "")


def without_leading(x: str | Column) -> Column:
    """A statement without page, gazette and article headers in front."""
    out = tx.respaced(tx._c(x))
    for _ in range(3):
        for pattern in fr_requirements.LEADING:
            out = F.regexp_replace(out, pattern, "")
    # what goes stands in front: the rest is spaced already
    return F.trim(out)


def cleaned(x: str | Column) -> Column:
    """A source as it is cited: overlap marks, headers and OCR noise off."""
    out = tx.ocr_repaired(without_leading(F.regexp_replace(tx.spaces(x), fr.OVERLAP_MARK, " ")))
    return F.trim(F.regexp_replace(tx.replaced_where(out, fr.DOUBLED), fr.LEADING_SIGNS, ""))


def _distinct_statements(parts: Column) -> Column:
    """Statements that end with one full stop, the first of those that differ only in case and end signs."""
    key = lambda p: F.lower(F.btrim(p, F.lit(" .;,:")))
    kept = F.filter(parts, lambda p: key(p) != "")
    keys = F.transform(kept, key)
    first = F.filter(F.transform(kept, lambda p, i: F.when(F.array_position(keys, F.element_at(keys, i + 1)) == i + 1, F.concat(F.rtrim(F.regexp_replace(p, r"\.+$", "")), F.lit(".")))), lambda p: p.isNotNull())
    return first


def chained_actions(sentence: Column) -> Column:
    """CF4: the actions that one subject has in a sentence, as statements of their own; empty where there is one only."""
    return tx.once(_edged(sentence), lambda s: _chain(s))


def _may_chain(text: Column) -> Column:
    """Whether any sentence of a text may have a chain."""
    return tx.may_match(text, fr.CHAIN_WORDS) | text.rlike(fr.AUXILIARY_SIGN)


def _chain(s: Column, may: Column | None = None) -> Column:
    """The same of an edged sentence, which is read once; ``may`` be told for its whole text."""
    group = lambda p, i: F.btrim(tx.spaces(F.regexp_extract(s, p, i)), F.lit(" .;"))
    one, two = group(fr.AUXILIARY_CHAIN, 3), group(fr.AUXILIARY_CHAIN, 5)
    say = lambda i, what: F.concat_ws(" ", group(fr.AUXILIARY_CHAIN, 1), group(fr.AUXILIARY_CHAIN, i), what)
    twice = F.when((one != "") & (two != "") & (F.lower(one) != F.lower(two)), F.array(say(2, one), say(4, two))).otherwise(F.array().cast("array<string>"))
    subject, body = tx.spaces(F.regexp_extract(s, fr.MODAL_CHAIN, 1)), group(fr.MODAL_CHAIN, 2)
    item = lambda p: F.btrim(tx.spaces(p), F.lit(" .;"))
    lists = [_parts(body, p, item) for p in (fr.LIST_SPLIT, fr.AND_SPLIT, fr.COMMA_SPLIT)]
    parts = F.coalesce(*[F.when(F.size(x) >= 2, x) for x in lists], F.array().cast("array<string>"))

    def rebuilt(p: Column) -> Column:
        bare = tx.spaces(F.regexp_replace(p, fr.ITEM_SIGN, ""))
        unlinked = F.when(subject.rlike(fr.LINK_END), F.regexp_replace(bare, fr.LINK, "")).otherwise(bare)
        low = F.concat(F.lower(F.substring(unlinked, 1, 1)), F.substring(unlinked, 2, 1 << 30))
        return F.when(bare == "", "").when(bare.rlike(fr.MODAL), bare).otherwise(F.concat_ws(" ", subject, low))

    modal = F.when(s.rlike(fr.MODAL_CHAIN), F.transform(parts, rebuilt)).otherwise(F.array().cast("array<string>"))
    # most sentences have no chain: look before taking them apart
    return F.when(s.rlike(fr.CHAIN_SIGN) if may is None else may & s.rlike(fr.CHAIN_SIGN), _distinct_statements(F.concat(twice, modal))).otherwise(F.array().cast("array<string>"))


def _bare(x: Column) -> Column:
    """``_edged`` of a part of a cleaned text, whose white space is single blanks already."""
    return F.btrim(x, F.lit(EDGES))


def _spaced_chain(s: Column, may: Column) -> Column:
    return F.transform(_chain(s, may), lambda t: tx.spaces(t))


def _clauses(sentence: Column) -> Column:
    # most sentences are one clause: a pattern is compiled anew for every text that it splits
    split = lambda x, pattern: F.when(x.rlike(pattern), _parts(x, pattern, _bare)).otherwise(F.array(x))
    return F.flatten(F.transform(split(sentence, fr.CLAUSE_SPLIT), lambda p: split(p, fr.INLINE_SPLIT)))


def _intro(clause: Column) -> Column:
    """What stands before a clause's condition or exception, if it is long enough and holds a verb of a rule."""
    before = lambda c: tx.once(F.regexp_instr(c, F.lit(fr.INTRO_CUE)), lambda at: F.when(at > 0, F.btrim(F.substring(c, F.lit(1), at - 1), F.lit(EDGES))).otherwise(""))
    holds = lambda low: F.exists(F.array(*map(F.lit, fr.INTRO_MARKERS)), lambda m: F.contains(low, m))
    return tx.once(tx.once(clause, before), lambda intro: F.when((F.length(intro) >= fr.INTRO_LEAST) & tx.once(F.lower(intro), holds), intro).otherwise(""))


def _merged(intro: Column, clause: Column) -> Column:
    bare = F.trim(F.regexp_replace(clause, r"(?iuU)^(?:et|ou)\s+", ""))
    return F.when(F.startswith(F.lower(bare), F.lower(intro)), bare).otherwise(F.concat_ws(" ", intro, bare))


def with_candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out array<string>``: all candidates of a cleaned text, in the lattice's order, repeats included, spaced: parts of the text are, what is put together is made so."""
    names = df.columns
    x = df.withColumns({"_sentences": _parts(F.col(text), fr.SENTENCE_SPLIT, _bare), "_may": _may_chain(F.col(text))})
    may = F.col("_may")
    x = x.withColumn("_split", F.transform("_sentences", lambda s: F.struct(s.alias("s"), _clauses(s).alias("c"), _spaced_chain(s, may).alias("k"))))
    x = x.withColumn("_intro", F.transform("_split", lambda p: F.struct(p["s"].alias("s"), p["c"].alias("c"), p["k"].alias("k"), _intro(F.coalesce(F.get(p["c"], F.lit(0)), p["s"])).alias("i"))))

    def of_clauses(p: Column) -> Column:
        def one(clause: Column, i: Column) -> Column:
            merged = F.when((i > 0) & (p["i"] != ""), tx.spaces(_merged(p["i"], clause)))
            joined = F.when(i + 1 < F.size(p["c"]), F.concat(clause, F.lit("; "), F.get(p["c"], i + 1)))
            return F.concat(F.array(clause), F.when(clause == p["s"], p["k"]).otherwise(_spaced_chain(clause, may)), F.array(merged, joined))

        return F.flatten(F.transform(p["c"], one))

    x = x.withColumn("_all", F.flatten(F.transform("_intro", lambda p: F.concat(F.array(p["s"]), p["k"], of_clauses(p)))))
    every = F.filter(F.concat(F.array(text), "_all"), lambda c: c.isNotNull() & (c != ""))
    return x.select(*[F.col(f"`{n}`") for n in names], every.alias(out))


def words(x: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(fr.TOKEN), F.lit(0))), lambda w: ~w.isin(*fr.STOP))


def _holds(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in cues:
        out = out | F.contains(text, F.lit(c))
    return out


def _truncated(value: Column, wanted: Column) -> Column:
    """At most ``MOST`` signs, or somewhat more for a long requirement: cut at a clause's end behind ``MOST``, else at the last end or blank before the limit."""
    limit = F.when(wanted >= int(fr.MOST * 0.82), F.least(F.lit(fr.WIDEST), F.greatest(F.lit(fr.MOST + 40), wanted + 32))).otherwise(fr.MOST)
    marks = ("; ", ". ", ": ", ", ")
    ahead = F.array_min(F.filter(F.array(*[F.locate(m, value, fr.MOST + 1) - 1 for m in marks]), lambda p: (p > 0) & (p <= limit)))
    head = F.substring(value, F.lit(1), limit)
    back = F.array_max(F.array(*[F.length(head) - F.length(F.substring_index(head, m, -1)) - len(m) for m in (*marks, " ")]))
    cut = lambda n: F.btrim(F.substring(value, F.lit(1), n), F.lit(EDGES))
    word = F.btrim(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(EDGES))
    return F.when(F.length(value) <= limit, value).when(ahead.isNotNull(), cut(ahead)).when(back >= F.floor(limit * 0.55), cut(back)).otherwise(F.coalesce(F.nullif(word, F.lit("")), F.btrim(head, F.lit(EDGES))))


def best_citation(df: DataFrame, requirement: str = "requirement", source: str = "snippet", chunk: str = "chunk") -> DataFrame:
    """CF3: add ``citation, citation_score``: the candidate of source and chunk that holds most of the requirement's words.

    A condition's cue counts 0.12 if the requirement itself has one, a norm 0.04;
    candidates much longer or shorter than a requirement of forty signs or more,
    with a dangling end, or over the limit lose. Ties go to the shorter, then to
    the earlier in the lattice. Below 0.18 the source stands, or the chunk where
    there is none; null and empty texts give an empty citation.
    """
    names = df.columns
    c = F.col
    x = df.withColumns({"_req": without_leading(requirement), "_src": cleaned(source), "_chunk": cleaned(chunk)})
    x = with_candidates(with_candidates(x, "_src", "_of_src"), "_chunk", "_of_chunk")
    x = x.withColumns({"_want": words(c("_req")), "_long": F.length("_req"), "_need": _holds(F.lower("_req"), fr.CONDITION_CUES), "_cands": F.array_distinct(F.concat("_of_src", "_of_chunk"))})
    # parts are joined by signs that no cue's word holds: what no source holds, no candidate does
    x = x.withColumns({"_needs": c("_need") & (tx.may_match(c("_src"), fr.CONDITION_WORDS) | tx.may_match(c("_chunk"), fr.CONDITION_WORDS)), "_norms": tx.may_match(c("_src"), fr.NORM_WORDS) | tx.may_match(c("_chunk"), fr.NORM_WORDS)})

    def score(e: Column) -> Column:
        ratio = e["n"] / F.greatest(c("_long"), F.lit(1))
        sized = F.when(c("_long") >= 40, F.when(ratio > 1.8, -0.05).otherwise(0.0) + F.when(ratio > 2.4, -0.08).otherwise(0.0) + F.when(ratio < 0.35, -0.04).otherwise(0.0)).otherwise(0.0)
        # the requirement's words hold no stop word, and each once: the candidate's need not be sifted
        found = F.array_intersect(c("_want"), F.regexp_extract_all(e["low"], F.lit(fr.TOKEN), F.lit(0)))
        shared = F.when(F.size("_want") > 0, F.size(found) / F.size("_want")).otherwise(0.0)
        s = shared + F.when(c("_needs") & _holds(e["low"], fr.CONDITION_CUES), 0.12).otherwise(0.0) + F.when(c("_norms") & _holds(e["low"], fr.NORM_CUES), 0.04).otherwise(0.0) + sized
        s = s - F.when(e["end"].rlike(fr.DANGLING_END), 0.12).otherwise(0.0) - F.when(e["n"] > fr.MOST, 0.03).otherwise(0.0)
        return F.when(e["n"] < 15, -1.0).otherwise(F.round(s, 4))

    # candidates are spaced already; what the score asks for is made once
    read = lambda t: F.struct(F.length(t).alias("n"), F.lower(t).alias("low"), F.right(t, F.lit(LAST)).alias("end"))
    rated = lambda t: tx.once(tx.once(_bare(t), read), score)
    x = x.withColumn("_rated", F.transform("_cands", lambda t, i: F.struct((-rated(t)).alias("s"), F.length(t).alias("n"), i.alias("i"), t.alias("t"))))
    x = x.withColumn("_best", F.array_min("_rated"))
    back = F.when(c("_src") != "", c("_src")).otherwise(c("_chunk"))
    x = x.withColumn("_chosen", F.when(-c("_best.s") >= fr.LEAST, c("_best.t")).otherwise(back))
    x = x.withColumn("_value", _edged(c("_chosen")))
    return x.select(*[F.col(f"`{n}`") for n in names], _truncated(c("_value"), c("_long")).alias("citation"), F.coalesce(-c("_best.s"), F.lit(0.0)).alias("citation_score"))


def _typed(df: DataFrame, text: str, source: str, model: str, out: str) -> DataFrame:
    """Add ``out``: a statement's type by its markers, OBLIGATION where none shows."""
    names = df.columns
    x = df.withColumns({"req": rr.plain(text), "src": rr.plain(source)}).withColumn("both", F.concat("req", F.lit(" || "), "src")).withColumn("model", F.lit(model))
    x = rr.with_bits(x, "req", "both").withColumn("_kind", rr.spark_sql(rr.requirement_type("req", "both", "model"), "req", "both"))
    return x.select(*[F.col(f"`{n}`") for n in names], F.when(F.col("_kind") == "AUTRE", "OBLIGATION").otherwise(F.col("_kind")).alias(out))


def _here(x: Column) -> Column:
    """Not deterministic on purpose: a filter on the text stays behind it, and is not pushed below the grouping of equal units, with all its steps copied."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def empty_fallback(df: DataFrame, unit: str = "unit") -> DataFrame:
    """CF5: rows whose unit speaks of a norm though nothing was extracted from it, with ``fallback_text, fallback_type``: the candidate with the strongest cues, the shortest of equals."""
    names = df.columns
    own = F.regexp_replace(tx.spaces(tx.sanitize(unit)), rr.HEADER, "")
    x = df.withColumn("_source", _here(tx.ocr_repaired(tx.spaces(own)))).filter((F.length("_source") >= fr.FALLBACK_LEAST) & F.col("_source").rlike(fr.FALLBACK_TRIGGER))
    x = with_candidates(x.withColumn("_clean", cleaned("_source")), "_clean", "_cands")
    x = x.withColumn("_kept", F.filter(F.transform("_cands", lambda t: _edged(tx.ocr_repaired(without_leading(t)))), lambda t: (F.length(t) >= fr.CANDIDATE_LEAST) & t.rlike(fr.FALLBACK_TRIGGER)))
    x = x.withColumn("_kept", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.array("_source")))

    def lost(t: Column) -> Column:
        return -(F.when(t.rlike(fr.FALLBACK_TRIGGER), 1.4).otherwise(0.0) + F.when(t.rlike(fr.FALLBACK_NORM), 1.0).otherwise(0.0) - F.when(tx.ocr_signals(t), 0.45).otherwise(0.0) - F.when(t.rlike(fr.FALLBACK_HEADING), 0.35).otherwise(0.0))

    x = x.withColumn("_best", F.array_min(F.transform("_kept", lambda t, i: F.struct(F.round(lost(t), 4).alias("s"), F.length(t).alias("n"), i.alias("i"), t.alias("t")))))
    x = _typed(x.withColumn("fallback_text", F.col("_best.t")), "fallback_text", "_source", "AUTRE", "fallback_type")
    return x.select(*[F.col(f"`{n}`") for n in names], "fallback_text", "fallback_type")


def covered(existing: Column) -> Column:
    """Whether a statement of an array says who supervises."""
    return F.exists(F.coalesce(existing, F.array().cast("array<string>")), lambda t: F.coalesce(t.rlike(fr.SUPERVISION), F.lit(False)))


def supervision_fallback(df: DataFrame, unit: str = "unit", existing: str = "existing") -> DataFrame:
    """CF5: rows whose unit says who supervises though no statement of ``existing array<string>`` does, with ``fallback_text, fallback_type``: the first such sentence, or the whole where it also fixes a composition that the sentence leaves out."""
    names = df.columns
    c = F.col
    x = df.withColumn("_source", _here(tx.spaces(F.regexp_replace(tx.spaces(unit), rr.HEADER, ""))))
    x = x.filter((F.length("_source") >= fr.FALLBACK_LEAST) & c("_source").rlike(fr.SUPERVISION) & ~covered(c(existing)))
    sentences = F.transform(F.split("_source", r"(?<=[\.;!?])\s+"), lambda s: F.btrim(s, F.lit(" -")))
    first = F.get(F.filter(sentences, lambda s: (F.length(s) >= fr.SENTENCE_LEAST) & s.rlike(fr.SUPERVISION)), F.lit(0))
    ended = lambda t: F.when(t.rlike(r"[.;:]$"), t).otherwise(F.concat(t, F.lit(".")))
    x = x.withColumn("_first", ended(F.coalesce(first, c("_source"))))
    x = _typed(x, "_first", "_source", "OBLIGATION", "fallback_type")
    whole = F.lower("_source").contains("composition") & F.lower("_source").contains("fix") & ~c("_first").rlike(fr.COMPOSITION_FIXED) & c("_source").rlike(fr.COMPOSITION_FIXED)
    return x.select(*[F.col(f"`{n}`") for n in names], F.when(whole, ended(c("_source"))).otherwise(c("_first")).alias("fallback_text"), "fallback_type")
