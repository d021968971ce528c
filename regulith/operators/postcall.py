"""What a statement lacks, whether it is in scope, and what becomes of it after extraction.

Detectors read texts in plain letters (``plain``), so accents don't matter;
they are expressions inside the row. Only the character ratios of grounding and
subjects need Python, in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..rules import fr_postcall as fr
from . import cascades as ca
from . import grouping


def plain(x: str | Column) -> Column:
    """Lower case, no accents, straight apostrophes, one blank."""
    return F.translate(tx.fold(F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), " ", " ")), "’‘", "''")


def any_cue(text: Column, cues: tuple[str, ...]) -> Column:
    return text.rlike("|".join(cues))


def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def hit_names(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Names of the patterns that a plain text holds, in order."""
    return ca.named([(text.rlike(p), n) for n, p in rules])


def content(text: Column) -> Column:
    return sim.content_tokens(text, fr.STOP)


def scope_present(req: Column, source: Column) -> Column:
    """A cue of scope in the requirement, or enough words of what follows a cue of the source."""
    windows = F.regexp_extract_all(source, F.lit(f"(?=(?:{'|'.join(fr.SCOPE_CUES)}))(?=(.{{1,{fr.SCOPE_WINDOW}}}))"), F.lit(1))
    return any_cue(req, fr.SCOPE_CUES) | F.exists(windows, lambda w: sim.jaccard(content(w), content(req)) >= fr.SCOPE_SHARED)


def with_plain(df: DataFrame, requirement: str, snippet: str, chunk: str) -> DataFrame:
    """Add the texts in plain letters that the detectors read: ``_plain``, ``_plain_src``, ``_both``, and ``_basis``, the citation or the chunk where there is none.

    Steps are columns of their own, so that what several of them use is computed once.
    """
    x = df.withColumns({"_plain": plain(requirement), "_plain_src": plain(snippet), "_plain_chunk": plain(chunk)})
    return x.withColumns({"_basis": F.when(F.col("_plain_src") != "", F.col("_plain_src")).otherwise(F.col("_plain_chunk")), "_both": F.trim(F.concat("_plain", F.lit(" || "), "_plain_src"))})


def with_completeness(df: DataFrame) -> DataFrame:
    """GR2: add ``_whole struct<score, verdict, missing, reasons>`` to rows of ``with_plain``.

    Missing can be the CONDITION, EXCEPTION or SCOPE that the source has, the
    OBJECT of a verb that needs one, the TAIL of a sentence that breaks off, and
    GRANULARITY where several actions are fused.
    """
    req, source = F.col("_plain"), F.col("_basis")
    condition = lambda x: any_cue(x, fr.CONDITION_CUES) | any_of(x, fr.CONDITION_FRAGMENTS)
    exception = lambda x: any_cue(x, fr.EXCEPTION_CUES) | any_of(x, fr.EXCEPTION_FRAGMENTS)
    scoped = (F.length(source) >= fr.SCOPE_CHARS) & (any_cue(source, fr.SCOPE_CUES) | any_of(source, fr.SCOPE_FRAGMENTS))
    lacks = {
        "CONDITION": condition(source) & ~condition(req),
        "EXCEPTION": exception(source) & ~exception(req),
        "SCOPE": scoped & ~(scope_present(req, source) | any_of(req, fr.SCOPE_FRAGMENTS)),
        "OBJECT": req.rlike(fr.MISSING_OBJECT),
        "TAIL": req.rlike(fr.DANGLING_TAIL),
        "GRANULARITY": (req.contains(";") & req.rlike(fr.FUSED_LIST)) | req.rlike(fr.FUSED_AUXILIARY) | req.rlike(fr.FUSED_MODAL),
    }
    x = df.withColumns({f"_lacks_{n}": c for n, c in lacks.items()})
    x = x.withColumn("_missing", ca.named([(F.col(f"_lacks_{n}"), n) for n, _ in fr.MISSING]))
    score = F.lit(1.0)
    for n, w in fr.MISSING:
        score = score - F.when(F.col(f"_lacks_{n}"), w).otherwise(0.0)
    verdict = F.when(F.size("_missing") == 0, "PASS").when(F.size("_missing") == 1, "SOFT_FAIL").otherwise("HARD_FAIL")
    names = F.create_map(*[F.lit(v) for kv in fr.MISSING_REASONS.items() for v in kv])
    whole = F.struct(F.round(tx.clip01(score), 4).alias("score"), verdict.alias("verdict"), F.col("_missing").alias("missing"), F.transform("_missing", lambda m: names[m]).alias("reasons"))
    return x.withColumn("_whole", whole)


def out_of_scope() -> Column:
    """GR6: why a row of ``with_plain`` is out of scope, or null: publication, a changed table of parcels, an individual act."""
    both = F.col("_both")
    act, competes = any_of(both, fr.ACT_MARKERS), any_of(both, fr.COMPETITIONS)
    general, named = any_of(both, fr.GENERAL_NORMS), both.rlike(fr.ACT_NAME)
    parcels = both.contains("tableau annex") & both.contains("parcelle") & both.contains("modifie")
    return (
        F.when(both.rlike(fr.PUBLICATION), "OUT_OF_SCOPE_PUBLICATION")
        .when(parcels, "OUT_OF_SCOPE_AUTRE_DESCRIPTIVE")
        .when(competes | general, F.lit(None).cast("string"))
        .when(named & act & ~any_of(both, fr.INSTITUTIONS), "OUT_OF_SCOPE_INDIVIDUAL_ACT")
        .when(act & both.contains("par delegation") & any_of(both, fr.SIGNING), "OUT_OF_SCOPE_INDIVIDUAL_ACT")
    )


def ocr_pollution(overlap: Column, signs: Column, norms: Column) -> Column:
    """GR6: a citation that mixes articles, page heads or headings of other texts, unless the requirement still follows it closely (``signs`` of OCR in the citation, ``norms`` of the requirement)."""
    src = F.col("_plain_src")
    hits = F.regexp_count(src, F.lit(fr.MIXED_SOURCE)) + F.when(src.contains("journal officiel"), 2).otherwise(0) + F.when(F.regexp_count(src, F.lit(fr.ARTICLE_REFERENCE)) >= 2, 1).otherwise(0)
    close, backed = (overlap >= 0.62) & ~signs, (F.size(norms) >= 2) & (overlap >= 0.42)
    return F.when((src != "") & (hits >= 2) & ~close & ~backed, "OCR_SOURCE_MIXED_ARTICLE")


def clause_blend(norms: Column, share: Column) -> Column:
    """GR6: two clauses run into one at a dash, or words broken by hyphens in a statement with norms and a ``share`` of OCR artefacts."""
    t = F.col("_plain")
    tail = F.when(t.contains(" - "), F.regexp_extract(t, r"(?s)^.*? - (.*)$", 1)).otherwise("")
    restarts = any_of(t, fr.DASH_RESTARTS) & any_of(t, fr.FIRST_MODALS) & any_of(tail, fr.SECOND_MODALS)
    broken = (F.regexp_count(t, F.lit(fr.BROKEN_HYPHEN)) >= 2) & (F.size(norms) >= 1) & (share >= 0.08)
    return F.when((t != "") & (t.rlike(fr.LEADING_BLEND) | t.rlike(fr.DASH_BLEND) | restarts | broken), "OCR_CORRUPTED_CLAUSE_BLEND")


def inferred_type(text: Column) -> Column:
    """Type of a plain text by its wording, null if none shows."""
    reports = text.rlike(fr.REPORTS) & (text.rlike(fr.REPORTED_TO) | any_of(text, ("chaque annee", "annuellement")))
    modal = F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(" doit ")) | text.contains("est tenu")
    return (
        F.when(text.rlike(fr.RESTRICTED), "CONDITION")
        .when(text.rlike(fr.FORBIDDEN), "INTERDICTION")
        .when(any_of(text, fr.EXCEPTION_FRAGMENTS), "EXCEPTION")
        .when(any_of(text, fr.CONDITION_FRAGMENTS), "CONDITION")
        .when(any_of(text, ("responsable", "repond de")), "RESPONSABILITE")
        .when(any_of(text, ("registre", "consigner")), "REGISTRE")
        .when(any_of(text, ("notifier", "declar")) | reports, "DECLARATION")
        .when(modal | text.rlike(fr.LEGAL_EFFECT), "OBLIGATION")
    )


def type_matches(kind: Column, text: Column) -> Column:
    """GR4: the type's own norms stand in a plain text, or its wording shows no other type."""
    own = F.lit(False)
    for name, patterns in fr.TYPE_NORMS.items():
        own = own | ((kind == name) & any_cue(text, patterns))
    seen = inferred_type(text)
    return own | seen.isNull() | (seen == kind)


def assess(df: DataFrame) -> DataFrame:
    """GR1 to GR6 of rows with ``requirement, kind, snippet, chunk, confidence, status, strength``: adds ``a``.

    ``a`` holds decision, status, scores (``overlap``, grounding, completeness,
    subject, quality, risk), ``reasons`` in the order of the checks, and whether
    a drop is a controlled reject. Nulls count as empty, a null type as AUTRE, a
    null status as TO_VALIDATE, a null confidence as 0.
    """
    return decide(read_texts(df), df.columns)


def read_texts(df: DataFrame) -> DataFrame:
    """What ``assess`` reads from ``requirement, kind, snippet, chunk``, as columns for ``decide``; statements that differ in nothing else can share it."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    x = df.withColumns({"_req": text("requirement"), "_src": text("snippet"), "_chunk": text("chunk"), "_kind": F.coalesce(F.nullif(F.upper(text("kind")), F.lit("")), F.lit("AUTRE"))})
    x = with_completeness(with_plain(x, "_req", "_src", "_chunk"))
    x = x.withColumns({"_ground": grouping.grounding("_req", "_src", "_chunk"), "_overlap": F.when(F.col("_src") != "", sim.jaccard(sim.tokens("_req"), sim.tokens("_src"))).otherwise(0.0)})
    x = x.withColumns(
        {
            "_norms": hit_names(F.col("_plain"), fr.NORMS),
            "_told": hit_names(F.col("_plain"), fr.DESCRIPTIONS),
            "_match": type_matches(F.col("_kind"), F.col("_plain")),
            "_subject": grouping.subject_consistency("_req", F.when(F.col("_src") != "", F.col("_src")).otherwise(F.col("_chunk"))),
            "_out": out_of_scope(),
            "_signs": tx.ocr_signals("_req"),
            "_src_signs": tx.ocr_signals("_src"),
            "_heavy": tx.ocr_heavy("_req"),
            "_src_heavy": tx.ocr_heavy("_src"),
            "_share": tx.ocr_share("_req"),
            "_src_share": tx.ocr_share("_src"),
        }
    )
    told = F.lower(F.when(F.col("_src") != "", F.col("_src")).otherwise(F.col("_chunk")))
    return x.withColumns(
        {
            "_mixed": ocr_pollution(F.col("_overlap"), F.col("_src_signs"), F.col("_norms")),
            "_blend": clause_blend(F.col("_norms"), F.greatest("_share", "_src_share")),
            "_short": (F.length("_req") < 15) | (F.size(F.split("_plain", " ")) < 3),
            "_optional": ca.hit(told, fr.OPTIONAL) & ~ca.hit(told, fr.IMPERATIVE),
        }
    )


def decide(x: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` and ``a`` of ``assess``, from rows of ``read_texts`` with ``confidence, status, strength``."""
    c = F.col
    x = x.withColumns({"_conf": F.coalesce(c("confidence").cast("double"), F.lit(0.0)), "_status": F.coalesce("status", F.lit("TO_VALIDATE")), "_strength": F.upper(F.trim(F.coalesce("strength", F.lit(""))))})
    normed, cited = F.size("_norms") > 0, c("_src") != ""
    grounding, whole = c("_ground.verdict"), c("_whole.verdict")
    ocr_drop = c("_heavy") & (c("_src_heavy") | (c("_overlap") < 0.82) | (c("_share") >= 0.16))
    hard_low, soft_low = cited & (c("_overlap") < fr.HARD_OVERLAP) & ~normed, cited & (c("_overlap") < fr.SOFT_OVERLAP)
    hard_type = ~c("_match") & c("_kind").isin(*fr.HARD_TYPES) & ~normed
    unsure = (c("_conf") < 0.35) & ~normed
    missing = lambda n: F.array_contains("_whole.missing", n)
    grounded_drop, whole_drop = (grounding == "HARD_FAIL") & ~(normed & (c("_conf") >= 0.75)), (whole == "HARD_FAIL") & ~(normed & (c("_conf") >= 0.8))
    drop = [
        (c("_short"), "TOO_SHORT"),
        ((F.size("_told") > 0) & ~normed, "DESCRIPTIVE_WITHOUT_NORMATIVE_MARKER"),
        (c("_signs") & (c("_src_signs") | (c("_overlap") < 0.58)), "OCR_ARTIFACT_IN_REQUIREMENT"),
        (ocr_drop, "OCR_HEAVY_DEGRADATION_DROP"),
    ]
    # statuses that a check turns to TO_VALIDATE; only the first such check names itself where the others look at the status
    steps: list[tuple[Column, Column, bool, str]] = []  # condition, reason, drops, how it validates: "", "once" or "quiet"

    def step(condition: Column, reason: Column | str, drops: bool = False, validates: str = "") -> None:
        steps.append((condition, F.lit(reason) if isinstance(reason, str) else reason, drops, validates))

    for condition, reason in drop:
        step(condition, reason, True)
    step(~ocr_drop & ((c("_share") >= 0.12) | (c("_src_share") >= 0.12)), "OCR_DEGRADATION_VALIDATE", validates="once")
    for name in ("_out", "_mixed", "_blend"):
        step(c(name).isNotNull(), c(name), True)
    step(hard_low, "LOW_SNIPPET_OVERLAP_HARD", True)
    step(~hard_low & soft_low, "LOW_SNIPPET_OVERLAP_SOFT", validates="quiet")
    step(~c("_match"), "TYPE_TEXT_MISMATCH", validates="")
    step(hard_type, "TYPE_MISMATCH_HARD_DROP", True)
    step(~c("_match") & ~hard_type, F.lit(None).cast("string"), validates="quiet")
    step(unsure, "LOW_CONFIDENCE_NON_NORMATIVE", True)
    step(~unsure & (c("_conf") < 0.55), "LOW_CONFIDENCE_SOFT", validates="once")
    step(cited & F.array_contains("_ground.reasons", "GROUNDING_SNIPPET_NOT_IN_CHUNK"), "SNIPPET_NOT_IN_CHUNK", validates="quiet")
    for reason in ("GROUNDING_SNIPPET_EMPTY", "GROUNDING_SNIPPET_NOT_IN_CHUNK", "GROUNDING_SCORE_HARD_FAIL", "GROUNDING_SCORE_SOFT_FAIL"):
        step(F.array_contains("_ground.reasons", reason), reason)
    step((grounding == "HARD_FAIL") & ~grounded_drop, "GROUNDING_HARD_FAIL_ESCALATE_VALIDATE", validates="quiet")
    step(grounded_drop, "GROUNDING_HARD_FAIL_DROP", True)
    step(grounding == "SOFT_FAIL", "GROUNDING_SOFT_FAIL_VALIDATE", validates="once")
    for n, _ in fr.MISSING:
        step(missing(n), fr.MISSING_REASONS[n])
    step(missing("OBJECT"), "COMPLETENESS_MISSING_OBJECT_DROP", True)
    step(missing("TAIL"), "COMPLETENESS_DANGLING_TAIL_DROP", True)
    step((whole == "HARD_FAIL") & ~whole_drop, "COMPLETENESS_HARD_FAIL_ESCALATE_VALIDATE", validates="quiet")
    step(whole_drop, "COMPLETENESS_HARD_FAIL_DROP", True)
    step(whole == "SOFT_FAIL", "COMPLETENESS_SOFT_FAIL_VALIDATE", validates="once")

    # the first step that validates, by place: a later "once" step says nothing
    x = x.withColumns({f"_step_{i}": cond for i, (cond, *_) in enumerate(steps)})
    steps = [(c(f"_step_{i}"), *rest) for i, (_, *rest) in enumerate(steps)]
    turns = F.array(*[F.when(cond, F.lit(i)) for i, (cond, _, _, v) in enumerate(steps) if v])
    x = x.withColumn("_turn", F.when(c("_status") == "TO_VALIDATE", -1).otherwise(F.array_min(turns)))
    said = [F.when(cond & ((c("_turn") == i) if v == "once" else F.lit(True)), reason) for i, (cond, reason, _, v) in enumerate(steps)]
    dropped = F.lit(False)
    for cond, _, drops, _ in steps:
        dropped = dropped | (cond if drops else F.lit(False))
    raw = 0.22 * tx.clip01(c("_conf")) + 0.30 * tx.clip01(c("_ground.score")) + 0.18 * c("_match").cast("double") + 0.18 * tx.clip01(c("_whole.score")) + 0.12 * tx.clip01(c("_subject"))
    over = c("_strength").isin("IMPERATIF", "") & c("_optional")
    penalty = F.when((c("_strength") == "FACULTATIF") & c("_kind").isin(*fr.IMPERATIVE_TYPES), fr.INCOHERENT).otherwise(0.0) + F.when(over, fr.OVERQUALIFIED).otherwise(0.0)
    x = x.withColumns({"_dropped": dropped, "_said": F.array_compact(F.array(*said)), "_over": over & (c("_turn").isNotNull() | ~c("_status").isin("REJECT", "DROP")), "_quality": F.round(tx.clip01(F.round(raw, 4) - penalty), 4)})
    x = x.withColumn("_validate", c("_turn").isNotNull() | c("_over"))
    x = x.withColumn("_level", F.when(c("_quality") >= 0.78, "DRAFT").when(c("_quality") >= 0.50, "TO_VALIDATE").otherwise("REJECT"))
    level = c("_level")
    weak = (grounding == "HARD_FAIL") | (c("_ground.score") < 0.28)
    blocked = (level == "DRAFT") & (missing("EXCEPTION") | weak)
    status = (
        F.when(c("_dropped") | (level == "REJECT"), "REJECT")
        .when(c("_validate") | (level == "TO_VALIDATE") | (c("_status") == "TO_VALIDATE"), "TO_VALIDATE")
        .when(blocked & (c("_status") != "REJECT"), "TO_VALIDATE")
        .when(c("_status") == "REJECT", "REJECT")
        .otherwise("DRAFT")
    )
    later = ca.named(
        [
            (c("_over"), "NORMATIVE_STRENGTH_SUSPECTED_OVERQUALIFIED"),
            (~c("_dropped") & (level == "REJECT"), "QUALITY_THRESHOLD_REJECT"),
            (~c("_dropped") & (level == "TO_VALIDATE"), "QUALITY_THRESHOLD_VALIDATE"),
            (~c("_dropped") & blocked, "QUALITY_DRAFT_BLOCKED_RISK_SIGNAL"),
            (~c("_dropped") & blocked & missing("EXCEPTION"), "QUALITY_DRAFT_BLOCKED_MISSING_EXCEPTION"),
            (~c("_dropped") & blocked & weak, "QUALITY_DRAFT_BLOCKED_GROUNDING_WEAK"),
        ]
    )
    gone = c("_dropped") | (level == "REJECT")
    x = x.withColumn("_final", status)
    risk = ca.risk([(gone, 0.5), (c("_final") == "TO_VALIDATE", 0.25), (~c("_match"), 0.15), (c("_overlap") < fr.SOFT_OVERLAP, 0.1), (grounding == "HARD_FAIL", 0.15), (grounding == "SOFT_FAIL", 0.08), (whole == "HARD_FAIL", 0.12), (whole == "SOFT_FAIL", 0.06), (missing("GRANULARITY"), 0.06)])
    a = F.struct(
        F.when(gone, "DROP").otherwise("KEEP").alias("decision"),
        c("_final").alias("status"),
        F.when(gone, "REJECT").when(blocked, "TO_VALIDATE").otherwise(level).alias("quality_decision"),
        c("_quality").alias("quality"),
        risk.alias("risk"),
        c("_overlap").alias("overlap"),
        c("_match").alias("type_match"),
        c("_ground.score").alias("grounding"),
        grounding.alias("grounding_verdict"),
        c("_whole.score").alias("completeness"),
        whole.alias("completeness_verdict"),
        c("_whole.missing").alias("missing"),
        c("_subject").alias("subject"),
        (c("_dropped") & F.exists("_said", lambda r: r.isin(*fr.CONTROLLED))).alias("controlled_reject"),
        F.concat("_said", later).alias("reasons"),
    )
    return x.select(*[F.col(f"`{n}`") for n in names], a.alias("a"))


def with_wording(df: DataFrame) -> DataFrame:
    """Add ``wording``: what ``promotion`` reads from ``requirement, snippet``; statements that differ in nothing else can share it."""
    c = F.col
    names = df.columns
    df = df.withColumns({"_req": F.trim(F.coalesce("requirement", F.lit(""))), "_src": F.trim(F.coalesce("snippet", F.lit("")))})
    df = df.withColumns({"_low": plain("_req"), "_own": sim.tokens("_req"), "_theirs": sim.tokens("_src")})
    req, src, low, own = c("_req"), c("_src"), c("_low"), c("_own")
    begins = lambda prefixes: F.array_contains(F.array(*[F.startswith(low, F.lit(p)) for p in prefixes]), True)
    wording = F.struct(
        F.length(req).alias("chars"),
        F.size(F.filter(F.split(tx.spaces(req), " "), lambda w: w != "")).alias("words"),
        (begins(fr.SUBJECT_PREFIXES) | (~begins(fr.NO_SUBJECT_PREFIXES) & low.rlike(fr.GENERIC_SUBJECT) & any_of(low, fr.SUBJECT_NORMS))).alias("subject"),
        any_of(low, fr.PROMOTION_VERBS).alias("verb"),
        F.length(src).alias("cited"),
        (low.rlike(r"\bpeu(?:t|vent)\b") & ~any_of(low, fr.MODAL_COMPANIONS)).alias("modal"),
        (((req != "") & ~req.rlike(r"^\p{Lu}")) | low.rlike(r"^\s*article\s+\d+\s*\(nouveau\)")).alias("noisy"),
        F.when(F.size(own) > 0, F.size(F.array_intersect(own, c("_theirs"))) / F.size(own)).otherwise(0.0).alias("shared"),
    )
    return df.select(*[F.col(f"`{n}`") for n in names], wording.alias("wording"))


def promotion(df: DataFrame, confidence: float = 0.89, overlap: float = 0.16, snippet: tuple[int, int] = (60, 650), chars: int = 320, quality: float = 0.84, grounding: float = 0.72, completeness: float = 0.85, subject: float = 0.60) -> DataFrame:
    """PR1: rows of ``assess`` with ``policy``, ``memory_action`` and ``memory_family``: adds ``p struct<status, reason>``, the first blocker's reason.

    Blockers look at the status, the article's policy, the type, the wording
    (length, legal subject, normative verb), confidence, citation, start, the
    assessment, and what the error memory asks for.
    """
    c = F.col
    names = [n for n in df.columns if n != "wording"]
    df = df if "wording" in df.columns else with_wording(df)
    w = lambda n: c(f"wording.{n}")
    conf = F.coalesce(c("confidence").cast("double"), F.lit(0.0))
    a, missing = (lambda n: c(f"a.{n}")), (lambda n: F.array_contains("a.missing", n))
    shared = F.greatest(w("shared"), a("overlap"))
    recovered = (
        (F.upper("memory_family") == "WEAK_GROUNDING")
        & (conf >= max(confidence, 0.85))
        & (a("grounding") >= max(grounding, 0.82))
        & (a("completeness") >= max(completeness, 0.90))
        & (a("subject") >= max(subject, 0.75))
        & (a("quality") >= max(quality, 0.88))
        & (a("quality_decision") == "DRAFT")
        & (shared >= max(overlap, 0.60))
    )
    blockers = [
        (a("status") != "TO_VALIDATE", "NOT_TO_VALIDATE"),
        (F.coalesce(F.upper("policy"), F.lit("")) != "EXTRACT_FULL", "POLICY_NOT_FULL"),
        (~F.coalesce(F.upper("kind"), F.lit("")).isin(*fr.PROMOTED_TYPES), "TYPE_NOT_ALLOWED"),
        (w("chars") > chars, "REQUIREMENT_TOO_LONG"),
        (w("words") < 6, "TEXT_TOO_SHORT"),
        (w("words") > 120, "TEXT_TOO_LONG_WORDS"),
        (~w("subject"), "NO_LEGAL_SUBJECT"),
        (~w("verb"), "NO_NORMATIVE_VERB"),
        (conf < confidence, "LOW_CONFIDENCE"),
        (w("cited") < snippet[0], "SHORT_SNIPPET"),
        (w("cited") > snippet[1], "SNIPPET_TOO_LONG"),
        (w("modal"), "MODAL_PEUT"),
        (w("noisy"), "NOISY_START"),
        (missing("GRANULARITY"), "FUSED_ACTION_CHAIN"),
        (missing("CONDITION") | missing("EXCEPTION") | missing("SCOPE") | missing("TAIL"), "MISSING_COMPONENT"),
        ((a("grounding_verdict") != "PASS") | (a("grounding") < grounding), "GROUNDING_TOO_WEAK"),
        ((a("completeness_verdict") != "PASS") | (a("completeness") < completeness), "COMPLETENESS_NOT_PASS"),
        (~a("type_match"), "TYPE_MISMATCH_POSTCALL"),
        (a("subject") < subject, "SUBJECT_INCONSISTENT"),
        (a("quality") < quality, "QUALITY_TOO_LOW"),
        (a("quality_decision") != "DRAFT", "POSTCALL_NOT_DRAFT"),
        (shared < overlap, "LOW_OVERLAP"),
        ((F.coalesce(F.upper("memory_action"), F.lit("")) == "FORCE_VALIDATE") & ~F.coalesce(recovered, F.lit(False)), "ERROR_MEMORY_HIT"),
    ]
    reason = ca.first_match([(cond, F.lit(n)) for cond, n in blockers], F.lit("PROMOTED_STRONG_SIGNAL"))
    return df.withColumn("_reason", reason).withColumn("p", F.struct(F.when(F.col("_reason") == "PROMOTED_STRONG_SIGNAL", "DRAFT").otherwise(a("status")).alias("status"), F.col("_reason").alias("reason"))).select(*[F.col(f"`{n}`") for n in names], "p")


def _first_at(text: Column, markers: tuple[str, ...]) -> Column:
    """Place (from 0) in a text where the first marker stands, -1 if none does; markers begin and end with blanks, as do texts."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    places = F.array(*[F.nullif(F.locate(m, padded), F.lit(0)) for m in markers])
    first = F.array_min(places)
    return F.when(first.isNull(), -1).otherwise(F.greatest(first - 2, F.lit(0)))


def with_structure(df: DataFrame, requirement: str) -> DataFrame:
    """RV1: add ``_s struct<subject, verb, object, condition, exception, words>`` of a requirement, from its first normative verb on; step by step, a column each."""
    c = F.col
    edge = lambda x: F.btrim(x, F.lit(" ,:;-"))
    cut = lambda x, a: F.substring(x, a + 1, F.length(x))
    head = lambda x, n: F.substring(x, F.lit(1), n)
    names = df.columns
    x = df.withColumn("_raw", tx.spaces(requirement)).withColumn("_low", F.lower("_raw"))
    # the verb that begins first; of those that begin together, the earlier in the list
    verbs = [F.when(c("_low").rlike(p), F.struct(F.length(F.regexp_extract("_low", f"(?s)^(.*?){p}", 1)).alias("at"), F.lit(i).alias("i"), F.length(F.regexp_extract("_low", p, 1)).alias("n"))) for i, (p, _) in enumerate(fr.REVIEW_VERBS)]
    x = x.withColumn("_verb", F.array_min(F.array(*verbs)))
    x = x.withColumn("_rest", F.when(c("_verb").isNull(), "").otherwise(edge(cut(c("_raw"), c("_verb.at") + c("_verb.n")))))
    x = x.withColumns({"_rc": _first_at(c("_rest"), fr.REVIEW_CONDITIONS), "_re": _first_at(c("_rest"), fr.REVIEW_EXCEPTIONS)})
    x = x.withColumn("_split", F.array_min(F.filter(F.array("_rc", "_re"), lambda p: p >= 0)))
    x = x.withColumn("_tail", F.when(c("_split").isNotNull(), F.trim(cut(c("_rest"), c("_split")))).otherwise(""))
    x = x.withColumns({"_tc": _first_at(c("_tail"), fr.REVIEW_CONDITIONS), "_te": _first_at(c("_tail"), fr.REVIEW_EXCEPTIONS)})
    x = x.withColumns({"_ne": _first_at(cut(c("_tail"), c("_tc") + 1), fr.REVIEW_EXCEPTIONS), "_nc": _first_at(cut(c("_tail"), c("_te") + 1), fr.REVIEW_CONDITIONS)})
    tail, tc, te, ne, nc = (c(f"_{n}") for n in ("tail", "tc", "te", "ne", "nc"))
    leads = (tc >= 0) & ((te == -1) | (tc <= te))
    condition = F.when(leads, F.when(ne >= 0, edge(head(tail, tc + 1 + ne))).otherwise(edge(tail))).when((te >= 0) & (nc >= 0), edge(cut(tail, te + 1 + nc))).otherwise("")
    exception = F.when(leads, F.when(ne >= 0, edge(cut(tail, tc + 1 + ne))).otherwise("")).when(te >= 0, F.when(nc >= 0, edge(head(tail, te + 1 + nc))).otherwise(edge(tail))).otherwise("")
    obj = F.when(c("_verb").isNull(), c("_raw")).when(c("_split").isNotNull(), edge(head(c("_rest"), c("_split")))).otherwise(F.coalesce(F.nullif("_rest", F.lit("")), c("_raw")))
    words = F.when(c("_raw") == "", 0).otherwise(F.size(F.split("_raw", " ")))
    verb = F.when(c("_verb").isNull(), "").otherwise(F.element_at(F.array(*[F.lit(v) for _, v in fr.REVIEW_VERBS]), c("_verb.i") + 1))
    s = F.struct(F.when(c("_verb").isNull(), "").otherwise(edge(head(c("_raw"), c("_verb.at")))).alias("subject"), verb.alias("verb"), obj.alias("object"), condition.alias("condition"), exception.alias("exception"), words.alias("words"))
    return x.select(*[F.col(f"`{n}`") for n in names], s.alias("_s"))


def review(df: DataFrame) -> DataFrame:
    """RV1: rows with ``requirement, snippet, blocked_reason, similarity`` (of the nearest statement in the register): adds ``v`` with structure, source mode, guidance and the recommended decision."""
    x = with_structure(df, "requirement").withColumn("_like", F.round(grouping.char_ratio("requirement", "snippet"), 2))
    c, s = F.col, (lambda n: F.col(f"_s.{n}"))
    blocked, near = F.upper(F.trim(F.coalesce("blocked_reason", F.lit("")))), F.coalesce("similarity", F.lit(0.0))
    mode = F.when(tx.spaces("snippet") == "", "NON_PRECISE").when(c("_like") >= 0.92, "VERBATIM").when(c("_like") >= 0.68, "REFORMULE_LEGERE").otherwise("RECONSTRUCTION_CONTROLEE")
    hints = ca.named([(blocked != "", "BLOCKED"), (s("subject") == "", "NO_SUBJECT"), (s("verb") == "", "NO_VERB"), (s("words") > 45, "LONG_TEXT"), (c("similarity").isNotNull() & (near < 0.9), "SIMILAR_INFO"), (c("similarity").isNotNull() & (near >= 0.9), "SIMILAR_WARNING")])
    decision = F.when(near >= 0.95, "FLAG").when(blocked.isin(*fr.EDIT_REASONS) | (s("subject") == "") | (s("verb") == "") | (s("words") > 45), "EDIT").otherwise("APPROVE")
    v = F.struct("_s.*", mode.alias("source_mode"), F.when(F.size(hints) > 0, hints).otherwise(F.array(F.lit("QUICK_REVIEW"))).alias("guidance"), decision.alias("decision"))
    return x.withColumn("v", v).drop("_s", "_like")
