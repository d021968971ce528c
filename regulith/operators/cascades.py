"""Rule cascades as Column expressions: the first rule that holds decides, weighted rules add up.

Every cascade returns a struct, so that the branch taken can be seen. Patterns
and weights come from a lexicon (``regulith.rules``), thresholds are parameters.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNICODE, clip01, spaces
from ..rules import fr


def hit(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(UNICODE + pattern))


def first_match(rules: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that is true."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return otherwise if out is None else out.otherwise(otherwise)


def total(parts: Iterable[tuple[Column, float]]) -> Column:
    """Sum of the weights whose condition holds, in order."""
    out = F.lit(0.0)
    for cond, w in parts:
        out = out + F.when(cond, w).otherwise(0.0)
    return out


def named(parts: Iterable[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, n) for c, n in parts]))


# --- documents and units ------------------------------------------------------


def _decision(policy: str, kind: str, confidence: float, *reasons: str) -> Column:
    return F.struct(F.lit(policy).alias("policy"), F.lit(kind).alias("document_type"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, reasons)).alias("reasons"))


def _plain(x: Column) -> Column:
    return F.lower(spaces(F.replace(F.translate(x, "’–—_", "'-- "), F.lit("Â°"), F.lit("°"))))


def document_gate(title: Column, preview: Column, articles: Column, lex: ModuleType = fr) -> Column:
    """DG1: policy of a document; the first of ten rules that matches."""
    title = _plain(title)
    both = spaces(F.concat_ws(" ", title, _plain(preview)))
    return _document_rules(title, both, articles, hits(both, lex.INDIVIDUAL), hits(both, lex.NORMATIVE_CORE), lex)


def with_document_gate(df: DataFrame, title: Column, preview: Column, articles: Column, out: str = "g", lex: ModuleType = fr) -> DataFrame:
    """DG1: add ``document_gate``. What several rules read is a column of its own, so that it is made once for each document."""
    names = [F.col(f"`{n}`") for n in df.columns]
    x = df.withColumns({"_title": _plain(title), "_preview": _plain(preview), "_articles": articles})
    x = x.select(*names, "_title", "_articles", spaces(F.concat_ws(" ", "_title", "_preview")).alias("_both"))
    x = x.withColumns({"_acts": hits(F.col("_both"), lex.INDIVIDUAL), "_norms": hits(F.col("_both"), lex.NORMATIVE_CORE)})
    return x.select(*names, _document_rules(*map(F.col, ("_title", "_both", "_articles", "_acts", "_norms")), lex).alias(out))


def _document_rules(title: Column, both: Column, articles: Column, acts: Column, norms: Column, lex: ModuleType) -> Column:
    people, bodies = hits(both, lex.NAMED_PERSON), hits(both, lex.INSTITUTIONAL)
    return first_match(
        [
            (hit(both, lex.SUMMARY_NOTICE), _decision("DROP", "SUMMARY_NOTICE", 0.99, "DOC_SUMMARY_NOTICE")),
            (hit(both, lex.ARABIC_ONLY), _decision("TO_VALIDATE_SOURCE_MISSING", "SOURCE_MISSING", 0.99, "DOC_SOURCE_ARABIC_ONLY")),
            (hit(title, lex.STRONG_TITLE), _decision("EXTRACT_FULL", "REGULATORY_ACT", 0.93, "DOC_STRONG_REGULATORY_TITLE")),
            ((articles >= 20) & (norms >= 2), _decision("EXTRACT_FULL", "REGULATORY_ACT", 0.82, "DOC_LONG_NORMATIVE_ACT")),
            ((acts >= 1) & (people >= 1) & (norms <= 1) & (bodies == 0), _decision("DROP", "INDIVIDUAL_ACT", 0.92, "DOC_INDIVIDUAL_ACT", "DOC_NAMED_PERSON")),
            ((acts >= 2) & (norms == 0) & (bodies == 0), _decision("DROP", "INDIVIDUAL_ACT", 0.88, "DOC_INDIVIDUAL_ACT")),
            (hit(both, lex.ANNEX_DATA) & (norms <= 1) & (articles <= 10), _decision("EXTRACT_LIMITED_DATA", "ANNEX_DATA", 0.84, "DOC_ANNEX_TABLE_DATA")),
            (hit(both, lex.REGULATORY_TITLE), _decision("EXTRACT_FULL", "REGULATORY_ACT", 0.86, "DOC_REGULATORY_TITLE")),
            (hit(both, lex.CONCOURS), _decision("EXTRACT_LIMITED", "PROCEDURAL_ACT", 0.74, "DOC_CONCOURS_PROCEDURAL")),
            (hit(both, lex.COMMISSION), _decision("EXTRACT_LIMITED", "GOVERNANCE_ACT", 0.71, "DOC_COMMISSION_GOVERNANCE")),
            ((articles > 0) & (norms > 0), _decision("EXTRACT_FULL", "REGULATORY_ACT", 0.68, "DOC_DEFAULT_NORMATIVE")),
        ],
        _decision("EXTRACT_FULL", "UNKNOWN", 0.56, "DOC_DEFAULT_CONSERVATIVE"),
    )


def article_gate(title: Column, label: Column, text: Column, document_policy: Column, lex: ModuleType = fr) -> Column:
    """DG2: policy of an article, by its title, label, first 2400 characters, and what its document inherits."""
    label, body = _plain(label), _plain(text)
    preview = F.substring(body, 1, 2400)
    both = spaces(F.concat_ws(" ", _plain(title), label, preview))
    people, acts, norms, bodies = hits(both, lex.NAMED_PERSON), hits(both, lex.INDIVIDUAL), hits(both, lex.NORMATIVE_CORE), hits(both, lex.INSTITUTIONAL)
    strong_norms = hits(both, lex.STRONG_NORMATIVE_ARTICLE)
    personal, standard = hit(both, lex.STRONG_INDIVIDUAL), hit(label, lex.STANDARD_LABEL)
    annex, contest, board = hit(both, lex.ANNEX_DATA), hit(both, lex.CONCOURS), hit(both, lex.COMMISSION)
    policy = F.upper(F.trim(F.coalesce(document_policy, F.lit(""))))
    d = _decision
    return first_match(
        [
            (hit(both, lex.SUMMARY_NOTICE) | hit(label, lex.SUMMARY_LABEL), d("DROP", "SUMMARY_NOTICE", 0.99, "ARTICLE_SUMMARY_NOTICE")),
            (text.rlike(UNICODE + lex.SUMMARY_LAYOUT) & (norms == 0), d("DROP", "SUMMARY_NOTICE", 0.97, "ARTICLE_SUMMARY_NOTICE")),
            (hit(both, lex.ARABIC_ONLY), d("TO_VALIDATE_SOURCE_MISSING", "SOURCE_MISSING", 0.99, "ARTICLE_SOURCE_ARABIC_ONLY")),
            (hit(both, lex.META_SCOPE) & (norms == 0) & (strong_norms == 0), d("DROP", "META_SCOPE_ARTICLE", 0.9, "ARTICLE_META_SCOPE_ONLY")),
            ((people >= 1) & personal & (bodies == 0), d("DROP", "INDIVIDUAL_ACT", 0.96, "ARTICLE_INDIVIDUAL_ACT", "ARTICLE_NAMED_PERSON")),
            (personal & (norms <= 1) & (bodies == 0), d("DROP", "INDIVIDUAL_ACT", 0.92, "ARTICLE_INDIVIDUAL_ACT")),
            ((acts >= 1) & (people >= 1) & (norms <= 2) & (bodies == 0), d("DROP", "INDIVIDUAL_ACT", 0.95, "ARTICLE_INDIVIDUAL_ACT", "ARTICLE_NAMED_PERSON")),
            ((acts >= 2) & (norms == 0) & (bodies == 0), d("DROP", "INDIVIDUAL_ACT", 0.9, "ARTICLE_INDIVIDUAL_ACT")),
            (annex & (norms == 0), d("EXTRACT_LIMITED_DATA", "ANNEX_DATA", 0.87, "ARTICLE_ANNEX_TABLE_DATA")),
            (annex & standard & ((strong_norms >= 1) | (norms >= 2) | (bodies >= 1)), d("EXTRACT_FULL", "NORMATIVE_ARTICLE", 0.76, "ARTICLE_ANNEX_NORMATIVE_OVERRIDE")),
            (annex, d("EXTRACT_LIMITED", "ANNEX_DATA_MIXED", 0.72, "ARTICLE_ANNEX_MIXED_NORMATIVE")),
            (contest & (norms >= 2), d("EXTRACT_FULL", "NORMATIVE_ARTICLE", 0.73, "ARTICLE_CONCOURS_NORMATIVE")),
            (contest, d("EXTRACT_LIMITED", "PROCEDURAL_ACT", 0.7, "ARTICLE_CONCOURS_PROCEDURAL")),
            (board & (norms == 0), d("EXTRACT_LIMITED", "GOVERNANCE_ACT", 0.72, "ARTICLE_COMMISSION_GOVERNANCE")),
            (board, d("EXTRACT_FULL", "NORMATIVE_ARTICLE", 0.71, "ARTICLE_COMMISSION_NORMATIVE")),
            (norms > 0, d("EXTRACT_FULL", "NORMATIVE_ARTICLE", 0.74, "ARTICLE_NORMATIVE")),
            ((policy == "EXTRACT_LIMITED") & (F.length(preview) >= 700), d("EXTRACT_FULL", "SOFT_FULL_ARTICLE", 0.59, "ARTICLE_INHERIT_DOC_LIMITED_SOFT")),
            (policy == "EXTRACT_LIMITED", d("EXTRACT_LIMITED", "PROCEDURAL_ACT", 0.61, "ARTICLE_INHERIT_DOC_LIMITED")),
            (policy == "EXTRACT_LIMITED_DATA", d("EXTRACT_LIMITED_DATA", "ANNEX_DATA", 0.61, "ARTICLE_INHERIT_DOC_DATA")),
        ],
        d("EXTRACT_FULL", "UNKNOWN", 0.55, "ARTICLE_DEFAULT_FULL"),
    )


def limited_actionable(text: Column, lex: ModuleType = fr) -> Column:
    """DG3: whether a unit of a limited document is worth extraction."""
    return hit(text, lex.NORMATIVE_CORE) | hit(text, lex.LIMITED_ACTIONABLE) | (text.contains(":") & text.rlike(r"(?m)^\s*(?:[-*•]|[a-z]\)|\d+[).])\s+"))


def limited_status(policy: Column, status: Column) -> Column:
    return F.when(policy.startswith("EXTRACT_LIMITED") & (status == "DRAFT"), "TO_VALIDATE").otherwise(status)


def classify_units(df: DataFrame, text: str = "text", out: str = "unit", label: Column | None = None, source: Column | None = None, lex: ModuleType = fr, high: float = 0.68, low: float = 0.32) -> DataFrame:
    """UN2: add the unit's class. The patterns are matched once, in a column of their own, and the rules read that."""
    lower = F.lower(text)
    df = df.withColumn("_norm", F.array(*[hit(lower, p) for _, p, _ in lex.NORMATIVE])).withColumn("_desc", F.array(*[hit(lower, p) for _, p, _ in lex.DESCRIPTIVE]))
    return df.withColumn(out, unit_class(F.col(text), label, source, lex, high, low, F.col("_norm"), F.col("_desc"))).drop("_norm", "_desc")


def unit_class(text: Column, label: Column | None, source: Column | None, lex: ModuleType, high: float, low: float, norm_hits: Column, desc_hits: Column) -> Column:
    """MA1: priority of a unit from the sigmoid of normative less descriptive weights, with safeguards for strong and for mixed units."""
    label, source = label if label is not None else F.lit(None).cast("string"), source if source is not None else F.lit(None).cast("string")
    norm = [(norm_hits[i], n, w) for i, (n, _, w) in enumerate(lex.NORMATIVE)]
    desc = [(desc_hits[i], n, w) for i, (n, _, w) in enumerate(lex.DESCRIPTIVE)]
    strong = F.lit(False)
    for c, n, _ in norm:
        if n in lex.STRONG_NORMATIVE:
            strong = strong | c
    odd = F.coalesce(hit(F.lower(label), r"\b(?:" + "|".join(fr.NON_ARTICLE_LABELS) + r")\b"), F.lit(False))
    lists, sentences, colon = F.coalesce(source == "list_block", F.lit(False)), F.coalesce(source == "sentence_split", F.lit(False)), text.contains(":") & text.contains(";")
    up = total([*((c, w) for c, _, w in norm), (lists, 0.35), (sentences, 0.1), (colon, 0.1)])
    down = total([*((c, w) for c, _, w in desc), (odd, 0.9), (odd & ~strong, 0.45)])
    score = F.round(1 / (1 + F.exp(-(up - down))), 4)
    base = first_match([((down > 0) & (up <= 0) & (score < low), F.lit("DROP")), (strong & (score >= low - 0.05), F.lit("HIGH")), (score >= high, F.lit("HIGH")), (score >= low, F.lit("LOW"))], F.lit("DROP"))
    effect = F.lit(False)
    for c, n, _ in norm:
        effect = effect | c if n == "EFFECT_LEGAL" else effect
    mixed = F.lit(False)
    for c, n, _ in desc:
        mixed = mixed | c if n in lex.MIXED_DESCRIPTIVE else mixed
    saved = (base == "DROP") & effect & mixed & ((score >= max(0.0, low - 0.08)) | (up >= 0.9))
    priority = F.when(saved, "LOW").otherwise(base)
    empty = F.trim(text) == ""
    return F.struct(
        F.when(empty, "DROP").otherwise(priority).alias("priority"),
        F.when(empty, 0.0).otherwise(score).alias("score"),
        F.when(empty | (priority == "DROP"), "DESCRIPTIVE_OR_NOISE").when(priority == "HIGH", "NORMATIVE_STRONG").otherwise("NORMATIVE_AMBIGUOUS").alias("label"),
        (strong & ~empty).alias("strong"),
        F.when(empty, F.array(F.lit("EMPTY_UNIT"))).otherwise(named([*((c, f"NORM:{n}") for c, n, _ in norm), *((c, f"DESC:{n}") for c, n, _ in desc), (lists, "CTX:LIST_BLOCK"), (sentences, "CTX:SENTENCE_SPLIT"), (colon, "CTX:COLON_SEMICOLON"), (odd, "CTX:NON_ARTICLE_LABEL"), (saved, "SAFEGUARD:MIXED_NORMATIVE_NEAR_LOW")])).alias("rules"),
    )


def skip_unit(mode: str, priority: Column, risky: Column) -> Column:
    """UN3: what a gate mode does with a unit; a risky unit is never skipped."""
    drop = {"OFF": F.lit(False), "SHADOW": F.lit(False), "CONSERVATIVE": priority == "DROP", "AGGRESSIVE": priority != "HIGH"}[mode]
    return first_match([(risky, F.lit("KEEP_RISK"))], F.when(drop, "SKIP").otherwise(F.lit("SHADOW_SKIP" if mode == "SHADOW" else "KEEP") if mode != "SHADOW" else F.when(priority == "DROP", "SHADOW_SKIP").otherwise("KEEP")))


# --- requirements -------------------------------------------------------------


def confidence(parts: Sequence[tuple[Column, float]], base: float = 0.58) -> Column:
    """CF1: base and signed adjustments, clipped to [0.20, 0.97], two places."""
    return F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.20), F.lit(base) + total(parts))), 2)


def status_of(conf: Column, guards: Sequence[Column], draft: float = 0.86) -> Column:
    """CF2: any guard sends to validation; otherwise the confidence decides."""
    return first_match([*((g, F.lit("TO_VALIDATE")) for g in guards), (conf >= draft, F.lit("DRAFT"))], F.lit("TO_VALIDATE"))


def completeness(missing: dict[str, Column], fused: Column) -> Column:
    """GR2: 1 less what is missing; none, one, or more missing parts are PASS, SOFT, HARD."""
    weights = {"condition": 0.35, "exception": 0.35, "scope": 0.30, "object": 0.42, "tail": 0.45}
    n = F.lit(0)
    for c in missing.values():
        n = n + F.when(c, 1).otherwise(0)
    score = F.round(clip01(1 - total([(c, weights[k]) for k, c in missing.items()] + [(fused, 0.22)])), 4)
    return F.struct(score.alias("score"), F.when(n == 0, "PASS").when(n == 1, "SOFT").otherwise("HARD").alias("decision"))


def grounding_class(score: Column) -> Column:
    return F.when(score >= 0.48, "PASS").when(score >= 0.28, "SOFT").otherwise("FAIL")


def quality(conf: Column, grounding: Column, kind: Column, complete: Column, subject: Column, penalty: Column) -> Column:
    """GR4: weighted score less penalties; 0.78 and 0.50 are the limits."""
    s = F.round(clip01(0.22 * conf + 0.30 * grounding + 0.18 * kind + 0.18 * complete + 0.12 * subject - penalty), 4)
    return F.struct(s.alias("score"), F.when(s >= 0.78, "DRAFT").when(s >= 0.50, "TO_VALIDATE").otherwise("REJECT").alias("decision"))


def risk(parts: Sequence[tuple[Column, float]]) -> Column:
    """GR5: additive, at most 1."""
    return F.round(F.least(F.lit(1.0), total(parts)), 4)


PROMOTABLE = ("OBLIGATION", "INTERDICTION", "CONDITION", "EXCEPTION", "DECLARATION", "REGISTRE")


def promotion(status: Column, kind: Column, blockers: Sequence[tuple[Column, str]]) -> Column:
    """PR1: the first blocker's reason code keeps a requirement from promotion; only six types are promoted at all."""
    reason = first_match([(~kind.isin(*PROMOTABLE), F.lit("TYPE_NOT_ALLOWED")), *((c, F.lit(n)) for c, n in blockers)], F.lit("PROMOTED"))
    return F.struct(F.when(reason == "PROMOTED", "DRAFT").otherwise(status).alias("status"), reason.alias("reason"))


# --- error memory -------------------------------------------------------------


def trigger_keys(kind: Column, text: Column) -> Column:
    """EM1: exact key and signature of the first three words."""
    t = F.lower(spaces(text))
    return F.struct(F.concat_ws("|", kind, F.substring(t, 1, 220)).alias("exact"), F.concat_ws("|", kind, F.array_join(F.slice(F.split(t, " "), 1, 3), " ")).alias("signature"))


def error_family(reasons: Column, table: Sequence[tuple[str, str, str, str]]) -> Column:
    """EM2: family, action and severity of the first row of the table whose code is a part of any reason."""
    holds = lambda part: lambda r: r.contains(part)
    return first_match([(F.exists(reasons, holds(part)), F.struct(F.lit(a).alias("family"), F.lit(b).alias("action"), F.lit(c).alias("severity"))) for part, a, b, c in table], F.struct(F.lit("OTHER").alias("family"), F.lit("FORCE_VALIDATE").alias("action"), F.lit("LOW").alias("severity")))


def feedback(decision: Column) -> Column:
    """EM4: edits and rejections are of high severity, flags of medium; approvals give no signal."""
    return F.when(decision.isin("EDIT", "REJECT"), F.struct(F.lit("FORCE_VALIDATE").alias("action"), F.lit("HIGH").alias("severity"))).when(decision == "FLAG", F.struct(F.lit("FORCE_VALIDATE").alias("action"), F.lit("MEDIUM").alias("severity")))


# --- applicability and compliance ---------------------------------------------


def headcount_rule(low: Column, high: Column, headcount: Column) -> Column:
    """RU1, first rule: a headcount limit decides at once."""
    s = lambda v, c, r: F.struct(F.lit(v).alias("status"), F.lit(c).alias("confidence"), F.lit(r).alias("rule"))
    return first_match([((headcount < low), s("NON_APPLICABLE", 0.96, "HEADCOUNT_MIN")), ((headcount > high), s("NON_APPLICABLE", 0.95, "HEADCOUNT_MAX")), ((headcount >= low) & high.isNull(), s("APPLICABLE", 0.96, "HEADCOUNT_MIN")), ((headcount <= high) & low.isNull(), s("APPLICABLE", 0.95, "HEADCOUNT_MAX"))], F.lit(None))


def applicability_rules(sectors: Column, sector: Column, cued: Column, chemical: Column, exposed: Column, theme: Column, active: Column, institutional: Column) -> Column:
    """RU1, rules two to five: a single sector with a scope cue, chemical exposure, activity theme, institutional actor; null if none decides."""
    s = lambda v, c, r: F.struct(F.lit(v).alias("status"), F.lit(c).alias("confidence"), F.lit(r).alias("rule"))
    single = (F.size(sectors) == 1) & cued
    return first_match(
        [
            (single & (sectors[0] == sector), s("APPLICABLE", 0.91, "SECTOR")),
            (single, s("NON_APPLICABLE", 0.90, "SECTOR")),
            (chemical & exposed, s("APPLICABLE", 0.88, "CHEMICAL")),
            (theme & active, s("APPLICABLE", 0.86, "ACTIVITY")),
            (institutional, s("NON_APPLICABLE", 0.95, "INSTITUTIONAL")),
        ],
        F.lit(None),
    )


def routed_levels(kind: Column, domain: Column, text: Column, by_kind: dict[str, tuple[str, ...]], by_domain: dict[str, tuple[str, ...]], lex: ModuleType = fr) -> Column:
    """SC2: levels at which a requirement is evaluated: by type, else by domain, else by the cues in its text; null means all."""
    names = lambda levels: F.array(*map(F.lit, levels))
    cues = named([(hit(text, p), n) for n, p in lex.LEVEL_CUES])
    rules = [(kind == k, names(v)) for k, v in by_kind.items()] + [(domain == k, names(v)) for k, v in by_domain.items()] + [(F.size(cues) > 0, cues)]
    return first_match(rules, F.lit(None))


def job_state(failed: Column, running: Column, done: Sequence[tuple[str, Column]]) -> Column:
    """JB1: a job's state and the last stage, in the stages' order, that is done."""
    stage = F.lit("NONE")
    for name, cond in done:
        stage = F.when(cond, name).otherwise(stage)
    finished = done[-1][1]
    return F.struct(F.when(failed, "FAILED").when(finished, "DONE").when(running, "RUNNING").otherwise("QUEUED").alias("state"), stage.alias("stage"))


def quality_gate(status: Column, conf: Column, missing: Column, floor: Column) -> Column:
    """RU2: without a field or below its type's floor a decision is uncertain, at 0.55 at most."""
    bad = missing | (conf < floor)
    return F.struct(F.when(bad, "INCERTAIN").otherwise(status).alias("status"), F.when(bad, F.least(conf, F.lit(0.55))).otherwise(conf).alias("confidence"))


def future_gate(status: Column, effective: Column, as_of: Column) -> Column:
    """RU3."""
    return F.when((status == "APPLICABLE") & (effective > as_of), "APPLICABLE_FUTUR").otherwise(status)


def normative_strength(kind: Column, text: Column, optional: str, conditional: str, imperative: str) -> Column:
    """PO1: by type, then by cue in the order optional, conditional, imperative, else by type's default."""
    return first_match([(kind == "INTERDICTION", F.lit("IMPERATIF")), (kind.isin("EXCEPTION", "CONDITION"), F.lit("CONDITIONNEL")), (hit(text, optional), F.lit("FACULTATIF")), (hit(text, conditional), F.lit("CONDITIONNEL")), (hit(text, imperative), F.lit("IMPERATIF"))], F.when(kind == "OBLIGATION", "IMPERATIF").otherwise("NON_PRECISE"))


def gap_severity(strength: Column, kind: Column, domain: Column, penalty: Column, age: Column) -> Column:
    """PO2: points for strength 3 or 1, type 3 or 2, safety 2, penalty 2, age above a year 1; 7 is critical, 4 major."""
    points = F.when(strength == "IMPERATIF", 3).when(strength == "CONDITIONNEL", 1).otherwise(0) + F.when(kind == "INTERDICTION", 3).when(kind == "OBLIGATION", 2).otherwise(0) + F.when(domain == "SST", 2).otherwise(0) + F.when(penalty, 2).otherwise(0) + F.when(age > 365, 1).otherwise(0)
    return F.struct(points.alias("points"), F.when(points >= 7, "CRITIQUE").when(points >= 4, "MAJEURE").otherwise("MINEURE").alias("severity"))


def merged_priority(existing: Column, severity: Column) -> Column:
    """PO3: the higher of the given priority and the severity's own."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, fr.PRIORITIES)), c), F.lit(0))
    own = first_match([(severity == s, F.lit(p)) for s, p in fr.SEVERITY_PRIORITY.items()], F.lit("NORMALE"))
    return F.element_at(F.array(*map(F.lit, fr.PRIORITIES)), F.greatest(rank(existing), rank(own)).cast("int"))


def age_policy(status: Column, score: Column, only_expired: Column) -> Column:
    """PO4: conformity that rests on expired evidence alone is partial, 0.59 at most."""
    down = only_expired & (status == "CONFORME")
    return F.struct(F.when(down, "PARTIELLEMENT_CONFORME").otherwise(status).alias("status"), F.when(down, F.least(score, F.lit(0.59))).otherwise(score).alias("score"))


def question_depth(question: Column) -> Column:
    """QA1: a question for one article, decree or law, or a short one, takes four passages; others twelve."""
    specific = hit(question, r"\b(?:article|d[ée]cret|loi|arr[êe]t[ée]|art\.)\s*(?:n[°o]?\s*)?\d+") | (F.size(F.split(F.trim(question), r"\s+")) <= 6)
    return F.when(specific, 4).otherwise(12)


KPI_INTENTS = (
    ("COMPLIANCE_RATE", r"taux\s+de\s+conformit[ée]|compliance\s+rate"),
    ("NC_COUNT", r"combien\s+de\s+non[- ]conformit[ée]s|nombre\s+de\s+non[- ]conformit[ée]s"),
    ("MISSING_PROOF", r"preuves?\s+manquantes?|absence\s+de\s+preuve"),
    ("UNEVALUATED", r"non\s+[ée]valu[ée]e?s"),
)


def kpi_intent(question: Column, intents: Sequence[tuple[str, str]] = KPI_INTENTS) -> Column:
    """QA2: the first intent whose cue the question holds."""
    return first_match([(hit(question, p), F.lit(n)) for n, p in intents], F.lit(None).cast("string"))


LOG_ERRORS = (("TIMEOUT", ("timeout", "timed out")), ("QUOTA", ("quota", "rate limit", "429")), ("AUTH", ("unauthorized", "401", "api key")), ("DATABASE", ("psycopg", "connection refused", "deadlock")), ("PARSE", ("json", "decode", "parse")))


def log_error(text: Column) -> Column:
    """JB2: the first class of which the log holds a word."""
    low = F.lower(text)
    rules = []
    for name, words in LOG_ERRORS:
        cond = F.lit(False)
        for w in words:
            cond = cond | low.contains(w)
        rules.append((cond, F.lit(name)))
    return first_match(rules, F.lit("UNKNOWN"))
