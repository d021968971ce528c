"""Types, domains, rejections and error families of requirements.

Each cascade is one SQL expression over columns of text without accents
(``plain``), made from the markers of ``rules.fr_requirements``: the branch that
holds first decides. ``spark_sql`` and ``other_sql`` write it for Spark and for
engines with other names of the same functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, fold
from ..rules import fr_requirements as fr
from .markers import Lexicon, strings_of

#: All markers of the cascades below, read in one pass over a text.
LEXICON = Lexicon(strings_of(*[getattr(fr, n) for n in fr.MARKER_GROUPS]))


#: Marks of what the engines write differently: a pattern's literal, that all matches are replaced, how many of a list hold.
PATTERN, GLOBAL, FIRST = "§p", "§g", "§1"
_HELD = re.compile("§n(.*?)§of(.*?)§end")
_LITERAL = re.compile("'((?:[^']|'')*)'")


def plain(x: str | Column) -> Column:
    """Lower case, without accents, one blank: what markers are compared with."""
    return fold(x)


def with_bits(rows: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_bits``, the markers that each plain text holds."""
    return rows.withColumns({f"{c}_bits": LEXICON.bits(F.col(c)) for c in columns})


def spark_sql(x: str, *marked: str) -> Column:
    """The expression for Spark; ``marked`` columns have their bits beside them, and markers are tested there."""

    def held_in(m: re.Match) -> str:
        bits = LEXICON.count(f"{m[2]}_bits", [a.replace("''", "'") for a in _LITERAL.findall(m[1])]) if m[2] in marked else None
        return bits or f"size(filter(array({m[1]}), m -> contains({m[2]}, m)))"

    return F.expr(_HELD.sub(held_in, x).replace(GLOBAL, "").replace(PATTERN, "r").replace(FIRST, "$1"))


def other_sql(x: str) -> str:
    x = re.sub(r"(-?[0-9.]+)D\b", r"CAST(\1 AS DOUBLE)", x)
    return _HELD.sub(r"len([m FOR m IN [\1] IF contains(\2, m)])", x).replace(GLOBAL, ", 'g'").replace(PATTERN, "").replace(FIRST, "\\1").replace("regexp_like(", "regexp_matches(").replace("btrim(", "trim(").replace("char_length(", "length(")


def plain_sql(x: str) -> str:
    """``plain`` for ``other_sql``."""
    return f"trim(regexp_replace(translate(lower(coalesce({x}, '')), '{ACCENTED}', '{PLAIN}'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def held(column: str, markers: Iterable[str]) -> str:
    """How many of the markers stand in the text."""
    return f"§n{', '.join(map(lit, markers))}§of{column}§end"


def any_of(column: str, markers: Iterable[str]) -> str:
    """Whether a marker stands in the text; one list of all markers, so that the expression stays small."""
    return f"({held(column, markers)} > 0)"


def cascade(rules: Iterable[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def type_alias(model: str) -> str:
    """RT2: a model's type under its own name, AUTRE if it is none."""
    up = f"upper(trim(coalesce({model}, '')))"
    known = ", ".join(map(lit, fr.TYPES))
    return cascade([(f"{up} = {lit(a)}", lit(t)) for a, t in fr.TYPE_ALIASES.items()] + [(f"{up} IN ({known})", up)], "'AUTRE'")


def requirement_type(req: str, both: str, model: str) -> str:
    """RT1: the type by markers in the requirement (``req``) and its citation (``both`` joined); the model's type is what remains."""
    has = lambda m: any_of(both, m)
    q = lambda t: lit(t)
    reports = f"({has(fr.REPORTING_VERB)} AND ({has(fr.REPORTING_TARGET)} OR {has(fr.REPORTING_PAYLOAD)} OR {has(('chaque annee', 'annuellement'))}))"
    rules = [
        (has(fr.RESPONSIBILITY), "RESPONSABILITE"),
        (has(fr.EXCEPTION), "EXCEPTION"),
        (has(fr.INTERDICTION), "INTERDICTION"),
        (f"(contains({both}, 'registre') AND ({model} = 'REGISTRE' OR {has(fr.REGISTER)}))", "REGISTRE"),
        (f"({has(fr.DECLARATION)} OR {reports})", "DECLARATION"),
        (f"({has(fr.ELIGIBLE)} AND ({has(fr.CONDITION)} OR {has(fr.ELIGIBLE_BY)}))", "CONDITION"),
        (f"({has(fr.EFFECT)} AND ({has(fr.CONDITION)} OR {has(fr.EFFECT_OF_CONDITION)}))", "CONDITION"),
        (has(fr.EFFECT), "OBLIGATION"),
        (has(("declar",)), "DECLARATION"),
        (f"({has(fr.CONDITION)} AND NOT {has(fr.OBLIGATION)})", "CONDITION"),
        (has(fr.OBLIGATION), "OBLIGATION"),
        (has(("controle",)), "CONTROLE"),
        (any_of(req, ("avis doit indiquer",)), "OBLIGATION"),
        (f"({any_of(req, ('exemplaire',))} AND {any_of(req, ('a la disposition',))})", "OBLIGATION"),
    ]
    return cascade([(c, q(t)) for c, t in rules], model)


def low_value(core: str, lone: str = "FALSE") -> str:
    """FIL16: too short, a fragment, noise of tables, the gazette's own heading, or without any verb of a rule.

    ``core`` is the plain text without leading headers and OCR noise, ``lone``
    whether it begins with an accented letter that stands alone.
    """
    words = f"(length({core}) - length(replace({core}, ' ', '')) + 1)"
    hit = lambda p: f"regexp_like({core}, {PATTERN}'{p}')"
    noise = [fr.GAZETTE, r"^[0-9]+ ?[-–] ?[0-9]+ ?[-–]", fr.NAME_CHAIN]
    return f"({lone} OR length({core}) < 20 OR {words} < 4 OR {core} IN ({', '.join(map(lit, fr.BARE_WORDS))}) OR {' OR '.join(map(hit, noise))} OR NOT {hit(fr.LOW_VALUE_VERB)})"


def domain_score(both: str, kind: str) -> str:
    """QD1: markers found of the best sub-domain, with the bonuses of its domain, and its place (the earlier of equals), in one number: score * 100 + place from the end; negative without any marker."""
    has = lambda m: any_of(both, m)
    institution = has(fr.INSTITUTIONS)
    bonus = {
        "ADMINISTRATIF": f"CASE WHEN {kind} IN ('DECLARATION', 'REGISTRE') THEN 1 ELSE 0 END",
        "JURIDIQUE_GENERAL": f"CASE WHEN {kind} IN ('INTERDICTION', 'CONDITION', 'EXCEPTION') THEN 1 ELSE 0 END",
        "GOUVERNANCE": f"CASE WHEN {institution} THEN 1 ELSE 0 END",
        "RESSOURCES_HUMAINES": f"CASE WHEN {institution} AND {has((*fr.CONTROLLING, *fr.ANSWERING))} THEN -2 ELSE 0 END",
    }
    scores = []
    for i, (d, _, markers) in enumerate(fr.SUB_DOMAINS):
        n = held(both, markers)
        hinted = ", ".join(lit(t) for t, (x, _) in fr.TYPE_DOMAIN.items() if x == d)
        hint = f" + CASE WHEN {kind} IN ({hinted}) THEN 1 ELSE 0 END" if hinted else ""
        scores.append(f"CASE WHEN {has(markers)} THEN ({n}{hint} + {bonus.get(d, '0')}) * 100 + {len(fr.SUB_DOMAINS) - i} ELSE -10000 END")
    return f"greatest({', '.join(scores)})"


def domain(req: str, both: str, kind: str, score: str) -> str:
    """QD1: ``DOMAIN|SUB_DOMAIN|strategy`` of a requirement of a type; ``score`` as ``domain_score`` gives it."""
    has, own = (lambda m: any_of(both, m)), (lambda m: any_of(req, m))
    institution = has(fr.INSTITUTIONS)
    rule = lambda d, s: lit(f"{d}|{s}|rule")
    digits, words = f"length(regexp_replace(regexp_replace({req}, '[0-9]+', '1'{GLOBAL}), '[^1]', ''{GLOBAL}))", f"length(regexp_replace(regexp_replace({req}, '[a-z][a-z]+', '#'{GLOBAL}), '[^#]', ''{GLOBAL}))"
    guard = f"(length({req}) < 20 OR {own(fr.DOMAIN_NOISE)} OR ({kind} = 'AUTRE' AND ({digits} > 0.33 * {words} AND {words} > 0 OR {low_value(req)})))"
    first = [
        (guard, lit("UNMAPPED|UNMAPPED|noise_guard")),
        (own(fr.HARD_INTERDICTION), rule("JURIDIQUE_GENERAL", "INTERDICTIONS")),
        (own(fr.DOCUMENTS), rule("ADMINISTRATIF", "DOCUMENTATION")),
        (f"({has(('cahier des charges',))} AND {has(('modalites', 'transport'))})", rule("TECHNIQUE_OPERATIONNEL", "PROCEDURES")),
        (f"({has(('societe communautaire', 'societes communautaires'))} AND {has(('compose de', 'composee de', 'composees de'))})", rule("GOUVERNANCE", "ORGANISATION")),
        (f"({kind} = 'CONDITION' AND {own(fr.CONDITION_OF_RIGHT)})", rule("JURIDIQUE_GENERAL", "CONDITIONS_REGLEMENTAIRES")),
        (f"({kind} IN ('OBLIGATION', 'DECLARATION') AND {own(fr.OBLIGATION_CLAUSE)} AND NOT {own(fr.CONDITION_CLAUSE)} AND NOT {institution} AND NOT {own(fr.RECRUITING)})", rule("JURIDIQUE_GENERAL", "OBLIGATIONS_LEGALES")),
        (f"(NOT {institution} AND {has(fr.RECRUITING)})", rule("RESSOURCES_HUMAINES", "RECRUTEMENT")),
        (f"({kind} = 'CONDITION' AND {has(('anciennete',))} AND {has(('grade', 'plus age'))})", rule("RESSOURCES_HUMAINES", "RECRUTEMENT")),
        (f"({institution} AND {has(fr.ORGANISING)})", rule("GOUVERNANCE", "ORGANISATION")),
        (f"({institution} AND {has(fr.ANSWERING)})", rule("GOUVERNANCE", "RESPONSABILITES")),
        (f"({institution} AND {has(fr.CONTROLLING)})", rule("GOUVERNANCE", "CONTROLE")),
    ]
    last = f"({score} + 10000) % 100"
    rated = cascade([(f"{last} = {len(fr.SUB_DOMAINS) - i}", rule(d, s)) for i, (d, s, _) in enumerate(fr.SUB_DOMAINS)], "NULL")
    fallback = cascade([(f"{kind} = {lit(t)}", lit(f"{d}|{s}|type_fallback")) for t, (d, s) in fr.TYPE_DOMAIN.items()], lit("JURIDIQUE_GENERAL|OBLIGATIONS_LEGALES|default_fallback"))
    return cascade([*first, (f"{score} > -5000", rated)], fallback)


def missing(req: str, source: str, markers: Iterable[str]) -> str:
    """FIL16: whether the source has a marker that the requirement lacks."""
    return "(" + " OR ".join(f"({any_of(source, (m,))} AND NOT {any_of(req, (m,))})" for m in markers) + ")"


def subject_mismatch(req: str, chunk: str) -> str:
    """RJ1: the requirement speaks of one who does not stand in the source, where another does."""
    r, s = ({n: any_of(c, m) for n, m in fr.SUBJECTS} for c in (req, chunk))
    lacks = lambda n: f"{r[n]} AND NOT {s[n]}"
    return f"(({lacks('employeur')} AND {s['salarie']}) OR ({lacks('salarie')} AND {s['employeur']}) OR ({lacks('entreprise')} AND {s['salarie']}) OR ({lacks('convention')} AND ({s['salarie']} OR {s['employeur']})) OR ({lacks('registre')}))"


def _replaced(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {_regex(pattern)}, '{to}'{GLOBAL})"


def _spaced(x: str) -> str:
    blanks = _replaced(f"coalesce({x}, '')", "[ \t\r\n\f\u00a0]+", " ")
    return f"btrim({blanks}, ' ')"


def _folded(x: str) -> str:
    return f"translate(lower({x}), {lit(ACCENTED + '’‘')}, {lit(PLAIN + QUOTE * 2)})"


def _first_part(x: str, ends: str) -> str:
    found = f"regexp_extract({x}, {PATTERN}'^(.*?{ends})\\s+', 1)"
    return f"CASE WHEN {found} = '' THEN {x} ELSE {found} END"


QUOTE = "'"
#: What ``strip_header`` takes off.
HEADER = r"(?i)^\s*(?:\[\s*)?(?:Article\s+(?:premier|1er|\d+)|Art\.?\s*\d+(?:[-\.]\d+)*(?:\s*(?:bis|ter|quater|quinquies))?)\s*[\]\-:–—]*\s*"
EDGES = "' -:;,.'"


def statement_views() -> list[dict[str, str]]:
    """Layers of columns over ``r`` (requirement), ``s`` (citation) and ``c`` (chunk): what the filters and scores read."""
    lead = "text"
    for _ in range(3):
        for pattern in fr.LEADING:
            lead = _replaced(lead, pattern)
    sentence = "[.;:!?]"
    rest = f"regexp_extract(bare, {PATTERN}'^.*?{sentence}\\s+(.*)$', 1)"
    elided = _replaced(f"replace(lower(substr(clause, 1, 120)), '’', {lit(QUOTE)})", r"\bl'([a-z])", FIRST)
    return [
        {"text": _spaced("r"), "source": _spaced("s"), "chunk": _spaced("c")},
        {"req": _folded("text"), "src": _folded("source"), "chunk_plain": _folded("chunk"), "lead": f"btrim({lead}, ' ')", "bare": f"btrim({_replaced('text', HEADER)}, {EDGES})"},
        {"both": "req || ' || ' || src", "core": _folded("lead"), "lone": like("lead", fr.LONE_LETTER), "folded": _folded("bare"), "clause": _first_part("bare", "[.;:]"), "first": f"btrim({_first_part('bare', sentence)}, {EDGES})", "rest": rest},
        {"key": f"btrim({_replaced(_replaced(_folded(elided), r'[^a-z0-9_ -]'), ' +', ' ')}, ' ')", "second": f"btrim({_first_part('rest', sentence)}, {EDGES})"},
    ]


def _regex(pattern: str) -> str:
    """A pattern's literal; apostrophes by number, as engines differ in how a raw literal holds them."""
    return PATTERN + "'" + pattern.replace("'", r"\x27") + "'"


def like(column: str, pattern: str) -> str:
    return f"regexp_like({column}, {_regex(pattern)})"


def publication(both: str) -> str:
    return like(both, fr.PUBLICATION)


def individual_act(both: str) -> str:
    """FIL16: appoints a named person, with no general norm, institution or competition in it."""
    has = lambda m: any_of(both, m)
    return f"({like(both, fr.ACT_NAME)} AND {has(fr.ACT_MARKERS)} AND NOT {has(fr.GENERAL_NORMS)} AND NOT {has(fr.INSTITUTIONAL_SUBJECTS)} AND NOT {has(fr.INSTITUTIONAL_CUES)})"


def missing_condition(req: str, src: str) -> str:
    return missing(req, src, fr.MISSING_CONDITION)


def missing_scope(req: str, src: str) -> str:
    return missing(req, src, fr.MISSING_SCOPE)


def non_actionable_scope(req: str, src: str) -> str:
    """FIL16: says what a text applies to, not what to do."""
    return f"({any_of(req, fr.SCOPE_OF_APPLICATION)} OR ({any_of(src, fr.SCOPE_SOURCES)} AND {any_of(req, ("champ d'application",))} AND NOT {any_of(req, fr.SCOPE_NORMS)}))"


def partial_exception(req: str, src: str) -> str:
    """FIL16: begins with "sauf", lacks subject or verb, and is the tail of a longer sentence of the source."""
    long = lambda cue: f"(contains({src}, '{cue}') AND length(btrim(split_part({src}, '{cue}', 1), ' ,;:')) >= 20)"
    return f"(substr({req}, 1, 5) = 'sauf ' AND NOT ({like(req, fr.EXCEPTION_SUBJECT)} AND {like(req, fr.EXCEPTION_VERB)}) AND ({long('sauf si')} OR {long('sauf ')}))"


def invented(req: str, src: str) -> str:
    """FIL16: rules something where the source rules nothing."""
    return f"({any_of(req, fr.INVENTED_NORMS)} AND NOT {any_of(src, fr.SOURCE_NORMS)})"


def definition_article(text: str) -> str:
    """FIL16: an article (plain, header off) that begins as a definition and holds no strong norm."""
    return f"({like(f'substr({text}, 1, 250)', fr.DEFINITION_STARTS)} AND NOT {any_of(text, fr.DEFINITION_NORMS)})"


def definition_unit(text: str) -> str:
    """FIL16: a unit that defines or names; one that matches a definition and holds a norm is none."""
    names = f"(({any_of(text, ('appelee',))} AND {any_of(text, ("s'engage a",))}) OR {any_of(text, fr.CONCLUDED)})"
    return f"CASE WHEN {like(text, fr.UNIT_DEFINITIONS)} THEN NOT {any_of(text, fr.UNIT_NORMS)} ELSE {names} END"


def scope_extension(unit: str, chunk: str) -> str:
    """FIL16: a unit (plain, list sign off) that only says to whom an article's rules extend."""
    norms = any_of(unit, fr.EXTENSION_NORMS)
    return f"(NOT {norms} AND (({any_of(chunk, fr.EXTENSION_CONTEXT)} AND {like(unit, fr.EXTENSION_STARTS)}) OR {any_of(unit, fr.CLASSIFICATION)}))"


def _start_score(text: str, folded: str) -> str:
    """How much a sentence looks like the start of a statement."""
    return (
        f"CASE WHEN length({text}) < 24 THEN -100 ELSE CASE WHEN {text} <> '' AND substr({text}, 1, 1) <> lower(substr({text}, 1, 1)) THEN 2 ELSE 0 END + CASE WHEN {like(folded, fr.STRONG_START)} THEN 5 ELSE 0 END"
        f" + CASE WHEN {like(f'substr({folded}, 1, 140)', fr.STRONG_WORD)} THEN 4 ELSE 0 END - CASE WHEN {like(folded, fr.BAD_START)} THEN 8 ELSE 0 END - CASE WHEN {like(text, fr.LOWER_START)} THEN 4 ELSE 0 END END"
    )


def fragmentary(bare: str, folded: str, clause: str, key: str, first: str, second: str) -> str:
    """RJ1: begins in the middle of a sentence.

    ``bare`` is the text without header and edge signs, ``folded`` the same as
    plain text, ``clause`` its first clause, ``key`` that clause's first 120
    signs as letters only, ``first`` and ``second`` its first two sentences.
    """
    word = f"split_part({key}, ' ', 1)"
    words = f"(length({key}) - length(replace({key}, ' ', '')) + 1)"
    plain_of = lambda x: f"lower(translate(lower({x}), '{ACCENTED}', '{PLAIN}'))"
    one, two = _start_score(first, plain_of(first)), _start_score(second, plain_of(second))
    return cascade(
        [
            (f"length({bare}) < 28", "FALSE"),
            (like(folded, fr.HEADER_START), "TRUE"),
            (like(bare, fr.LOWER_START), "TRUE"),
            (f"{word} <> '' AND length({word}) <= 2 AND {word} NOT IN ({', '.join(map(lit, fr.SHORT_STARTS))})", "TRUE"),
            (f"{words} = 1 AND {key} <> '' AND length({key}) <= 6 AND length({bare}) > length({clause}) + 18", "TRUE"),
            (like(key, r"\bdoit\s+et\s+de\b"), "TRUE"),
            (like(key, fr.SUBJECT_START), "FALSE"),
            (like(key, fr.CUT_START), "TRUE"),
            (like(key, fr.LINK_START), "TRUE"),
            (f"{second} <> '' AND ({two}) >= greatest(6, ({one}) + 4) AND (NOT {like(key, fr.SENTENCE_START)} OR (length({word}) <= 6 AND {words} <= 2))", "TRUE"),
        ],
        "FALSE",
    )


def subject_verb_mismatch(folded: str) -> str:
    """RJ1: a subject and its verb disagree in number."""
    return f"(length({folded}) >= 28 AND ({like(folded, fr.SINGULAR_PLURAL)} OR {like(folded, fr.PLURAL_SINGULAR)}))"


#: RJ1: the filters in order; a soft one only marks a requirement that speaks of legal risk.
FILTERS = (("LOW_VALUE", True), ("FRAGMENTARY_RUNTIME", False), ("SUBJECT_VERB_MISMATCH", False), ("NON_ACTIONABLE_SCOPE", True), ("PARTIAL_EXCEPTION", True), ("INVENTED_NON_NORMATIVE", True), ("OUT_OF_SCOPE_INDIVIDUAL", False))


def filter_hits() -> dict[str, str]:
    """RJ1: whether each filter holds, and ``guard``, over the columns of ``statement_views``."""
    out = f"({publication('both')} OR {individual_act('both')})"
    return {
        "LOW_VALUE": low_value("core", "lone"),
        "FRAGMENTARY_RUNTIME": fragmentary("bare", "folded", "clause", "key", "first", "second"),
        "SUBJECT_VERB_MISMATCH": subject_verb_mismatch("folded"),
        "NON_ACTIONABLE_SCOPE": non_actionable_scope("req", "src"),
        "PARTIAL_EXCEPTION": partial_exception("req", "src"),
        "INVENTED_NON_NORMATIVE": invented("req", "src"),
        "OUT_OF_SCOPE_INDIVIDUAL": out,
        "guard": f"({any_of('both', fr.RISK)} AND NOT {out})",
    }


def filter_events(hits: dict[str, str]) -> list[tuple[str, str, str]]:
    """``(filter, whether it emits an event, whether the event is soft)``: soft hits go on to the next filter, the first hard one ends."""
    out, open_ = [], []
    for name, soft in FILTERS:
        so_far = " AND ".join([hits[name], *open_])
        out.append((name, f"({so_far})", hits["guard"] if soft else "FALSE"))
        open_.append(f"NOT ({hits[name]} AND NOT {hits['guard']})" if soft else f"NOT {hits[name]}")
    return out


def confidence(kind: str) -> str:
    """CF1: sixteen adjustments of 0.58, over the columns of ``statement_views``."""
    parts = [
        ("length(text) >= 20", 0.05),
        ("length(text) >= 40", 0.04),
        ("length(source) >= 25", 0.05),
        ("source <> '' AND contains(lower(chunk), lower(source))", 0.08),
        ("NOT (source <> '' AND contains(lower(chunk), lower(source)))", -0.12),
        (f"{kind} IN ({', '.join(map(lit, fr.CONFIDENT_TYPES))})", 0.05),
        (any_of("req", fr.CONFIDENT_NORMS), 0.05),
        (missing_condition("req", "src"), -0.10),
        (subject_mismatch("req", "chunk_plain"), -0.12),
        (missing_scope("req", "src"), -0.08),
        (invented("req", "src"), -0.15),
        ("heavy", -0.22),
        ("signals AND NOT heavy", -0.10),
        ("regexp_like(text, " + PATTERN + "'^(Il|Elle|il|elle) ')", -0.06),
        (non_actionable_scope("req", "src"), -0.20),
        (partial_exception("req", "src"), -0.12),
        (low_value("core", "lone"), -0.20),
    ]
    return "round(least(0.97D, greatest(0.20D, 0.58D" + "".join(f" + CASE WHEN {c} THEN {w}D ELSE 0D END" for c, w in parts) + ")), 2)"


def headcount_limit(req: str, patterns: Iterable[str]) -> str:
    """RU1: the number of the first pattern that a plain text holds, or null."""
    found = ", ".join(f"nullif(regexp_extract({req}, {PATTERN}'{p}', 1), '')" for p in patterns)
    return f"CAST(coalesce({found}, NULL) AS INT)"


def applicability(req: str, headcount: str, sector: str, chemicals: str, means: str) -> str:
    """RU1: ``STATUS|confidence|RULE`` of the first rule that decides without a model, or null.

    ``req``, ``sector``, ``chemicals`` (substances and products) and ``means``
    (activities and equipment) are plain texts, ``headcount`` a number or null.
    A headcount limit comes first, then a single sector named with a cue of
    scope, chemicals at hand, a theme of both sides, and a public actor who opens
    the first sentence. An empty requirement or one that no rule meets is null.
    """
    has = lambda m: any_of(req, m)
    low, high = headcount_limit(req, fr.HEADCOUNT_MIN), headcount_limit(req, fr.HEADCOUNT_MAX)
    named = "(" + " + ".join(f"CASE WHEN {has(m)} THEN 1 ELSE 0 END" for _, m in fr.SECTORS) + ")"
    single = f"({has(fr.SECTOR_SCOPE)} AND {any_of(sector, [w for _, m in fr.SECTORS for w in m])} AND {named} = 1)"
    shared = "(" + " OR ".join(f"({has(m)} AND {any_of(sector, m)})" for _, m in fr.SECTORS) + ")"
    head = f"substr(split_part({req}, '.', 1), 1, 220)"
    public = " OR ".join(f"substr({head}, 1, {len(p)}) = {lit(p)}" for p in fr.PUBLIC_ACTORS)
    return cascade(
        [
            (f"{low} IS NOT NULL AND {headcount} >= {low}", "'APPLICABLE|0.96|EFFECTIF_MIN_MATCH'"),
            (f"{low} IS NOT NULL AND {headcount} < {low}", "'NON_APPLICABLE|0.96|EFFECTIF_MIN_MISMATCH'"),
            (f"{low} IS NULL AND {high} IS NOT NULL AND {headcount} <= {high}", "'APPLICABLE|0.95|EFFECTIF_MAX_MATCH'"),
            (f"{low} IS NULL AND {high} IS NOT NULL AND {headcount} > {high}", "'NON_APPLICABLE|0.95|EFFECTIF_MAX_MISMATCH'"),
            (f"{single} AND {shared}", "'APPLICABLE|0.91|SECTOR_MATCH'"),
            (single, "'NON_APPLICABLE|0.90|SECTOR_MISMATCH'"),
            (f"{has(fr.CHEMICAL)} AND {chemicals} <> ''", "'APPLICABLE|0.88|CHEMICAL_EXPOSURE_MATCH'"),
            *[(f"{has(r)} AND {any_of(means, c)}", f"'APPLICABLE|0.86|{n}'") for n, r, c in fr.ACTIVITY_THEMES],
            (f"({public}) AND NOT {any_of(head, fr.PRIVATE_ACTORS)}", "'NON_APPLICABLE|0.95|INSTITUTIONAL_ACTOR_MISMATCH'"),
        ],
        "NULL",
    )


def error_family(filter_name: Column, reasons: Column, verdict: Column, type_match: Column, subject: Column) -> Column:
    """EM2: ``struct<family, action, severity, fix>`` of an error's reason codes, or null."""
    some = lambda f: F.exists(reasons, f)
    r = lambda x: F.upper(F.trim(x))
    named = lambda *codes: some(lambda x: r(x).isin(*codes))
    begins = lambda p: some(lambda x: r(x).startswith(p))

    def of(family: str, action: str, severity: str) -> Column:
        return F.struct(F.lit(family).alias("family"), F.lit(action).alias("action"), F.lit(severity).alias("severity"), F.lit(fr.FAMILY_FIX.get(family)).cast("string").alias("fix"))

    return (
        F.when(named("COMPLETENESS_FUSED_ACTION_CHAIN"), of("STRUCTURAL_FUSION", "FORCE_VALIDATE", "HIGH"))
        .when(named("COMPLETENESS_DANGLING_TAIL", "COMPLETENESS_DANGLING_TAIL_DROP"), of("SNIPPET_TRUNCATION", "FORCE_VALIDATE", "HIGH"))
        .when(begins("COMPLETENESS_MISSING_") | named("MISSING_COMPONENT"), of("MISSING_COMPONENT", "FORCE_VALIDATE", "HIGH"))
        .when(begins("GROUNDING_") | begins("LOW_SNIPPET_OVERLAP") | F.coalesce(F.upper(F.trim(verdict)).isin("SOFT_FAIL", "HARD_FAIL"), F.lit(False)), of("WEAK_GROUNDING", "FORCE_VALIDATE", "HIGH"))
        .when(begins("TYPE_") | ~F.coalesce(type_match, F.lit(True)), of("TYPE_DRIFT", "FORCE_VALIDATE", "MEDIUM"))
        .when(begins("SUBJECT_") | ~F.coalesce(subject, F.lit(True)), of("SUBJECT_DRIFT", "FORCE_VALIDATE", "MEDIUM"))
        .when(F.upper(F.trim(filter_name)).isin(*fr.OBSERVED_FILTERS) | named(*fr.OBSERVED_REASONS), of("NON_NORMATIVE_FALSE_POSITIVE", "OBSERVE_ONLY", "MEDIUM"))
    )
