"""Text normalisation, coercion and small scalar functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..rules import fr_ocr

#: Java patterns that match as the domain's rules mean it: any case, Unicode letters and boundaries.
UNICODE = "(?iuU)"

# Accented letters and their bases.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Punctuation variants and what they are read as.
PUNCTUATION = ("‘’‚′“”„″‐‑‒–—―", "''''\"\"\"\"------")
LIGATURES = (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ﬁ", "fi"), ("ﬂ", "fl"))

# What Unicode calls white space; runs of blanks, and of white space, that are not one blank already, as one blank.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = (r"[ \t]{2,}|\t", " ")
WHITES = (r"(?U)\s{2,}|[\s&&[^ ]]", " ")

# The common character entities.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _c(x: str | Column) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` made once: within functions over arrays nothing else keeps what is asked for twice."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def spaces(x: str | Column) -> Column:
    """White space runs as one blank, trimmed. Single blanks, which are most, are left as they are."""
    return F.trim(F.regexp_replace(_c(x), r"[ \t\n\r\f\x0B]{2,}|[\t\n\r\f\x0B]", " "))


def respaced(x: Column) -> Column:
    """``spaces`` of a text that mostly is spaced already: that is looked for first."""
    uneven = lambda t: reduce(or_, (F.contains(t, F.lit(s)) for s in ("  ", *"\t\n\r\f\x0B")))
    return once(x, lambda t: F.when(uneven(t), spaces(t)).otherwise(F.trim(t)))


def fold(x: str | Column) -> Column:
    """ST2, ST4: lower case, accents off, one blank."""
    return spaces(F.translate(F.lower(_c(x)), ACCENTED, PLAIN))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; there is no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def may_match(x: Column, words: Iterable[str]) -> Column:
    """Whether a text holds one of the words (lower case, plain letters), one of which every match of a pattern blind to case has: a search for bytes, where a pattern is tried at each sign."""
    # letters that such patterns read as an i, s or k count as any word
    odd = reduce(or_, (F.contains(x, F.lit(s)) for s in "İıſ\u212a"))
    return odd | once(F.lower(x), lambda low: reduce(or_, (F.contains(low, F.lit(w)) for w in words)))


def replaced_where(x: Column, steps: Iterable[tuple[str, str, tuple[str, ...]]]) -> Column:
    """Patterns with replacements; neighbours that name words are tried only where the text holds one of all theirs. Replacements must not join letters, so that no word comes about meanwhile."""
    for named, group in groupby(steps, lambda s: bool(s[2])):
        group = list(group)
        pairs, words = [s[:2] for s in group], sorted({w for s in group for w in s[2]})
        x = once(x, _tried(pairs, words)) if named else _replaced(x, pairs)
    return x


def _tried(steps: list[tuple[str, str]], words: list[str]) -> Callable[[Column], Column]:
    return lambda t: F.when(may_match(t, words), _replaced(t, steps)).otherwise(t)


def _replaced(x: Column, steps: Iterable[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


def stripped(x: Column) -> Column:
    """Without Unicode's white space at both ends."""
    return F.btrim(x, F.lit(WHITE))


def _plain_signs(x: str | Column, compose: bool) -> Column:
    """Line feeds, compatibility composition if asked for, plain quotes, dashes, blanks and ligatures."""
    out = F.regexp_replace(_c(x), r"\r\n?", "\n")
    out = F.translate(F.translate(nfkc(out) if compose else out, *PUNCTUATION), "\u00a0\u202f", "  ")
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def legal_normal(x: str | Column, compose: bool = False) -> Column:
    """ST1: the normaliser's steps in order; ``compose`` puts NFKC first (a pandas UDF)."""
    return stripped(_replaced(_plain_signs(x, compose), [(p, to) for _, p, to in fr_ocr.LEGAL_STEPS]))


def legal_counts(x: str | Column, compose: bool = False) -> Column:
    """ST1's counters: signs replaced, and how often each step changes the text that the steps before leave."""
    raw = _c(x)
    signs = nfkc(raw) if compose else raw
    counts = [F.regexp_count(signs, F.lit(f"[{PUNCTUATION[0]}]")).alias("punctuation"), F.regexp_count(signs, F.lit("[" + "".join(a for a, _ in LIGATURES) + "]")).alias("ligature")]
    out = _plain_signs(x, compose)
    for name, pattern, to in fr_ocr.LEGAL_STEPS:
        counts.append(F.regexp_count(out, F.lit(pattern)).alias(name))
        out = F.regexp_replace(out, pattern, to)
    return F.struct(*counts)


def requirement_key(x: str | Column) -> Column:
    """ST3: lower, elided article off, punctuation as blanks, one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"\bl['’]", ""), r"[^\p{L}0-9]+", " "))


def ocr_score(x: str | Column) -> Column:
    """ST5: weighted hits of artefacts: pipes in words, digits in words, broken hyphens, lone letters, doubled punctuation."""
    t = _c(x)
    n = lambda p: F.regexp_count(t, F.lit(p))
    return 2 * n(r"[A-Za-z]\|[A-Za-z]") + 2 * n(r"[A-Za-z][0-9]+[A-Za-z]") + n(r"-\n") + n(r"(?:^| )[b-df-hj-xzB-DF-HJ-XZ](?: |$)") + n(r"[.,;:]{2,}")


def single_spaced(x: str | Column) -> Column:
    """Blanks and tabs as one blank, empty lines out, ends trimmed."""
    return stripped(_replaced(F.replace(_c(x), F.lit("\u00a0"), F.lit(" ")), [BLANKS, (r"\n{2,}", "\n")]))


def ocr_share(x: str | Column) -> Column:
    """ST5: share of tokens with digits or capitals inside, or with a part said twice, to four places; 0 without tokens."""
    tokens = F.regexp_extract_all(single_spaced(x), F.lit(fr_ocr.TOKEN), F.lit(0))
    odd = F.filter(tokens, lambda t: t.rlike(fr_ocr.SUSPICIOUS_TOKEN))
    return F.round(F.size(odd) / F.greatest(F.size(tokens), F.lit(1)), 4)


def ocr_signals(x: str | Column) -> Column:
    """ST5: any sign of OCR."""
    text, signs = single_spaced(x), F.lit(False)
    for pattern in fr_ocr.SIGNALS:
        signs = signs | text.rlike(pattern)
    return signs


def ocr_heavy(x: str | Column) -> Column:
    """ST5: many such tokens, or fewer and a sign of OCR."""
    share, signs = ocr_share(x), ocr_signals(x)
    return (share >= fr_ocr.HEAVY) | ((share >= fr_ocr.HEAVY_WITH_SIGNALS) & signs)


def ocr_repaired(x: str | Column) -> Column:
    """ST5: a line without what OCR put into it."""
    # blanks are evened out where there are two, or a tab or line feed
    uneven = lambda t: reduce(or_, (F.contains(t, F.lit(s)) for s in ("  ", *"\t\n\u00a0")))
    spaced = once(_c(x), lambda t: F.when(uneven(t), single_spaced(t)).otherwise(stripped(t)))
    joined = _replaced(spaced, fr_ocr.LINE_REPAIRS[:2])
    return F.btrim(F.regexp_replace(replaced_where(joined, [(p, to, fr_ocr.WORDS.get(p, ())) for p, to in fr_ocr.LINE_REPAIRS[2:]]), *WHITES), F.lit(fr_ocr.EDGES))


def sanitize(x: str | Column) -> Column:
    """ST6: a text as one line for extraction.

    Lines begin where articles, signatures and page headers do. Page headers go,
    as do signatures, persons and bare names unless they hold a normative word;
    then segments of names and offices inside the rest.
    """
    where = lambda t, steps: replaced_where(t, [(p, to, fr_ocr.WORDS.get(p, ())) for p, to in steps])
    broken = where(F.replace(single_spaced(x), F.lit("\n"), F.lit(" ")), [(fr_ocr.HARD_BREAK, "\n")])
    lines = F.transform(F.split(broken, r"\n+"), ocr_repaired)

    def stays(line: Column) -> Column:
        page = line.rlike(fr_ocr.PAGE_LINE) | line.rlike(fr_ocr.PAGE_MENTION)
        signed = line.rlike(fr_ocr.SIGNATURE_LINE) | line.rlike(fr_ocr.PERSON_LINE) | line.rlike(fr_ocr.NAME_LINE)
        return (line != "") & ~page & (~signed | line.rlike(fr_ocr.NORMATIVE_KEEP))

    out = ocr_repaired(where(F.array_join(F.filter(lines, stays), " "), fr_ocr.INLINE_NOISE))
    out = where(out, [(fr_ocr.NAME_LIST, " "), (fr_ocr.SIGNED_ON, " "), WHITES])
    return F.btrim(out, F.lit(fr_ocr.EDGES))


def entities(x: str | Column) -> Column:
    """ST7: the common entities, the ampersand last."""
    out = _c(x)
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_header(x: str | Column) -> Column:
    """ST8: without the article's own header, and without what follows a foreign header behind the first forty characters."""
    own = F.regexp_replace(_c(x), UNICODE + r"^\s*(?:\[\s*)?(?:article\s+(?:premier|1er|\d+)|art\.?\s*\d+(?:[-.]\d+)*)\s*[\]\-:–—]*\s*", "")
    at = F.regexp_instr(F.substring(own, 41, 1 << 30), F.lit(UNICODE + r"(?<![\p{L}'’])(?:article|art\.?)\s*(?:n\s*)?(?:premier|1er|\d+(?:[-.]\d+)*)\s*[-:–—]"))
    return F.trim(F.when(at > 0, F.substring(own, F.lit(1), at + 39)).otherwise(own))


def article_code(x: str | Column) -> Column:
    """ST9: code of an article label: ``70 (bis)`` is ``70-bis``, ``6.2`` is ``6-2``, ``premier`` is ``1``; empty if there is none."""
    label = F.lower(spaces(x))
    pattern = r"\b(?:article|art\.?)\s*(?:n\s*)?(premier|1er|unique|\d+(?:[-.]\d+)*)(?:\s*\(?\s*(bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies|undecies|duodecies)\b)?"
    main = F.regexp_replace(F.regexp_extract(label, pattern, 1), r"\.", "-")
    main = F.when(main.isin("premier", "1er"), "1").otherwise(main)
    suffix = F.regexp_extract(label, pattern, 2)
    return F.when(suffix != "", F.concat(main, F.lit("-"), suffix)).otherwise(main)


def to_int(x: str | Column) -> Column:
    """ST10: digits and a leading minus; null if there are none."""
    return F.regexp_replace(F.trim(_c(x)), r"(?!^-)[^0-9]", "").try_cast("bigint")


def to_float(x: str | Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(_c(x)), F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast("double")


#: Date formats in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy")


def to_date(x: str | Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(_c(x)), F.lit(f)).cast("date") for f in DATE_FORMATS])


def to_bool(x: str | Column, default: bool = False) -> Column:
    v = fold(x)
    return F.when(v.isin("1", "true", "oui", "yes", "vrai", "y", "o"), True).when(v.isin("0", "false", "non", "no", "faux", "n"), False).otherwise(F.lit(default))


def to_list(x: str | Column) -> Column:
    return F.filter(F.transform(F.split(_c(x), r"[|,;\n]"), lambda p: F.trim(p)), lambda p: p != "")


def truncate(x: str | Column, limit: int) -> Column:
    """ST11: at the limit."""
    return F.substring(_c(x), 1, limit)


def truncate_sentence(x: str | Column, limit: int) -> Column:
    """ST11: at the last sentence end before the limit, else at the limit."""
    head = F.substring(_c(x), 1, limit)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(_c(x)) <= limit, _c(x)).when(whole != "", whole).otherwise(head)


def slug(x: str | Column) -> Column:
    """ST12, SRC9."""
    return F.regexp_replace(F.regexp_replace(F.replace(fold(x), F.lit("%"), F.lit("pct")), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def citation(label: Column, first: Column, last: Column) -> Column:
    """ST13."""
    pages = F.when(first == last, F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.when(first.isNull(), label).otherwise(F.concat(label, F.lit(", "), pages))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """MA3: parts that are null drop out and the weights of the others grow."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    value = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in parts[1:]), F.coalesce(parts[0][0], F.lit(0.0)) * parts[0][1])
    return value / F.nullif(total, F.lit(0.0))


def distinct_strings(x: Column, limit: int) -> Column:
    """AR1: first of each string blind to case, in order, at most ``limit``."""
    trimmed = F.filter(F.transform(x, lambda s: F.trim(s)), lambda s: s != "")
    low = F.transform(trimmed, lambda s: F.lower(s))
    return F.slice(F.transform(F.filter(F.transform(trimmed, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda p: F.array_position(low, F.lower(p["s"])) == p["i"] + 1), lambda p: p["s"]), 1, limit)


def clean_json(x: str | Column) -> Column:
    """JS1: the object of a model's answer, without code fences and what stands around it."""
    t = F.regexp_replace(F.trim(_c(x)), r"(?is)^```(?:json)?\s*|\s*```$", "")
    return F.regexp_extract(t, r"(?s)(\{.*\})", 1)


def effective_date(x: str | Column, months: tuple[str, ...]) -> Column:
    """DT1: a day, month name, year, or a numeric date; two-digit years above 70 are of the last century."""
    t = F.translate(F.lower(_c(x)), ACCENTED, PLAIN)
    names = [m.translate(str.maketrans(ACCENTED, PLAIN)) for m in months]
    pattern = r"\b(\d{1,2})(?:er)?\s+(" + "|".join(names) + r")\s+(\d{4})\b"
    d, m, y = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, names)), m)
    named = F.when(d != "", F.try_make_timestamp(y.cast("int"), number.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0.0)).cast("date"))
    numeric = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\b"
    nd, nm, ny = (F.regexp_extract(t, numeric, i) for i in (1, 2, 3))
    year = ny.try_cast("int")
    year = F.when(F.length(ny) == 2, F.when(year > 70, year + 1900).otherwise(year + 2000)).otherwise(year)
    return F.coalesce(named, F.when(nd != "", F.try_make_timestamp(year, nm.try_cast("int"), nd.try_cast("int"), F.lit(0), F.lit(0), F.lit(0.0)).cast("date")))


def delay_days(x: str | Column) -> Column:
    """DT1: a delay in days; months count 30, years 365."""
    t = F.translate(F.lower(_c(x)), ACCENTED, PLAIN)
    n, unit = F.regexp_extract(t, r"\b(\d{1,4})\s+(jours?|mois|ans?|annees?)\b", 1), F.regexp_extract(t, r"\b(\d{1,4})\s+(jours?|mois|ans?|annees?)\b", 2)
    return F.when(n == "", None).otherwise(n.try_cast("int") * F.when(unit == "mois", 30).when(unit.startswith("an"), 365).otherwise(1))
