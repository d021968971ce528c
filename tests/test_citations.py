"""Citations against a plain search of the lattice, chains of actions, fall-backs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from regulith.operators import citations as ci
from regulith.rules import fr_snippets as fr


def rx(pattern):
    """A Java pattern as Python reads it: Unicode and case flags, its letters' own classes."""
    m = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    return re.compile(pattern[m.end() :] if m else pattern, re.I if m and "i" in m[1] else 0)


def edged(x):
    return " ".join(x.split()).strip(" ,;:-")


def parts(x, pattern, clean=edged):
    return [y for p in rx(pattern).split(x) if (y := clean(p))]


def chain(sentence):
    s, out = edged(sentence), []
    item = lambda x: " ".join(x.split()).strip(" .;")
    if m := rx(fr.AUXILIARY_CHAIN).match(s):
        one, two = item(m[3]), item(m[5])
        if one and two and one.lower() != two.lower():
            out += [f"{m[1]} {m[2]} {one}.", f"{m[1]} {m[4]} {two}."]
    if m := rx(fr.MODAL_CHAIN).match(s):
        for pattern in (fr.LIST_SPLIT, fr.AND_SPLIT, fr.COMMA_SPLIT):
            found = parts(item(m[2]), pattern, item)
            if len(found) >= 2:
                break
        else:
            found = []
        for p in found:
            bare = " ".join(re.sub(fr.ITEM_SIGN, "", p).split())
            if rx(fr.MODAL).search(bare):
                out.append(bare)
            elif bare:
                bare = rx(fr.LINK).sub("", bare) if rx(fr.LINK_END).search(m[1]) else bare
                out.append(f"{m[1]} {bare[:1].lower()}{bare[1:]}")
    seen, kept = set(), []
    for p in out:
        key = p.strip(" .;,:").lower()
        if key and key not in seen:
            seen.add(key)
            kept.append(p.rstrip(".") + ".")
    return kept


def lattice(text):
    if not text:
        return []
    out = [text]
    for s in parts(text, fr.SENTENCE_SPLIT):
        clauses = [c for p in parts(s, fr.CLAUSE_SPLIT) for c in parts(p, fr.INLINE_SPLIT)]
        out += [s, *chain(s)]
        intro, head = "", (clauses or [s])[0]
        if m := rx(fr.INTRO_CUE).search(head):
            before = head[: m.start()].strip(" ,;:-")
            if len(before) >= 18 and any(k in before.lower() for k in fr.INTRO_MARKERS):
                intro = before
        for i, c in enumerate(clauses):
            out += [c, *chain(c)]
            if i and intro:
                bare = re.sub(r"(?i)^(?:et|ou)\s+", "", c).strip()
                out.append(bare if bare.lower().startswith(intro.lower()) else f"{intro} {bare}")
            if i + 1 < len(clauses):
                out.append(f"{c}; {clauses[i + 1]}")
    return out


def tokens(x):
    return {w for w in re.findall(fr.TOKEN, x.lower()) if w not in fr.STOP}


def cite(req, src, chunk):
    req, src, chunk = ("" if x is None else " ".join(x.split()) for x in (req, src, chunk))
    need = any(c in req.lower() for c in fr.CONDITION_CUES)
    want = tokens(req)

    def score(x):
        t = edged(x)
        if len(t) < 15:
            return -1.0
        s = len(want & tokens(t)) / len(want) if want else 0.0
        s += 0.12 * (need and any(c in t.lower() for c in fr.CONDITION_CUES)) + 0.04 * any(c in t.lower() for c in fr.NORM_CUES)
        if len(req) >= 40:
            r = len(t) / len(req)
            s -= 0.05 * (r > 1.8) + 0.08 * (r > 2.4) + 0.04 * (r < 0.35)
        return round(s - 0.12 * bool(rx(fr.DANGLING_END).search(t)) - 0.03 * (len(t) > fr.MOST), 4)

    ranked = sorted(((-score(t), len(t), i, t) for i, t in enumerate(dict.fromkeys(" ".join(x.split()) for x in lattice(src) + lattice(chunk)))))
    best = ranked[0] if ranked else (0.0, 0, 0, "")
    value = edged(best[3] if -best[0] >= 0.18 else src or chunk)
    limit = min(420, max(320, len(req) + 32)) if len(req) >= int(280 * 0.82) else 280
    if len(value) > limit:
        ahead = [p for m in ("; ", ". ", ": ", ", ") if 0 < (p := value.find(m, 280)) <= limit]
        back = max(value.rfind(m, 0, limit) for m in ("; ", ". ", ": ", ", ", " "))
        value = (value[: min(ahead)] if ahead else value[:back] if back >= int(limit * 0.55) else value[:limit].rsplit(" ", 1)[0]).strip(" ,;:-") or value[:limit].strip(" ,;:-")
    return value, -best[0]


BITS = ["le chef", "l'employeur", "doit fermer", "doit", "est tenu de", "peut ouvrir", "la porte", "et", "et ouvrir", "de payer", ", sauf", "si", "lorsque", "en cas de", "vente", ". ", "; ", ": ", ", ", "est lavé", "et est", "sont", "au", "par", "de", "le quai du port", "registre", "dix jours", ", doit", "\n", "et sauf", "concours"]


def test_citations_against_a_plain_search(spark):
    g = random.Random(7)
    say = lambda n: " ".join(g.choices(BITS, k=n)).replace(" ,", ",").replace(" .", ".")
    rows = [(i, say(g.randrange(2, 9)), say(g.randrange(0, 16)), say(g.randrange(0, 30))) for i in range(250)]
    rows += [(900, None, None, None), (901, "", "", ""), (902, "x" * 300, "mot " * 200, ""), (903, "le chef " * 40, "port, " * 90 + "le chef doit", "y"), (904, "registre", "court", "")]
    df = spark.createDataFrame(rows, "i int, requirement string, snippet string, chunk string")
    # the plain search knows no OCR repair and no headers, so both read cleaned texts
    x = df.select("i", ci.without_leading("requirement").alias("requirement"), ci.cleaned("snippet").alias("snippet"), ci.cleaned("chunk").alias("chunk"))
    bad = 0
    for r in ci.best_citation(x).collect():
        want = cite(r.requirement, r.snippet, r.chunk)
        assert r.citation_score == pytest.approx(want[1], abs=1.1e-4), (r, want)
        bad += r.citation != want[0]
    assert bad <= 3  # scores that differ in the fifth place may rank two candidates otherwise


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Le quai est lavé par l'agent et est séché par le chef.", ["Le quai est lavé par l'agent.", "Le quai est séché par le chef."]),
        ("L'employeur doit fermer la porte et ouvrir le toit.", ["L'employeur doit fermer la porte.", "L'employeur doit ouvrir le toit."]),
        ("Le jury est chargé de classer les offres; de fixer le prix; d) Signer le bail", ["Le jury est chargé de classer les offres.", "Le jury est chargé de fixer le prix.", "Le jury est chargé de signer le bail."]),
        ("Le chef doit laver le quai, sécher la voie", ["Le chef doit laver le quai.", "Le chef doit sécher la voie."]),
        ("Le chef doit laver le quai; il doit partir; laver le quai", ["Le chef doit laver le quai.", "il doit partir."]),
        ("Le chef doit partir.", []),
        ("Rien de tel ici.", []),
        ("", []),
    ],
)
def test_chains(spark, text, want):
    assert chain(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(ci.chained_actions(F.col("t")).alias("x")).first().x == want


def test_empty_fallback(spark):
    rows = [
        ("Article 3 - Le port est ouvert. Le chef doit tenir un registre du quai, si le vent tombe.", "Le chef doit tenir un registre du quai", "REGISTRE"),
        ("La couleur des murs du port change avec les saisons et les vents.", None, None),
        ("Il doit.", None, None),
        (None, None, None),
    ]
    got = {r.unit: (r.fallback_text, r.fallback_type) for r in ci.empty_fallback(spark.createDataFrame([(r[0],) for r in rows], "unit string")).collect()}
    assert got == {r[0]: r[1:] for r in rows if r[1]}


def test_supervision_fallback(spark):
    unit = "Le port est ouvert le jour. Le concours est supervisé par un jury du port; sa composition est fixée par le chef."
    rows = [
        (1, unit, [], unit),
        (2, unit, ["Le concours est supervisé par un jury."], None),
        (3, unit, None, unit),
        (4, "Le concours du port est supervisée par la commission. Il dure.", ["autre", None], "Le concours du port est supervisée par la commission."),
        (5, "Le concours du port est supervisé par un chef du port.", [], None),
        (6, None, [], None),
    ]
    got = {r.i: r.fallback_text for r in ci.supervision_fallback(spark.createDataFrame([r[:3] for r in rows], "i int, unit string, existing array<string>")).collect()}
    assert got == {r[0]: r[3] for r in rows if r[3]}
