"""What a text gives is made once, however often it is asked for."""

import random

from pyspark.sql import functions as F

from regulith.functions import text as tx
from regulith.operators import acts, articles, citations, grouping
from regulith.plans import segments
from regulith.rules import fr_articles, fr_ocr, fr_snippets

D = "/root/testdata/sf0.001"


def test_acts_are_split_once_behind_the_dealing(spark):
    plan = segments.legal_articles(spark, D)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    split = [i for i, x in enumerate(plan) if "ArrowEvalPython" in x and "split_acts" in x]
    dealt = [i for i, x in enumerate(plan) if "RepartitionByExpression" in x]
    # plans are printed from the top: what is above is done later
    assert len(split) == len(dealt) == 1 and split < dealt


def test_heads_are_made_plain_once(spark):
    x = spark.createDataFrame([("t", "x")], "t string, x string").select(acts.individual("t", "x").alias("i"))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2


def test_blanks_and_edges_as_before(spark):
    texts = ["", " ", "\t", "a\tb", "a  b", "a \t\n\n\n\nb ", " a  b\u0085", "­a ­ b￾", "a\u000b\fb\r\n", " a 　", "x1y Aa2 12abc a1 aB éÀ àB. C"]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    old = lambda c, steps: c if not steps else old(F.regexp_replace(c, *steps[0]), steps[1:])
    digit = r"(?U)(?:(?<=[A-Za-zÀ-ÿ])\d+(?=[A-Za-zÀ-ÿ])|(?<=[A-Za-zÀ-ÿ]{3})\d+\b|\b\d+(?=[A-Za-zÀ-ÿ]{3}))"
    pairs = [
        (tx.spaces("t"), F.trim(F.regexp_replace("t", r"[ \t\n\r\f\x0B]+", " "))),
        (tx.single_spaced("t"), old(F.translate("t", " ", " "), [(r"[ \t]+", " "), (r"\n{2,}", "\n"), (r"(?U)\A\s+|\s+\z", "")])),
        (articles._normal(F.col("t")), old(F.translate("t", " ­￾", " "), [(r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")])),
        (F.regexp_replace("t", fr_ocr.WORD_DIGIT, ""), F.regexp_replace("t", digit, "")),
        (F.regexp_replace("t", *fr_ocr.INLINE_NOISE[-1]), F.regexp_replace("t", r"([a-zàâäéèêëîïôöùûüç])([A-ZÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ])", "$1 $2")),
        (F.regexp_replace("t", *tx.WHITES), F.regexp_replace("t", r"(?U)\s+", " ")),
    ]
    for r in x.select(*[c.alias(f"{k}{i}") for i, p in enumerate(pairs) for k, c in zip("ab", p, strict=True)]).collect():
        for i in range(len(pairs)):
            assert r[f"a{i}"] == r[f"b{i}"], (i, r)


def test_windows_that_reach_no_further_are_read_once(spark):
    head = "Article 5 -\nLe paiement est dû"
    rest = " lorsque le fonds national de garantie prend en charge les intérêts. Le bénéficiaire doit rembourser sous réserve de ses droits."
    far = head + rest + " Le titulaire doit payer." * 200
    rows = [("Article 5 -", len(head), "Vu le code. ", b, head) for b in (head + rest, far)]
    got = [r.text for r in articles.repaired(spark.createDataFrame(rows, "header string, chars int, before string, behind string, text string")).collect()]
    assert got[0].endswith("ses droits.") and len(got[1]) > len(got[0]) and fr_articles.NORMATIVE


def test_candidates_are_read_once(spark):
    x = spark.createDataFrame([("a", "b", "c")], "requirement string, snippet string, chunk string")
    plan = citations.best_citation(x)._jdf.queryExecution().optimizedPlan().toString()
    rated = next(p for p in plan.split("\n") if "_best" in p and "INSET" not in p and "array_intersect" in p)
    # the candidate's words, cues of conditions and of norms are looked for in one lower case
    assert rated.count("lower(") == 1 and "regexp_replace" not in rated


SAID = ["le ministre", "La Cheffe du gouvernement", "Monsieur Salah Ben", "m. Ali Ben", "par les Ali Ben articles", "crédits Ali Ben de campagne", "vu susvisée", "prend en charge a, b, c et intérêts", "do doit", "a chapitre iv - a", "xest tenu de", "mdoit", "finterdit", "apeuvent", "xcommuniqué", "ntransmet", "dadresse", "Tunis, le 3 mai 2020", "Article 3 -", "art. 4 -", "n° 5 journal officiel", "il il", "elle elle", "titre ii", "sous-section 1", "arrêté n° 3", "Décision n° 4", "règlement organique", "vu", "arrête :", "par décret du jour. ", "page 3", "no 7", "bureau d'ordre du quai, du port et du marché de l'administration", "mot", ". ", "; "]


def test_words_that_matches_hold(spark):
    g = random.Random(5)
    odd = str.maketrans({"i": "ı", "s": "ſ", "k": "K", "I": "İ"})
    bend = lambda t: g.choice((t, t.upper(), t.title(), t.translate(odd), t.upper().translate(odd)))
    texts = [bend(t) for t in SAID for _ in range(6)] + [" ".join(bend(g.choice(SAID)) for _ in range(g.randrange(1, 7))) for _ in range(600)]
    known = [*fr_ocr.WORDS.items(), *((p, w) for p, _, w in fr_snippets.DOUBLED), *((p, w) for p, w in zip(fr_articles.HARD_BREAKS, fr_articles.HARD_BREAK_WORDS, strict=True) if w)]
    known += [(fr_articles.BRIDGE, fr_articles.BRIDGE_WORDS), (fr_articles.ACT_TITLE, fr_articles.ACT_WORDS), (fr_articles.MAJOR_HEADING, fr_articles.HEADING_WORDS)]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    cols = [F.struct(F.col("t").rlike(p).alias("m"), tx.may_match(F.col("t"), w).alias("w")).alias(f"p{i}") for i, (p, w) in enumerate(known)]
    issue = F.struct(F.col("t").rlike(fr_articles.GAZETTE).alias("m"), (tx.may_match(F.col("t"), fr_articles.GAZETTE_WORDS) | F.col("t").rlike(fr_articles.NUMBERED_ISSUE)).alias("w")).alias("p")
    rows = x.select(*cols, issue).collect()
    for i, (p, _) in enumerate([*known, (fr_articles.GAZETTE, ())]):
        assert any(r[i].m for r in rows), p
        assert all(r[i].w for r in rows if r[i].m), p
    assert not all(c.w for r in rows for c in r)


def test_sanitised_as_with_every_pattern_tried(spark, monkeypatch):
    g = random.Random(6)
    texts = [" ".join(g.choice(SAID) if g.random() < 0.2 else g.choice(("mot1", "le quai", "Ali", "aB", "doitdoit", "\n", "x2y", "dmi1nistre")) for _ in range(g.randrange(1, 30))) for _ in range(300)]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    made = lambda: x.select(tx.sanitize("t").alias("s"), citations.cleaned("t").alias("c"), articles.until_signature("t").alias("u"))
    got = [tuple(r) for r in made().collect()]
    monkeypatch.setattr(tx, "may_match", lambda x, words: F.lit(True))
    assert got == [tuple(r) for r in made().collect()]


def test_texts_spaced_already_are_left(spark):
    texts = ["", " ", "a", " a b ", "a  b", "a\tb", "a\nb", "a\r\nb ", "\x0ba", "a\fb", "a b", "x1 y  ,"]
    x = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    rows = x.select(tx.respaced(F.col("t")).alias("a"), tx.spaces("t").alias("b"), tx.ocr_repaired("t").alias("c"), tx.ocr_repaired(tx.single_spaced("t")).alias("d")).collect()
    assert all(r.a == (r.b if i < len(texts) else None) and r.c == r.d for i, r in enumerate(rows))


def test_cues_and_chains_where_a_source_may_hold_them(spark, monkeypatch):
    g = random.Random(8)
    bits = [*SAID, "sauf", "si le vent tombe", "lorsque", "en cas", "de", "sous réserve", "à condition", "doit fermer", "et est séché", "et ouvrir", "est habilité à", "le quai du port,", ". ", "; "]
    say = lambda n: " ".join(g.choices(bits, k=n))
    x = spark.createDataFrame([(say(4), say(g.randrange(0, 8)), say(g.randrange(0, 16))) for _ in range(200)], "requirement string, snippet string, chunk string")
    got = [tuple(r) for r in citations.best_citation(x).collect()]
    monkeypatch.setattr(tx, "may_match", lambda x, words: F.lit(True))
    assert got == [tuple(r) for r in citations.best_citation(x).collect()]


def test_ratios_are_taken_as_long_as_one_may_be_larger(monkeypatch):
    g = random.Random(9)
    say = lambda: " ".join(g.choices(["le", "registre", "doit", "être", "tenu", "Port.", ""], k=g.randrange(0, 8)))
    for _ in range(500):
        text, others = say(), [say() for _ in range(g.randrange(0, 6))]
        assert grouping.best_ratio(text, others, {}) == max((grouping.ratio(text, o) for o in others), default=0.0)
    asked = []
    monkeypatch.setattr(grouping, "ratio", lambda a, b: asked.append(b) or 1.0)
    assert grouping.best_ratio("le registre", ["xyz", "Le  registre", "wvu", "le registre"], {}) == 1.0 and asked == ["le registre"]
