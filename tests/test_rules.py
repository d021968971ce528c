"""Rule cascades with the domain's own French rules, one row per branch."""

import re

import pytest
from pyspark.sql import functions as F

from regulith.functions import text as tx
from regulith.operators import cascades as ca
from regulith.operators import requirement_rules as rr
from regulith.rules import fr, fr_ocr

# The golden gate cases: title, preview, articles, policy, reasons.
GATE = [
    ("Décret n° 2026-12 fixant les modalités d'application", "Le présent décret fixe les modalités d'application, les obligations de transmission et les délais.", 18, "EXTRACT_FULL", None),
    ("Arrêté portant ouverture d'un concours interne", "Le concours est ouvert aux candidats remplissant les conditions d'ancienneté.", 9, "EXTRACT_LIMITED", ["DOC_CONCOURS_PROCEDURAL"]),
    ("Sommaire", "Sommaire, avis et communications, index éditorial du numéro.", 0, "DROP", ["DOC_SUMMARY_NOTICE"]),
    ("Décision publiée uniquement en langue arabe", "Le texte est publié uniquement en arabe.", 1, "TO_VALIDATE_SOURCE_MISSING", ["DOC_SOURCE_ARABIC_ONLY"]),
    ("Annexe tarifaire des contributions", "Annexe, tableau des tarifs par type d'analyse et montant en dinars.", 4, "EXTRACT_LIMITED_DATA", ["DOC_ANNEX_TABLE_DATA"]),
    ("Décret n° 2020-11", "", 3, "EXTRACT_FULL", ["DOC_STRONG_REGULATORY_TITLE"]),
    ("Texte", "L'exploitant doit agir. Lorsque nécessaire, il doit informer.", 25, "EXTRACT_FULL", ["DOC_LONG_NORMATIVE_ACT"]),
    ("Acte", "Monsieur Ali est nommé chef de service.", 1, "DROP", ["DOC_INDIVIDUAL_ACT", "DOC_NAMED_PERSON"]),
    ("Acte", "Elle est nommée cheffe; fin: démission acceptée.", 1, "DROP", ["DOC_INDIVIDUAL_ACT"]),
    ("Acte", "La commission se réunit.", 1, "EXTRACT_LIMITED", ["DOC_COMMISSION_GOVERNANCE"]),
    ("Acte", "L'exploitant doit agir.", 1, "EXTRACT_FULL", ["DOC_DEFAULT_NORMATIVE"]),
    ("Acte", "Rien de tel.", 1, "EXTRACT_FULL", ["DOC_DEFAULT_CONSERVATIVE"]),
]


def test_document_gate(spark):
    df = spark.createDataFrame([(i, *g[:3]) for i, g in enumerate(GATE)], "i int, title string, preview string, articles int")
    got = df.select("i", ca.document_gate(F.col("title"), F.col("preview"), F.col("articles")).alias("g")).orderBy("i").collect()
    for r, g in zip(got, GATE, strict=True):
        assert r.g.policy == g[3], g
        assert g[4] is None or list(r.g.reasons) == g[4], g


UNITS = [
    ("L'exploitant doit tenir un registre.", "HIGH", True),
    ("IL EST INTERDIT DE FUMER. Les zones sont interdites.", "HIGH", True),
    ("On entend par déchet toute substance.", "DROP", False),
    ("Les redevances sont fixées par arrêté.", "HIGH", False),
    ("Sommaire", "DROP", False),
    ("Le prestataire évalué adresse un rapport; monsieur Ben Ali est nommé.", "LOW", False),
    ("", "DROP", False),
    ("Une phrase quelconque sans indice.", "LOW", False),
]


def test_unit_classes(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(UNITS)], "i int, text string")
    got = ca.classify_units(df).orderBy("i").collect()
    for r, u in zip(got, UNITS, strict=True):
        assert (r.unit.priority, r.unit.strong) == u[1:], (u, r.unit)
    assert got[6].unit.rules == ["EMPTY_UNIT"] and "NORM:REGISTRE" in got[0].unit.rules
    odd = ca.classify_units(df.filter("i = 7"), label=F.lit("Annexe 2"), source=F.lit("list_block")).first().unit
    assert {"CTX:LIST_BLOCK", "CTX:NON_ARTICLE_LABEL"} <= set(odd.rules) and odd.score < got[7].unit.score


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    n = lambda s: F.lit(s)
    assert one(spark, tx.fold(n("  ÉVALUÉ\n à  Façon "))) == "evalue a facon"
    assert [one(spark, tx.article_code(n(s))) for s in ("Art. 70 (bis)", "Article 6.2", "article premier", "Annexe", "ART. 3 - x")] == ["70-bis", "6-2", "1", "", "3"]
    assert one(spark, tx.to_int(n(" 1 250 pers."))) == 1250 and one(spark, tx.to_int(n("x"))) is None
    assert one(spark, tx.to_float(n("3,5 %"))) == 3.5
    assert str(one(spark, tx.to_date(n("05/03/2024")))) == "2024-03-05" and one(spark, tx.to_date(n("soon"))) is None
    assert one(spark, tx.to_bool(n("OUI"))) is True and one(spark, tx.to_bool(n("?"), True)) is True
    assert one(spark, tx.to_list(n("a | b;c,\n"))) == ["a", "b", "c"]
    assert one(spark, tx.truncate_sentence(n("One. Two three four."), 10)) == "One."
    assert one(spark, tx.slug(n("Taux % d'Été!"))) == "taux_pct_d_ete"
    assert one(spark, tx.weighted_mean([(F.lit(1.0), 0.5), (F.lit(None).cast("double"), 0.3), (F.lit(0.0), 0.5)])) == 0.5
    assert one(spark, tx.distinct_strings(F.array(*map(F.lit, ["A", "a ", "", "b", "c"])), 2)) == ["A", "b"]
    assert one(spark, tx.clean_json(n('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert str(one(spark, tx.effective_date(n("à compter du 1er août 2023"), fr.MONTHS))) == "2023-08-01"
    assert str(one(spark, tx.effective_date(n("dès le 3/4/71"), fr.MONTHS))) == "1971-04-03"
    assert [one(spark, tx.delay_days(n(s))) for s in ("3 mois", "2 ans", "10 jours", "-")] == [90, 730, 10, None]
    assert one(spark, tx.strip_header(n("Article 5 - L'exploitant"))) == "L'exploitant"
    assert one(spark, tx.entities(n("a &lt; b &amp;amp;"))) == "a < b &amp;"


def test_legal_normaliser(spark):
    raw = "Jour­nal​ ‘x’ œuvre exploi-\n tant  a|b ,\n\n\n\n12\nJORT page\nfin"
    got = one(spark, tx.legal_normal(F.lit(raw)))
    assert got.startswith("Journal 'x' oeuvre exploitant alb,") and got.endswith("fin") and "JORT" not in got and "12" not in got
    once = one(spark, tx.legal_normal(F.lit(raw), compose=True))
    assert one(spark, tx.legal_normal(F.lit(once), compose=True)) == once
    assert one(spark, tx.legal_counts(F.lit(raw))).soft_hyphen == 1


@pytest.mark.parametrize(("parts", "want"), [((0.9, 0.9, 1.0, 1.0, 0.9, 0.0), "DRAFT"), ((0.5, 0.5, 0.6, 0.6, 0.6, 0.0), "TO_VALIDATE"), ((0.2, 0.1, 0.2, 0.2, 0.3, 0.2), "REJECT")])
def test_quality(spark, parts, want):
    assert one(spark, ca.quality(*map(F.lit, parts))).decision == want


def test_policies(spark):
    lit = F.lit
    assert one(spark, ca.gap_severity(lit("IMPERATIF"), lit("INTERDICTION"), lit("SST"), lit(False), lit(10))).severity == "CRITIQUE"
    assert one(spark, ca.gap_severity(lit("CONDITIONNEL"), lit("OBLIGATION"), lit("X"), lit(False), lit(400))).severity == "MAJEURE"
    assert one(spark, ca.merged_priority(lit("BASSE"), lit("MAJEURE"))) == "HAUTE" and one(spark, ca.merged_priority(lit("URGENTE"), lit("MINEURE"))) == "URGENTE"
    p = one(spark, ca.age_policy(lit("CONFORME"), lit(0.9), lit(True)))
    assert (p.status, p.score) == ("PARTIELLEMENT_CONFORME", 0.59)
    g = one(spark, ca.quality_gate(lit("APPLICABLE"), lit(0.7), lit(True), lit(0.5)))
    assert (g.status, g.confidence) == ("INCERTAIN", 0.55)
    assert one(spark, ca.future_gate(lit("APPLICABLE"), lit("2030-01-01"), lit("2026-01-01"))) == "APPLICABLE_FUTUR"
    assert one(spark, ca.headcount_rule(lit(50), lit(None).cast("int"), lit(20))).status == "NON_APPLICABLE"
    assert one(spark, ca.headcount_rule(lit(None).cast("int"), lit(None).cast("int"), lit(20))) is None
    assert one(spark, ca.normative_strength(lit("OBLIGATION"), lit("il peut"), r"\bpeut\b", r"\bsi\b", r"\bdoit\b")) == "FACULTATIF"
    assert one(spark, ca.kpi_intent(lit("Quel est le taux de conformité ?"))) == "COMPLIANCE_RATE" and one(spark, ca.kpi_intent(lit("Bonjour"))) is None
    assert one(spark, ca.question_depth(lit("Que dit l'article 12 du décret sur la gestion des déchets ?"))) == 4
    assert one(spark, ca.log_error(lit("psycopg2: connection refused"))) == "DATABASE"
    assert one(spark, ca.promotion(lit("TO_VALIDATE"), lit("AUTRE"), [])).reason == "TYPE_NOT_ALLOWED"
    assert one(spark, ca.skip_unit("SHADOW", lit("DROP"), lit(False))) == "SHADOW_SKIP" and one(spark, ca.skip_unit("CONSERVATIVE", lit("DROP"), lit(True))) == "KEEP_RISK"


ARTICLES = [
    ("Sommaire", "", "x", "DROP"),
    ("Art. 1", "Le présent décret fixe les règles.", "EXTRACT_FULL", "DROP"),
    ("Art. 2", "Madame Leila, mise fin aux fonctions.", "EXTRACT_FULL", "DROP"),
    ("Art. 3", "Le tableau des tarifs.", "EXTRACT_FULL", "EXTRACT_LIMITED_DATA"),
    ("Art. 4", "Le tableau des tarifs doit être affiché.", "EXTRACT_FULL", "EXTRACT_FULL"),
    ("Note", "Le tableau est fixé lorsque prévu.", "EXTRACT_FULL", "EXTRACT_LIMITED"),
    ("Art. 5", "Le concours est ouvert.", "EXTRACT_FULL", "EXTRACT_LIMITED"),
    ("Art. 6", "La commission doit se réunir.", "EXTRACT_FULL", "EXTRACT_FULL"),
    ("Art. 7", "L'exploitant doit agir.", "EXTRACT_LIMITED", "EXTRACT_FULL"),
    ("Art. 8", "Rien de tel.", "EXTRACT_LIMITED", "EXTRACT_LIMITED"),
    ("Art. 9", "Rien de tel. " * 80, "EXTRACT_LIMITED", "EXTRACT_FULL"),
    ("Art. 10", "Rien de tel.", "EXTRACT_LIMITED_DATA", "EXTRACT_LIMITED_DATA"),
    ("Art. 11", "Rien de tel.", "EXTRACT_FULL", "EXTRACT_FULL"),
]


def test_article_gate(spark):
    df = spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(ARTICLES)], "i int, label string, text string, policy string")
    got = df.select("i", ca.article_gate(F.lit("Acte"), F.col("label"), F.col("text"), F.col("policy")).alias("g")).orderBy("i").collect()
    assert [r.g.policy for r in got] == [a[3] for a in ARTICLES]


def test_routing(spark):
    lit = F.lit
    assert one(spark, ca.routed_levels(lit("X"), lit("Y"), lit("Dans chaque établissement et atelier"), {}, {})) == ["SITE", "ACTIVITY"]
    assert one(spark, ca.routed_levels(lit("X"), lit("Y"), lit("rien"), {}, {})) is None


def test_requirement_types_and_domains(spark):
    from regulith.plans.requirements import domains
    from regulith.rules.fr_examples import SENTENCES

    from regulith.plans.requirements import views_of

    rows = spark.createDataFrame([(i, r, s, s, m) for i, (r, s, m, _) in enumerate(SENTENCES)], "i int, r string, s string, c string, m string")
    got = {r.i: r for r in domains(views_of(rows)).collect()}
    assert {i: r.kind for i, r in got.items()} == {i: s[3] for i, s in enumerate(SENTENCES)}
    at = {s[0][:20]: got[i] for i, s in enumerate(SENTENCES)}
    area = {k: (r.domain, r.sub_domain, r.strategy) for k, r in at.items()}
    assert area["Il est interdit de f"] == ("JURIDIQUE_GENERAL", "INTERDICTIONS", "rule")
    assert area["Les pièces justifica"][2] == "noise_guard" or area["Les pièces justifica"] == ("ADMINISTRATIF", "DOCUMENTATION", "rule")
    assert area["La commission est co"][:2] == ("GOUVERNANCE", "ORGANISATION")
    assert area["Le jury est chargé d"] == ("GOUVERNANCE", "RESPONSABILITES", "rule")
    assert area["L'exploitant doit ne"] == ("JURIDIQUE_GENERAL", "OBLIGATIONS_LEGALES", "rule")
    assert area["En cas de fermeture,"] == ("JURIDIQUE_GENERAL", "CONDITIONS_REGLEMENTAIRES", "rule")
    assert area["registre"] == ("UNMAPPED", "UNMAPPED", "noise_guard")
    assert area["La couleur des murs "] == ("JURIDIQUE_GENERAL", "INTERDICTIONS", "type_fallback")
    assert area["Le plan de préventio"][0] == "QHSE"


def test_error_families(spark):
    from regulith.operators import requirement_rules as rr
    from regulith.plans.requirements import ERRORS
    from regulith.rules.fr_requirements import FAMILY_FIX

    rows = spark.createDataFrame([(i, f, ["SEEN", r], v, t, s) for i, (f, r, v, t, s, _) in enumerate(ERRORS)], "i int, f string, r array<string>, v string, t boolean, s boolean")
    got = {r.i: r.x for r in rows.select("i", rr.error_family(*map(rows.__getitem__, "frvts")).alias("x")).collect()}
    for i, e in enumerate(ERRORS):
        assert (got[i] and got[i].family) == e[5]
        assert got[i] is None or got[i].fix == FAMILY_FIX.get(e[5])


def test_acts(spark):
    from regulith.operators import acts
    from regulith.rules.fr_examples import ISSUES

    titles = [[a[0] for a in acts.acts_of(x)] for x in ISSUES]
    assert titles[0] == ["Décret n° 12-2020 du 3 mai", "Arrêté du ministre du 4 mai"]
    assert titles[1] == ["Arrêté du ministre du 5 mai fixant les modalités"] and titles[2] == ["DOCUMENT"]
    assert titles[3] == ["Décret n° 8-2021 du 2 juin", "Arrêté du 9 juin"] or titles[3][0] == "Loi n° 7-2021 du 1er juin"
    qualified = "Décision du chef\nArticle premier - Le port est clos le soir.\nConvention n° 7 du port\nArticle 1 - La taxe est due.\nRèglement fixant les prix\nArticle 1 - Le prix est de dix.\nRèglement intérieur affiché au port\nCirculaire relative aux quais\nArticle 1 - Le quai est lavé."
    assert [a[0] for a in acts.acts_of(qualified)] == ["Décision du chef", "Convention n° 7 du port", "Règlement fixant les prix", "Circulaire relative aux quais"]
    assert all(x[s:e].strip().startswith(t[:5]) for x in ISSUES for t_, s, e, t in acts.acts_of(x) if x)
    found = spark.createDataFrame([(a[0], a[3]) for x in ISSUES for a in acts.acts_of(x)], "t string, x string").select("t", acts.individual("t", "x").alias("i"))
    assert {r.t for r in found.collect() if r.i} == {"Arrêté du ministre du 4 mai", "Arrêté du 9 juin"}


def test_stale_jobs(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from regulith.plans.requirements import stale

    now = dt.datetime(2024, 1, 2, 12)
    rows = [("RUNNING", now - dt.timedelta(hours=12)), ("RUNNING", now - dt.timedelta(hours=13)), ("DONE", None), ("QUEUED", None)]
    df = spark.createDataFrame(rows, "s string, t timestamp")
    assert [r.x for r in df.select(stale(F.col("s"), F.col("t"), F.lit(now)).alias("x")).collect()] == [False, True, False, True]


LEGAL = [
    ("word_digit", "le seu1il des rejets", "le seuil des rejets"),
    ("duplicate_modal", "Il do doit agir", "Il doit agir"),
    ("inline_heading", "les rejets Chapitre IV - sont limités", "les rejets sont limités"),
    ("fused_modal", "L'exploitantdoit agir", "L'exploitant doit agir"),
    ("space_after", "Vu;fin", "Vu; fin"),
    ("space_before", "fin ;", "fin;"),
    ("arabic", "a ب b", "a b"),
    ("page_number", "a\n - 12 -\nb", "a\n\nb"),
    ("page_header", "a\nJORT du jour\nb", "a\n\nb"),
    ("hyphen_linebreak", "exploi-\r\ntant", "exploitant"),
]


@pytest.mark.parametrize(("step", "raw", "want"), LEGAL)
def test_legal_steps(spark, step, raw, want):
    assert one(spark, tx.legal_normal(F.lit(raw), compose=True)) == want
    assert one(spark, tx.legal_counts(F.lit(raw), compose=True))[step] == 1


def test_counters_read_what_the_step_gets(spark):
    got = one(spark, tx.legal_counts(F.lit("a” ­ ,b"), compose=True))
    assert (got.punctuation, got.soft_hyphen, got.space_before, got.space_after, got.space_run) == (1, 1, 1, 1, 0)


def plain(pattern):
    """The pattern and flags for Python's engine, whose classes are Unicode and lines end in line feeds by default."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    letters = "".join(f for f in (flags.group(1) if flags else "") if f in "im")
    return (f"(?{letters})" if letters else "") + (pattern[flags.end() :] if flags else pattern)


def test_patterns_in_two_engines(spark):
    """Every pattern finds in Spark what it finds in Python, over all samples and their joins."""
    samples = [r for _, r, _ in LEGAL] + [r for r, _ in SANITISED if r]
    samples += ["\n".join(samples), " ".join(samples), "Le bureau d'ordre des services et du ministère de l'administration prend en charge les a, les b, les c et intérêts"]
    patterns = [p for _, p, _ in fr_ocr.LEGAL_STEPS] + [p for p, _ in fr_ocr.LINE_REPAIRS + fr_ocr.INLINE_NOISE] + [*fr_ocr.SIGNALS, fr_ocr.SUSPICIOUS_TOKEN, fr_ocr.HARD_BREAK, fr_ocr.PAGE_LINE, fr_ocr.PAGE_MENTION, fr_ocr.SIGNATURE_LINE, fr_ocr.PERSON_LINE, fr_ocr.NAME_LINE, fr_ocr.NORMATIVE_KEEP, fr_ocr.NAME_LIST, fr_ocr.SIGNED_ON]
    df = spark.createDataFrame([(s,) for s in samples], "s string").coalesce(1)
    got = df.select(*[F.regexp_replace("s", p, "<>").alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for s, row in zip(samples, got, strict=True):
        for p, x in zip(patterns, row, strict=True):
            assert x == re.sub(plain(p), "<>", s), (p, s)


SANITISED = [
    (None, ""),
    ("  \n ", ""),
    ("L'exploitant doit agir. Tunis, le 3 mars 2020", "L'exploitant doit agir."),
    ("Texte utile. Le ministre de la santé", "Texte utile."),
    ("Le ministre doit: agir.", "Le ministre doit: agir."),
    ("Texte utile. Le ministre doit agir.", "Texte utile. ."),
    ("Il paie. Monsieur ali est là", "Il paie."),
    ("Texte. N° 12 du Journal Officiel", "Texte."),
    ("Texte. Page 3 du journal officiel suite", "Texte."),
    ("prévus par les Ahmed Salah articles 3", "prévus par les articles 3"),
    ("Les crédits Ahmed Salah de campagne", "Les crédits de campagne"),
    ("un vu susvisé", "un susvisé"),
    ("le rejetEst limité", "le rejet Est limité"),
    ("Sont là: Sfax, Tunis, Gabes, Sousse", "Sont là"),
    ("  - l'exploitantdoit do doit agiragir", "l'exploitant doit doit agir"),
    ("Article - Le texte", "Le texte"),
]


@pytest.mark.parametrize(("raw", "want"), SANITISED)
def test_sanitise(spark, raw, want):
    assert one(spark, tx.sanitize(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "share", "heavy"), [("", 0.0, False), ("mot abc1 mot mot", 0.25, True), ("un deux trois quatre cinq six sept huit neuf abc1", 0.1, True), ("un deux trois quatre cinq six sept huit neuf dix onze abc1", 0.0833, False), ("maisonmaison mot", 0.5, True), ("teXTte mot", 0.5, True), ("...", 0.0, False)])
def test_ocr_share(spark, raw, share, heavy):
    assert (one(spark, tx.ocr_share(F.lit(raw))), one(spark, tx.ocr_heavy(F.lit(raw)))) == (share, heavy)


DECIDED = [
    ("Au moins 40 salariés sont requis.", 40, "", "", "", "APPLICABLE|0.96|EFFECTIF_MIN_MATCH"),
    ("Entreprise de 300 travailleurs ou plus.", 299, "", "", "", "NON_APPLICABLE|0.96|EFFECTIF_MIN_MISMATCH"),
    ("Moins de 50 employés.", 50, "", "", "", "APPLICABLE|0.95|EFFECTIF_MAX_MATCH"),
    ("Moins de 50 employés.", 51, "", "", "", "NON_APPLICABLE|0.95|EFFECTIF_MAX_MISMATCH"),
    ("Moins de 50 employés.", None, "", "", "", None),
    ("Les entreprises du secteur textile.", 5, "Filature", "", "", "APPLICABLE|0.91|SECTOR_MATCH"),
    ("Les entreprises du secteur textile.", 5, "Transport", "", "", "NON_APPLICABLE|0.90|SECTOR_MISMATCH"),
    ("Les entreprises du secteur textile ou laitier.", 5, "Transport", "", "", None),
    ("Les entreprises du secteur textile.", 5, "Conseil", "", "", None),
    ("Chaque solvant est noté.", 5, "", "acide", "", "APPLICABLE|0.88|CHEMICAL_EXPOSURE_MATCH"),
    ("Le harnais est obligatoire.", 5, "", "", "montage en hauteur", "APPLICABLE|0.86|TRAVAUX_EN_HAUTEUR"),
    ("Le harnais est obligatoire.", 5, "", "", "compresseur", None),
    ("Le ministre fixe la liste. L'employeur la lit.", 5, "", "", "", "NON_APPLICABLE|0.95|INSTITUTIONAL_ACTOR_MISMATCH"),
    ("Le ministre informe l'employeur.", 5, "", "", "", None),
    ("", 5, "", "", "", None),
    (None, None, None, None, None, None),
]


@pytest.mark.parametrize(("req", "n", "sector", "chemicals", "means", "want"), DECIDED)
def test_applicability(spark, req, n, sector, chemicals, means, want):
    row = spark.range(1).select(rr.plain(F.lit(req).cast("string")).alias("req"), F.lit(n).cast("int").alias("headcount"), *[rr.plain(F.lit(v).cast("string")).alias(k) for k, v in (("sector", sector), ("chemicals", chemicals), ("means", means))])
    assert row.select(rr.spark_sql(rr.applicability("req", "headcount", "sector", "chemicals", "means"))).first()[0] == want
