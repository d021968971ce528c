"""What statements lack, scope, assessment, promotion, review, filters: a case for each branch."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from regulith.operators import postcall as pc
from regulith.operators import requirement_rules as rr
from regulith.operators.markers import Lexicon
from regulith.plans.requirements import views_of, with_filters
from regulith.rules import fr_postcall as fr
from regulith.rules import fr_requirements as frq


def test_marker_bits_against_contains(spark):
    markers = ["si ", "est interdit", "interdit", "s'engage a", "a", "é", *[f"m{i}" for i in range(130)]]
    lexicon = Lexicon(markers)
    texts = ["est interdit si m1 m12 m129", "", None, "il s'engage a m77", "nest interdite", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("t_bits", lexicon.bits(F.col("t")))
    groups = [markers[:3], markers[3:6], markers[6:], ["m1", "m128", "interdit"]]
    got = df.select("t", *[F.expr(lexicon.count("t_bits", g)).alias(f"g{i}") for i, g in enumerate(groups)]).collect()
    for r in got:
        assert [r[f"g{i}"] for i in range(len(groups))] == [sum(m in (r.t or "") for m in g) for g in groups], r.t
    assert lexicon.count("t_bits", ["absent"]) is None and lexicon.words == 3


#: Requirement, citation, chunk; what is missing.
WHOLE = [
    ("L'employeur doit afficher le plan.", "L'employeur doit afficher le plan.", "", []),
    ("L'employeur doit afficher le plan.", "Lorsque le site ferme, l'employeur doit afficher le plan.", "", ["CONDITION"]),
    ("L'employeur doit afficher le plan.", "", "L'employeur doit afficher le plan, sauf accord.", ["EXCEPTION"]),
    ("Le loueur doit vendre.", "Le loueur ne peut vendre que par écrit, par dérogation.", "", ["CONDITION", "EXCEPTION"]),
    ("L'employeur doit afficher le plan.", "Dans le cadre de la sécurité des quais, les voies sont libres.", "", ["SCOPE"]),
    ("L'employeur doit libérer les voies des quais de sécurité.", "Dans le cadre de la sécurité des quais, les voies sont libres.", "", []),
    ("Concernant les quais, l'employeur doit agir.", "Dans le cadre de la sécurité des quais, les voies sont libres.", "", []),
    ("L'employeur est tenu de notifier.", "", "", ["OBJECT"]),
    ("L'employeur est tenu d'informer.", "", "", []),
    ("Le chef doit tenir. Il part.", "", "", ["OBJECT"]),
    ("Le prix du bail est fixé par", "", "", ["TAIL"]),
    ("Le chef doit payer le loyer; il part.", "", "", ["GRANULARITY"]),
    ("La porte est close et est gardée.", "", "", ["GRANULARITY"]),
    ("Le chef doit fermer la porte et ouvrir le toit.", "", "", ["GRANULARITY"]),
    ("", "", "", []),
    (None, None, None, []),
]


def test_completeness(spark):
    df = spark.createDataFrame([(i, *w[:3]) for i, w in enumerate(WHOLE)], "i int, r string, s string, c string")
    got = pc.with_completeness(pc.with_plain(df, "r", "s", "c")).orderBy("i").collect()
    weights = dict(fr.MISSING)
    for row, w in zip(got, WHOLE, strict=True):
        g = row._whole
        assert g.missing == w[3], w
        assert g.score == round(max(0, 1 - sum(weights[n] for n in w[3])), 4)
        assert g.verdict == ("PASS", "SOFT_FAIL", "HARD_FAIL")[min(2, len(w[3]))] and g.reasons == [fr.MISSING_REASONS[n] for n in w[3]]


SCOPE = [
    ("Le présent décret sera publié au journal.", "", "OUT_OF_SCOPE_PUBLICATION", None),
    ("Le tableau annexé des parcelles est modifié.", "", "OUT_OF_SCOPE_AUTRE_DESCRIPTIVE", None),
    ("Monsieur Salah est nommé directeur du bureau.", "", "OUT_OF_SCOPE_INDIVIDUAL_ACT", None),
    ("Monsieur Salah est nommé membre du jury.", "", None, None),
    ("Monsieur Salah est nommé et doit agir.", "", None, None),
    ("Monsieur Salah est nommé au ministère.", "", None, None),
    ("Le chef, par délégation, est habilité à signer les baux.", "", "OUT_OF_SCOPE_INDIVIDUAL_ACT", None),
    ("d'entreprise - dans les ports, il part.", "", None, "OCR_CORRUPTED_CLAUSE_BLEND"),
    ("Le chef doit partir - si le port ferme, la porte est close.", "", None, "OCR_CORRUPTED_CLAUSE_BLEND"),
    ("Le chef doit partir - demain.", "", None, None),
]


def test_scope_and_blend(spark):
    df = spark.createDataFrame([(i, *w[:2], "") for i, w in enumerate(SCOPE)], "i int, r string, s string, c string")
    x = pc.with_plain(df, "r", "s", "c").withColumn("norms", pc.hit_names(F.col("_plain"), fr.NORMS))
    got = x.select("i", pc.out_of_scope().alias("o"), pc.clause_blend(F.col("norms"), F.lit(0.0)).alias("b")).orderBy("i").collect()
    assert [(r.o, r.b) for r in got] == [w[2:] for w in SCOPE]


GOOD = "L'employeur doit remettre au salarié un plan écrit de la zone de pêche numéro sept."
#: Requirement, type, citation, chunk, confidence, status, strength; decision, status, a reason that must stand there.
CASES = [
    (GOOD, "OBLIGATION", GOOD, GOOD, 0.95, "DRAFT", "IMPERATIF", "KEEP", "DRAFT", None),
    (GOOD, "OBLIGATION", GOOD, GOOD, 0.95, "TO_VALIDATE", None, "KEEP", "TO_VALIDATE", None),
    ("Va", "OBLIGATION", GOOD, GOOD, 0.95, "DRAFT", "", "DROP", "REJECT", "TOO_SHORT"),
    ("On entend par quai toute aire de pose.", "AUTRE", "On entend par quai toute aire de pose.", "On entend par quai toute aire de pose.", 0.9, "DRAFT", "", "DROP", "REJECT", "DESCRIPTIVE_WITHOUT_NORMATIVE_MARKER"),
    ("Le présent décret sera publié au recueil officiel.", "AUTRE", "", "", 0.9, "DRAFT", "", "DROP", "REJECT", "OUT_OF_SCOPE_PUBLICATION"),
    ("Monsieur Salah est nommé directeur du bureau régional.", "AUTRE", "", "", 0.9, "DRAFT", "", "DROP", "REJECT", "OUT_OF_SCOPE_INDIVIDUAL_ACT"),
    (GOOD, "INTERDICTION", GOOD, GOOD, 0.95, "DRAFT", "", "KEEP", "TO_VALIDATE", "TYPE_TEXT_MISMATCH"),
    ("La couleur des murs change avec les saisons.", "EXCEPTION", "La couleur des murs change avec les saisons.", "La couleur des murs change avec les saisons.", 0.9, "DRAFT", "", "KEEP", "DRAFT", None),
    ("Les voies des agences communiquent un rapport.", "EXCEPTION", "", "", 0.9, "DRAFT", "", "DROP", "REJECT", "GROUNDING_SNIPPET_EMPTY"),
    (GOOD, "OBLIGATION", "Le vent souffle.", "Rien.", 0.5, "DRAFT", "", "DROP", "REJECT", "GROUNDING_HARD_FAIL_DROP"),
    (GOOD, "OBLIGATION", "Le vent souffle.", "Rien.", 0.9, "DRAFT", "", "KEEP", "TO_VALIDATE", "GROUNDING_HARD_FAIL_ESCALATE_VALIDATE"),
    (GOOD, "OBLIGATION", GOOD, "autre chose", 0.95, "DRAFT", "", "KEEP", "TO_VALIDATE", "SNIPPET_NOT_IN_CHUNK"),
    (GOOD, "OBLIGATION", GOOD, GOOD, 0.45, "DRAFT", "", "KEEP", "TO_VALIDATE", "LOW_CONFIDENCE_SOFT"),
    ("La couleur des murs change avec les saisons.", "OBLIGATION", "", "La couleur des murs change avec les saisons.", 0.2, "DRAFT", "", "DROP", "REJECT", "LOW_CONFIDENCE_NON_NORMATIVE"),
    (GOOD, "OBLIGATION", GOOD[:-1] + ", sauf accord.", GOOD[:-1] + ", sauf accord.", 0.95, "DRAFT", "", "KEEP", "TO_VALIDATE", "COMPLETENESS_SOFT_FAIL_VALIDATE"),
    ("L'employeur est tenu de notifier.", "OBLIGATION", "L'employeur est tenu de notifier.", "L'employeur est tenu de notifier.", 0.95, "DRAFT", "", "DROP", "REJECT", "COMPLETENESS_MISSING_OBJECT_DROP"),
    ("Le prix du bail des quais est fixé par", "AUTRE", "Le prix du bail des quais est fixé par", "Le prix du bail des quais est fixé par", 0.95, "DRAFT", "", "DROP", "REJECT", "COMPLETENESS_DANGLING_TAIL_DROP"),
    (GOOD, "OBLIGATION", GOOD, GOOD, 0.6, "DRAFT", "FACULTATIF", "KEEP", "TO_VALIDATE", "QUALITY_THRESHOLD_VALIDATE"),
    ("Le salarié doit demander une aide au chef.", "OBLIGATION", "Le salarié peut demander une aide au chef.", "Le salarié peut demander une aide au chef.", 0.95, "DRAFT", "IMPERATIF", "KEEP", "TO_VALIDATE", "NORMATIVE_STRENGTH_SUSPECTED_OVERQUALIFIED"),
    ("Le journal officiel, page 12, section 3, dit au chef de partir.", "AUTRE", "Journal officiel page 12 section 3 chapitre 4 article 7 article 8", "x", 0.95, "DRAFT", "", "DROP", "REJECT", "OCR_SOURCE_MIXED_ARTICLE"),
    (None, None, None, None, None, None, None, "DROP", "REJECT", "TOO_SHORT"),
]
ROWS = "i int, requirement string, kind string, snippet string, chunk string, confidence double, status string, strength string"


def test_assessment(spark):
    df = spark.createDataFrame([(i, *c[:7]) for i, c in enumerate(CASES)], ROWS)
    got = pc.assess(df).orderBy("i").collect()
    for r, c in zip(got, CASES, strict=True):
        assert (r.a.decision, r.a.status) == c[7:9], (c, r.a)
        assert c[9] is None or c[9] in r.a.reasons, (c, r.a)
        assert 0 <= r.a.risk <= 1 and len(r.a.reasons) >= 0
    assert got[0].a.reasons == [] and got[0].a.risk == 0 and got[0].a.quality > 0.9
    assert got[2].a.controlled_reject and got[1].a.risk == 0.25
    assert df.columns + ["a"] == pc.assess(df).columns and pc.assess(df.limit(0)).count() == 0


PROMOTED = [
    (GOOD, "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "PROMOTED_STRONG_SIGNAL"),
    (GOOD, "OBLIGATION", 0.95, "DRAFT", "EXTRACT_FULL", None, "NOT_TO_VALIDATE"),
    (GOOD, "OBLIGATION", 0.95, "TO_VALIDATE", None, None, "POLICY_NOT_FULL"),
    (GOOD, "AUTRE", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "TYPE_NOT_ALLOWED"),
    (GOOD + " et le plan de la zone reste lisible" * 9, "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "REQUIREMENT_TOO_LONG"),
    ("L'employeur doit garder la mine.", "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "TEXT_TOO_SHORT"),
    ("Ce plan doit rester dans la zone de pêche.", "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "NO_LEGAL_SUBJECT"),
    ("Toute demande de la zone porte un timbre sec.", "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "NO_NORMATIVE_VERB"),
    (GOOD, "OBLIGATION", 0.5, "TO_VALIDATE", "EXTRACT_FULL", None, "LOW_CONFIDENCE"),
    ("L'employeur doit garder tout le plan.", "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "SHORT_SNIPPET"),
    ("L'employeur peut garder le plan de la zone de pêche dans le bureau du port.", "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "MODAL_PEUT"),
    ("l'employeur doit garder le plan de la zone de pêche dans le bureau du port.", "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "NOISY_START"),
    ("L'employeur doit fermer la zone de pêche et ouvrir le bureau du port du sud.", "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "FUSED_ACTION_CHAIN"),
    (GOOD, "INTERDICTION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", None, "TYPE_MISMATCH_POSTCALL"),
    (GOOD, "OBLIGATION", 0.95, "TO_VALIDATE", "EXTRACT_FULL", "FORCE_VALIDATE", "ERROR_MEMORY_HIT"),
]


def test_promotion(spark):
    rows = [(i, p[0], p[1], p[0], p[0], p[2], p[3], "", p[4], p[5], "TYPE_DRIFT") for i, p in enumerate(PROMOTED)]
    df = spark.createDataFrame(rows, ROWS + ", policy string, memory_action string, memory_family string")
    got = pc.promotion(pc.assess(df)).orderBy("i").collect()
    assert [r.p.reason for r in got] == [p[6] for p in PROMOTED]
    assert got[0].p.status == "DRAFT" and got[2].p.status == "TO_VALIDATE"
    hit = spark.createDataFrame([(0, GOOD, "OBLIGATION", GOOD, GOOD, 0.95, "TO_VALIDATE", "", "EXTRACT_FULL", "FORCE_VALIDATE", "WEAK_GROUNDING")], ROWS + ", policy string, memory_action string, memory_family string")
    assert pc.promotion(pc.assess(hit)).first().p.reason == "PROMOTED_STRONG_SIGNAL"


def plain_review(text):
    """Structure by a plain scan."""
    raw = " ".join((text or "").split())
    out = {"subject": "", "verb": "", "object": raw, "condition": "", "exception": ""}
    found = [(m.start(), k, m.end()) for k, (p, _) in enumerate(fr.REVIEW_VERBS) if (m := re.search(p, raw, re.I))]
    if not found:
        return out
    start, k, end = min(found)
    strip = lambda x: x.strip(" ,:;-")
    out["subject"], out["verb"], rest = strip(raw[:start]), fr.REVIEW_VERBS[k][1], strip(raw[end:])

    def at(x, markers):
        places = [p for m in markers if (p := f" {x.lower()} ".find(m)) >= 0]
        return max(min(places) - 1, 0) if places else -1

    both = [p for p in (at(rest, fr.REVIEW_CONDITIONS), at(rest, fr.REVIEW_EXCEPTIONS)) if p >= 0]
    out["object"] = rest or raw
    if both:
        out["object"], tail = strip(rest[: min(both)]), rest[min(both) :].strip()
        c, e = at(tail, fr.REVIEW_CONDITIONS), at(tail, fr.REVIEW_EXCEPTIONS)
        lead, other, names = (c, fr.REVIEW_EXCEPTIONS, ("condition", "exception")) if c >= 0 and (e == -1 or c <= e) else (e, fr.REVIEW_CONDITIONS, ("exception", "condition"))
        more = at(tail[lead + 1 :], other)
        out[names[0]] = strip(tail[: lead + 1 + more]) if more >= 0 else strip(tail)
        out[names[1]] = strip(tail[lead + 1 + more :]) if more >= 0 else ""
    return out


REVIEWED = [
    "L'employeur doit afficher le plan en cas de travaux, sauf accord écrit.",
    "L'employeur doit, sauf accord écrit, afficher le plan lorsque le port ferme.",
    "Le loueur ne peut pas vendre.",
    "Le plan est tenu de rester et doit partir si le vent souffle",
    "Les ports sont interdits de pêche pour les jeunes",
    "Doit partir",
    "Aucun verbe ici.",
    "",
    None,
    "Le chef doit",
    "Les chefs DOIVENT  partir , hors du port",
]


def test_review(spark):
    rows = [(i, t, t if i % 2 else "autre", ("TEXT_TOO_SHORT", None)[i % 2], (None, 0.5, 0.97)[i % 3]) for i, t in enumerate(REVIEWED)]
    df = spark.createDataFrame(rows, "i int, requirement string, snippet string, blocked_reason string, similarity double")
    for r, (i, t, s, blocked, near) in zip(pc.review(df).orderBy("i").collect(), rows, strict=True):
        want = plain_review(t)
        assert {k: r.v[k] for k in want} == want, t
        words = len((t or "").split())
        like = round(difflib.SequenceMatcher(None, " ".join((t or "").lower().split()), " ".join((s or "").lower().split())).ratio(), 2) if t and s else 0
        assert r.v.words == words and r.v.source_mode == ("NON_PRECISE" if not s else "VERBATIM" if like >= 0.92 else "REFORMULE_LEGERE" if like >= 0.68 else "RECONSTRUCTION_CONTROLEE")
        assert r.v.decision == ("FLAG" if (near or 0) >= 0.95 else "EDIT" if blocked or not want["subject"] or not want["verb"] else "APPROVE")
        assert ("BLOCKED" in r.v.guidance) == bool(blocked) and ("QUICK_REVIEW" in r.v.guidance) == (r.v.guidance == ["QUICK_REVIEW"])


#: Requirement, citation; events.
FILTERED = [
    ("L'exploitant doit vider la cuve du port.", "L'exploitant doit vider la cuve du port.", []),
    ("registre", "", ["LOW_VALUE"]),
    ("Page 3 - Article 2 : Le port doit.", "", ["SOFT LOW_VALUE", "SOFT INVENTED_NON_NORMATIVE"]),
    ("é sera accordée selon l'ancienneté du chef", "", ["LOW_VALUE", "FRAGMENTARY_RUNTIME"][:1]),
    ("et de fournir les moyens est une tâche commune.", "", ["FRAGMENTARY_RUNTIME"]),
    ("Ou bien le plan de la zone est gardé par le chef.", "", ["FRAGMENTARY_RUNTIME"]),
    ("Fixée par le conseil, la taxe est due chaque année.", "", ["FRAGMENTARY_RUNTIME"]),
    ("Xy la taxe du port est due par le chef.", "", ["FRAGMENTARY_RUNTIME"]),
    ("Taxes. Le chef du port doit tenir le registre à jour.", "Le chef du port doit tenir", ["FRAGMENTARY_RUNTIME"]),
    ("Le registre des bassins du port sont remis au guichet.", "", ["SUBJECT_VERB_MISMATCH"]),
    ("Les documents du guichet est remis au chef du port.", "", ["SUBJECT_VERB_MISMATCH"]),
    ("Le champ d'application est celui des quais du port.", "En ce qui concerne les quais, le port est ouvert.", ["NON_ACTIONABLE_SCOPE"]),
    ("Le quai doit être inclus dans le champ d'application du code.", "Le quai doit", ["SOFT NON_ACTIONABLE_SCOPE"]),
    ("Sauf accord écrit du bailleur, le délai est de dix jours ouvrables.", "", []),
    ("Sauf retard du train du soir, le délai est de dix jours.", "Le voyageur du train garde toujours sa place, sauf retard du train.", ["SOFT PARTIAL_EXCEPTION"]),
    ("Sauf retard, le salarié doit prendre le train du soir.", "Le voyageur du train garde toujours sa place, sauf retard; il doit", []),
    ("L'exploitant doit afficher la liste dans la salle commune.", "La salle commune est ouverte le lundi.", ["SOFT INVENTED_NON_NORMATIVE"]),
    ("Le chef répond de la porte du port du sud.", "La porte du port", ["INVENTED_NON_NORMATIVE"]),
    ("Le présent arrêté conjoint sera publié au recueil officiel.", "", ["OUT_OF_SCOPE_INDIVIDUAL"]),
    ("Monsieur Salah est nommé directeur du bureau régional.", "", ["OUT_OF_SCOPE_INDIVIDUAL"]),
    ("Monsieur Salah est nommé membre de la commission du concours.", "", []),
    ("Monsieur Salah est nommé directeur, sauf refus du bureau.", "", []),
]


def viewed(spark, rows, kind="AUTRE"):
    return views_of(spark.createDataFrame([(i, r, s, s, kind) for i, (r, s) in enumerate(rows)], "i int, r string, s string, c string, m string"))


def test_filter_chain(spark):
    got = with_filters(viewed(spark, [f[:2] for f in FILTERED])).orderBy("i").collect()
    for r, f in zip(got, FILTERED, strict=True):
        assert [("SOFT " if e.soft else "") + e.filter for e in r.events] == f[2], f


def test_confidence(spark):
    good = "L'exploitant doit vider la cuve du port du sud."
    rows = [(good, good), (good, ""), ("Il doit vider la cuve du port du sud.", good), (good, good[:-1] + " lorsque le vent souffle."), ("registre", "registre du port du sud et du nord"), ("L'exploitant doit vi1der la cuve du port du sud.", good)]
    x = viewed(spark, rows, "OBLIGATION")
    got = [r.c for r in x.select("i", rr.spark_sql(rr.confidence("kind"), "req", "src", "chunk_plain").alias("c")).orderBy("i").collect()]
    full = 0.58 + 0.05 + 0.04 + 0.05 + 0.08 + 0.05 + 0.05
    assert got[0] == round(full, 2) and got[1] == round(full - 0.05 - 0.20 - 0.15, 2)
    assert got[2] == round(full - 0.04 - 0.06, 2) and got[3] == round(full - 0.10, 2)
    assert got[4] < 0.6 and got[5] < got[0]


@pytest.mark.parametrize(
    ("text", "chunk", "want"),
    [
        ("On entend par quai toute aire de pose.", "", (True, True, False)),
        ("Est considéré comme quai toute aire ; le chef doit agir.", "", (False, False, False)),
        ("Le bail est une convention du port.", "", (False, True, False)),
        ("Le bail conclu entre le chef et le port.", "", (False, True, False)),
        ("La caisse, appelée fonds, s'engage à payer.", "", (False, True, False)),
        ("- Les personnes qui vendent des fruits.", "Les dispositions du présent code sont étendues aux marchands.", (False, False, True)),
        ("- Les personnes qui vendent des fruits doivent payer.", "Les dispositions du présent code sont étendues aux marchands.", (False, False, False)),
        ("Les jardins sont assimilées à des champs.", "", (False, True, True)),
    ],
)
def test_definitions(spark, text, chunk, want):
    from regulith.plans.requirements import _DEFINITIONS, _NO_SIGN

    x = views_of(spark.createDataFrame([(text, "", chunk, "AUTRE")], "r string, s string, c string, m string")).withColumn("unit", rr.spark_sql(_NO_SIGN))
    r = x.select(*[rr.spark_sql(e, "req", "chunk_plain").alias(n) for n, e in _DEFINITIONS.items()]).first()
    assert (r.definition_article, r.definition_unit, r.scope_extension) == want


def test_fixed_values_as_named():
    assert [s for _, s, _ in frq.SUB_DOMAINS][0] == "SECURITE_TRAVAIL" and "sauf" in frq.GENERAL_NORMS and "est passible" in frq.RISK
