"""Segmentation, dedup and grouping: coverage, order stability, branches."""

import random

from pyspark.sql import functions as F

from regulith.operators import articles, grouping, segment


def test_chunks_cover_the_text():
    g = random.Random(1)
    for _ in range(50):
        text = "\n".join(" ".join("w" * g.randrange(1, 12) + g.choice(["", ".", ";", ":"]) for _ in range(g.randrange(0, 400))) for _ in range(g.randrange(1, 6)))
        got = segment.pack(text)
        assert all(len(c) <= segment.MAX_CHUNK for c in got)
        assert "".join("".join(got).split()) == "".join(text.split())
    assert segment.pack("x" * 3000) == ["x" * 1200, "x" * 1200, "x" * 600] and segment.pack("") == []


def test_units():
    text = "L'exploitant est tenu de :\n- tenir un registre des déchets\n- transmettre un rapport annuel\n- tenir un registre des déchets\n\nPremière phrase assez longue. Deuxième phrase assez longue."
    got = segment.units_of(text)
    assert [k for _, k in got] == ["list_block", "list_block", "sentence_split", "sentence_split"]
    assert got[0][0] == "L'exploitant est tenu de : tenir un registre des déchets"
    assert segment.units_of("") == []


def test_articles(spark):
    text = "Préambule du texte.\nArticle premier - Objet de la loi.\nArticle 2 - Voir\nArticle 1 - ci-dessus.\nArt. 3 - Fin du texte."
    df = spark.createDataFrame([(1, text), (2, "Sans en-tête du tout.")], "doc_id long, text string")
    got = segment.split_articles(df).orderBy("doc_id", "article_no").collect()
    assert [(r.doc_id, r.article_no, r.number) for r in got] == [(1, 0, None), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 0, None)]
    assert "ci-dessus" in got[2].text


def test_article_ends():
    g = random.Random(4)
    for _ in range(300):
        nos = [g.choice([None, *range(1, 9)]) for _ in range(g.randrange(0, 12))]
        want = [next((j for j in range(i + 1, len(nos)) if nos[i] is None or nos[j] is None or nos[j] >= nos[i]), len(nos)) for i in range(len(nos))]
        assert articles._next_plausible(nos) == want


def test_legal_articles(spark):
    rule = "L'exploitant doit tenir un registre numéroté des déchets dangereux et le présenter à toute demande des agents chargés du contrôle"
    plain = f"Préambule du texte.\nArticle premier - {rule}.\nArticle 2 - Voir la liste\nArticle 1 - ci-dessus dans son entier, {rule}.\n3 - {rule} chaque mois.\nANNEXE\nTableau des taxes"
    signed = f"Article 4 - {rule}.\nTunis, le 3 mai 2020.\nLe ministre des finances"
    appointed = "Décret n° 12-2020 du 3 mai\nArticle premier - Monsieur Salah est nommé directeur du bureau régional de la ville."
    rows = [(1, plain), (2, "Sans en-tête du tout."), (3, None), (4, ""), (5, signed), (6, appointed), (7, signed), (None, signed)]
    got = articles.articles(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.start_char):
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2, 3, 4, 5, 6, 7, None}
    assert [r.header for r in by[1]] == ["Article premier -", "Article 2 -", "Article 1 -", "3 -"]
    assert all(plain[r.start_char :].startswith(r.header) for r in by[1]) and not any("Tableau" in r.text for r in by[1])
    assert "ci-dessus" in by[1][1].text and "Article 2" not in by[1][2].text
    for i, text in ((2, "Sans en-tête du tout."), (3, ""), (4, ""), (6, appointed)):
        assert [(r.header, r.text) for r in by[i]] == [("Document", text)]
    for i in (5, 7, None):  # what stands behind the signature goes; equal texts have equal articles
        assert [(r.number, r.text) for r in by[i]] == [(4, f"Article 4 - {rule}.")]


def test_trimmed_and_repaired(spark):
    assert articles.LEAST < articles.SHORT
    rule = "L'exploitant doit tenir un registre numéroté des déchets dangereux"
    rows = [(1, "Article 1 -\nTexte utile et entier.\nPage 3 Journal officiel\nSuite du texte.\nLa ministre du travail\nReste"), (2, f"{rule}. Court. Journal officiel du jour, page des annonces. {rule} demain."), (3, None)]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r.i: r for r in articles.pruned(df.withColumn("u", articles.until_signature("text")), "text").collect()}
    assert got[1].u == "Article 1 -\nTexte utile et entier.\nSuite du texte."
    assert got[2].text == f"{rule}. {rule} demain."
    head = "Article 5 -\nLe paiement est dû"
    rest = " lorsque le fonds national de garantie prend en charge les intérêts. Le bénéficiaire doit rembourser sous réserve de ses droits."
    cut = spark.createDataFrame([("Article 5 -", len(head), "Vu le code. ", head + rest, head)], "header string, chars int, before string, behind string, text string")
    text = articles.repaired(cut).first().text
    assert text.startswith("Article 5 -") and text.endswith("ses droits.") and "garantie" in text
    assert [r.c for r in spark.createDataFrame([("x" * 130,), ("x" * 130 + " dans",), ("court.",), ("",)], "t string").select(articles.cut_off(F.col("t")).alias("c")).collect()] == [False, True, True, False]


def test_overlap_and_data(spark):
    df = spark.createDataFrame([(1, "Tarif A : 12,5 dinars\n- Quota : 30 postes\nrien")], "doc_id long, text string")
    got = segment.data_rows(df).orderBy("line_no").collect()
    assert [(r.label, r.number, r.unit, r.kind) for r in got] == [("Tarif A", 12.5, "dinars", "TARIFF"), ("Quota", 30.0, "postes", "QUOTA")]
    c = spark.createDataFrame([(1, 1, "alpha beta " * 30), (1, 2, "next")], "doc_id long, chunk_no int, chunk string")
    two = segment.with_overlap(c, ["doc_id"]).orderBy("chunk_no").collect()[1].with_overlap
    assert two.endswith("\nnext") and len(two) <= 186


def test_similarity_properties():
    g = random.Random(3)
    for _ in range(200):
        a, b = (" ".join(g.choices(["le", "registre", "doit", "être", "tenu"], k=g.randrange(0, 9))) for _ in range(2))
        assert 0 <= grouping.ratio(a, b) <= 1
        assert grouping.ratio(a, a) == (1.0 if a else 0.0)


LONG = "L'exploitant doit tenir un registre des déchets dangereux et le présenter sur demande de l'inspection"


def as_items(df, *names):
    return df.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("i"))


def test_keep_first_does_not_depend_on_arrival(spark):
    rows = [(1, "O", 1, LONG), (1, "O", 2, LONG + " du travail"), (1, "C", 3, LONG), (1, "O", 4, "Autre chose entièrement différente de ce qui précède"), (1, "O", 5, LONG), (2, "O", 6, "court"), (2, "O", 7, "court"), (2, "O", 8, "Court."), (2, "O", 9, None), (2, "O", 10, "")]
    want = {1: "KEPT", 3: "KEPT", 4: "KEPT", 5: "EXACT", 6: "KEPT", 7: "EXACT", 8: "EXACT", 9: "KEPT", 10: "KEPT"}
    for n in range(3):
        random.Random(n).shuffle(rows)
        df = as_items(spark.createDataFrame(rows, "doc_id long, kind string, seq long, text string").repartition(3), "seq", "kind", "text")
        got = {r.seq: r.reason for r in grouping.keep_first(df, F.col("i")).collect()}
        assert got.pop(2) in ("PREFIX", "OVERLAP") and got == want


def test_duplicate_rules():
    other = "La commission doit tenir un registre des déchets dangereux et le présenter sur demande de l'inspection"
    assert grouping.prefix_duplicate(LONG, LONG + " du travail") and not grouping.prefix_duplicate(LONG[:70], LONG)
    assert not grouping.prefix_duplicate(LONG, LONG + "s du travail et tout ce qui s'ensuit")  # not at a word's end
    assert not grouping.prefix_duplicate(LONG, LONG + " " + "mots nouveaux venus ensuite " * 5)  # too few words shared
    assert grouping.runtime_prefix_duplicate(LONG, LONG + " du travail") and not grouping.runtime_prefix_duplicate(LONG[:60], LONG)
    shuffled = " ".join(sorted(LONG.lower().split()))
    assert grouping.runtime_prefix_duplicate(LONG, shuffled + " et encore quelques autres mots")  # 0.95 of the words, a tenth longer
    assert not grouping.overlap_duplicate(LONG, LONG + " du travail")  # no noise in either
    assert grouping.overlap_duplicate(LONG.replace("registre", "regi|stre"), LONG)
    assert not grouping.overlap_duplicate(other.replace("registre", "registre.."), "Le directeur doit tenir un registre des déchets dangereux et le présenter sur demande de l'inspection")  # other subject
    assert grouping.runtime_overlap_duplicate(LONG, LONG[:80]) and not grouping.runtime_overlap_duplicate(LONG[:39], LONG)
    assert grouping.runtime_overlap_duplicate(LONG, shuffled)


def test_near_statements_miss_none():
    g = random.Random(5)
    words = ["registre", "déchets", "tenir", "exploitant", "responsabilités", "inspection", "doit", "sécurité"]
    for _ in range(30):
        texts = []
        for _ in range(25):
            t = " ".join(g.choices(words, k=g.randrange(1, 14)))
            texts += [t, t.replace("é", "e"), t[g.randrange(0, 5) : len(t) - g.randrange(0, 5)]]
        seen = grouping.Seen()
        for i, t in enumerate(texts):
            near = set(seen.near(t, 0.9))
            for k in range(i):
                o = texts[k]
                if t == o or grouping.prefix_duplicate(t, o) or grouping.runtime_prefix_duplicate(t, o) or grouping.overlap_duplicate(t, o) or grouping.runtime_overlap_duplicate(t, o) or grouping.alike(t, o, 0.9):
                    assert k in near, (t, o)
            seen.add(t)


def test_groups(spark):
    rows = [(1, 1, "O", LONG, "DRAFT", 0.7), (1, 2, "O", LONG + " du travail", "PROMOTED", 0.6), (1, 3, "C", LONG, "DRAFT", 0.9), (1, 4, "O", "tout autre énoncé", "DRAFT", 0.5)]
    df = as_items(spark.createDataFrame(rows, "doc_id long, seq long, kind string, text string, status string, confidence double"), "seq", "kind", "text", "status", "confidence")
    got = grouping.resolve_groups(df, F.col("i")).orderBy("first_seq").collect()
    assert [(r.first_seq, r.representative, r.kind, r.members, r.type_conflict) for r in got] == [(1, 2, "O", 3, True), (4, 4, "O", 1, False)]


def test_subject_consistency(spark):
    rows = [("L'exploitant agit", "rien ici", 0.85), ("doit agir", "Le chef d'équipe doit agir", 0.35), ("agir vite", "Le chef d'équipe doit agir", 0.65), ("Le chef d'équipe doit agir", "Le chef d'équipe doit agir", 1.0), (None, None, 0.85)]
    df = spark.createDataFrame([r[:2] for r in rows], "r string, s string")
    assert [r.x for r in df.select(grouping.subject_consistency("r", "s").alias("x")).collect()] == [r[2] for r in rows]


def test_fixes(spark):
    df = spark.createDataFrame([("tenir un registre", "Bla bla. Il faut tenir un registre, toujours. Fin.", "RESUBJECT_FROM_CONTEXT")], "requirement string, chunk string, action string")
    assert grouping.apply_fixes(df.withColumn("text", F.lit("Il doit agir"))).first().fixed == "L'entreprise doit agir"
    assert grouping.rewrite("L'exploitant doit agir et doit informer", "L'exploitant", "OBLIGATION") == ["L'exploitant doit agir", "L'exploitant doit informer"]


def test_grounding(spark):
    chunk = "L'exploitant doit tenir un registre des déchets. Il est tenu à jour chaque mois.\nAutre sujet."
    good = "L'exploitant doit tenir un registre des déchets."
    assert grouping.grounding_of(good, good, chunk)[:2] == (1.0, "PASS")
    assert grouping.grounding_of(good, "", chunk) == (1.0, "PASS", ["GROUNDING_SNIPPET_EMPTY"])
    score, verdict, why = grouping.grounding_of("Tout autre énoncé sans rapport", "Une phrase inventée", chunk)
    assert verdict == "HARD_FAIL" and score < 0.28 and why == ["GROUNDING_SNIPPET_NOT_IN_CHUNK", "GROUNDING_SCORE_HARD_FAIL"]
    # by the weights: words 2 of 6 with the snippet, which stands in the chunk
    score, verdict, _ = grouping.grounding_of("registre des déchets à remettre demain", "Il est tenu à jour chaque mois.", chunk)
    assert verdict in ("SOFT_FAIL", "PASS") and 0.28 <= score < 0.6
    assert grouping.grounding_of(None, None, None) == (0.0, "HARD_FAIL", ["GROUNDING_SNIPPET_EMPTY", "GROUNDING_SCORE_HARD_FAIL"])
    df = spark.createDataFrame([(good, good, chunk)], "r string, s string, c string")
    assert df.select(grouping.grounding("r", "s", "c").alias("g")).first().g.verdict == "PASS"
