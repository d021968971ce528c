"""Repeats within an article and a document: a case for each rule, in order."""

from regulith.operators import article_dedup as ad

LONG = "L'exploitant doit tenir un registre des déchets dangereux, le présenter aux agents et le garder au port du sud"
OTHER = "Le salarié doit porter son casque dans la zone de levage et de pêche"


def test_rules_in_order():
    rows = [
        (1, "a", "OBLIGATION", LONG + ".", "x"),
        (2, "a", "CONDITION", LONG.upper(), "y"),  # whatever the type
        (3, "a", "OBLIGATION", LONG + " pendant dix ans.", "x"),
        (4, "a", "REGISTRE", LONG + " pendant dix ans.", "x"),  # another type
        (5, "b", "OBLIGATION", LONG.replace("é", "e"), "z"),  # accents, another article
        (6, "b", "obligation ", LONG + " durant dix ans.", "x"),
        (7, "b", "OBLIGATION", OTHER, "x"),
        (8, "c", "CONTROLE", OTHER, "x"),
        (9, "c", None, "Le port est clos.", None),
        (10, "d", None, "Le port est clos.", None),  # too short beyond its article
        (11, "d", "AUTRE", "le port est clos", None),
        (12, "d", None, None, None),
        (13, "d", None, "", None),
    ]
    want = {1: (1, "KEPT"), 2: (1, "EXACT_ARTICLE"), 3: (1, "PREFIX_ARTICLE"), 4: (4, "KEPT"), 5: (1, "EXACT_DOC"), 6: (1, "PREFIX_DOC"), 7: (7, "KEPT"), 8: (8, "KEPT"), 9: (9, "KEPT"), 10: (10, "KEPT"), 11: (10, "EXACT_ARTICLE"), 12: (12, "KEPT"), 13: (12, "EXACT_ARTICLE")}
    for order in (rows, rows[::-1]):
        assert {s: (k, r) for s, k, r in ad.kept_of(order)} == want


def test_without_the_text_key_citations_count():
    # shorter than the least prefix, so only the exact keys of the document can hold
    rows = [(1, "a", "OBLIGATION", OTHER, "x"), (2, "b", "OBLIGATION", OTHER, "y"), (3, "c", "OBLIGATION", OTHER, "x")]
    assert [r for _, _, r in ad.kept_of(rows)] == ["KEPT", "EXACT_DOC", "EXACT_DOC"]
    got = ad.kept_of(rows, text_key=False)
    assert got[2] == (3, 1, "EXACT_DOC") or got[1][2] in ("KEPT", "PREFIX_DOC")


def test_rows(spark):
    kind = "doc_id long, items array<struct<seq bigint, article string, kind string, text string, snippet string>>"
    df = spark.createDataFrame([(1, [(2, "a", "X", OTHER, ""), (1, "a", "Y", OTHER, None)]), (2, []), (3, None)], kind)
    assert [tuple(r) for r in ad.dedup(df, "items").orderBy("seq").collect()] == [(1, 1, 1, "KEPT"), (1, 2, 1, "EXACT_ARTICLE")]
