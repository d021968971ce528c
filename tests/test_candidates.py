"""Groups of candidates: a case for each branch."""

from pyspark.sql import functions as F

from regulith.operators import candidates as ca

KIND = "array<struct<seq bigint, text string, kind string, snippet string, status string, confidence double, grounding double, grounding_verdict string, completeness double, completeness_verdict string, missing_exception boolean, type_match boolean, overlap double, quality double, error boolean>>"
A = "L'employeur doit remettre au salarié un plan écrit de la zone de pêche."
B = "Le loueur du port paie la taxe du quai chaque mois."


def item(seq, text, kind="OBLIGATION", status="DRAFT", confidence=0.9, quality=0.9, grounding=0.9, verdict="PASS", missing=False, error=False, match=True):
    return (seq, text, kind, text, status, confidence, grounding, verdict, 1.0, "PASS", missing, match, 0.9, quality, error)


CASES = {
    "one": ([item(1, A)], [(1, "OBLIGATION", 1, False, 0.9, "DRAFT", "DRAFT", True, [])]),
    "apart": ([item(1, A), item(2, B, "AUTRE")], [(1, "OBLIGATION", 1, False, 0.9, "DRAFT", "DRAFT", True, []), (2, "AUTRE", 1, False, 0.9, "DRAFT", "DRAFT", True, [])]),
    "best": ([item(1, A, status="TO_VALIDATE"), item(2, A, confidence=0.8), item(3, A, confidence=0.95)], [(3, "OBLIGATION", 3, False, 0.86, "DRAFT", "DRAFT", True, [])]),
    "tie": ([item(2, A), item(1, A)], [(1, "OBLIGATION", 2, False, 0.86, "DRAFT", "DRAFT", True, [])]),
    "compatible": ([item(1, A), item(2, A, "DECLARATION")], [(1, "OBLIGATION", 2, False, 0.86, "DRAFT", "DRAFT", True, [])]),
    "text": ([item(1, A, "CONDITION"), item(2, A)], [(1, "OBLIGATION", 2, True, 0.78, "TO_VALIDATE", "TO_VALIDATE", True, ["TYPE_CONFLICT_GROUP", "TYPE_ARBITRATION_TEXT_MATCH", "TYPE_CONFLICT_STATUS_DOWNGRADED", "QUALITY_DRAFT_BLOCKED_RISK", "QUALITY_STATUS_DOWNGRADED", "QUALITY_DRAFT_BLOCKED_TYPE_CONFLICT"])]),
    "often": ([item(1, B, "AUTRE"), item(2, B, "CONTROLE", "TO_VALIDATE"), item(3, B, "CONTROLE", "TO_VALIDATE")], [(1, "CONTROLE", 3, True, 0.78, "TO_VALIDATE", "TO_VALIDATE", True, ["TYPE_CONFLICT_GROUP", "TYPE_ARBITRATION_FREQUENCY", "TYPE_CONFLICT_STATUS_DOWNGRADED", "QUALITY_DRAFT_BLOCKED_RISK", "QUALITY_STATUS_DOWNGRADED", "QUALITY_DRAFT_BLOCKED_TYPE_CONFLICT"])]),
    "publication": ([item(1, "Le présent décret sera publié au recueil.", "AUTRE")], [(1, "AUTRE", 1, False, 0.68, "REJECT", "TO_VALIDATE", False, ["OUT_OF_SCOPE_PUBLICATION"])]),
    "descriptive": ([item(1, "On entend par quai toute aire de pose.", "AUTRE")], [(1, "AUTRE", 1, False, 0.75, "REJECT", "TO_VALIDATE", False, ["OUT_OF_SCOPE_AUTRE_DESCRIPTIVE"])]),
    "exception": ([item(1, A, missing=True)], [(1, "OBLIGATION", 1, False, 0.9, "TO_VALIDATE", "TO_VALIDATE", True, ["QUALITY_DRAFT_BLOCKED_RISK", "QUALITY_STATUS_DOWNGRADED", "QUALITY_DRAFT_BLOCKED_MISSING_EXCEPTION"])]),
    "weak": ([item(1, A, grounding=0.1, verdict="HARD_FAIL")], [(1, "OBLIGATION", 1, False, 0.9, "TO_VALIDATE", "TO_VALIDATE", True, ["QUALITY_DRAFT_BLOCKED_RISK", "QUALITY_STATUS_DOWNGRADED", "QUALITY_DRAFT_BLOCKED_GROUNDING_WEAK"])]),
    "middling": ([item(1, A, quality=0.6)], [(1, "OBLIGATION", 1, False, 0.6, "TO_VALIDATE", "TO_VALIDATE", True, ["QUALITY_STATUS_DOWNGRADED"])]),
    "low": ([item(1, A, quality=0.3)], [(1, "OBLIGATION", 1, False, 0.3, "REJECT", "DRAFT", False, ["QUALITY_SCORE_REJECT"])]),
    "error": ([item(1, A, error=True)], []),
    "none": (None, []),
    "empty": ([], []),
}


def test_resolution(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], f"doc_id string, items {KIND}")
    got = {}
    for r in ca.resolve(df, "items").orderBy("doc_id", "first_seq").collect():
        got.setdefault(r.doc_id, []).append((r.representative, r.kind, r.members, r.conflict, r.quality, r.decision, r.status, r.kept, r.reasons))
    for k, (_, want) in CASES.items():
        assert got.get(k, []) == want, (k, got.get(k), want)


def test_groups_follow_order_and_types():
    assert ca.groups_of([3, 1, 2], ["A", "A", "A"], [B, A, B], 0.9) == [[1], [2, 3]]
    long = A[:-1] + " et du port du sud, chaque lundi matin."
    assert ca.groups_of([1, 2], ["OBLIGATION", "DECLARATION"], [A, A.upper()], 0.9) == [[1, 2]]
    assert ca.groups_of([1, 2], ["OBLIGATION", None], [A, long], 0.95) == [[1], [2]]
    assert ca.groups_of([], [], [], 0.9) == [] and ca.groups_of([1, 2], ["X", "Y"], [None, ""], 0.9) in ([[1, 2]], [[1], [2]])


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([("a", [item(1, A)]), ("a", [item(1, A)])], f"doc_id string, items {KIND}")
    assert ca.resolve(df, "items").count() == 2
    assert ca.resolve(df.limit(0), "items").withColumn("x", F.lit(1)).count() == 0
