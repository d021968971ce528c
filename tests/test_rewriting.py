"""Statements split by each rule."""

import pytest

from regulith.operators import rewriting

CASES = [
    ("Le dossier doit comprendre le nom; l'adresse ; et le plan.", "OBLIGATION", "DOCUMENT", ["Le dossier doit comprendre le nom.", "Le dossier doit comprendre l'adresse.", "Le dossier doit comprendre le plan."]),
    ("La demande doit indiquer le nom; le chef doit signer.", "DECLARATION", "DOCUMENT", ["La demande doit indiquer le nom.", "le chef doit signer."]),
    ("Lorsque le vent souffle, il doit en avertir l'employeur et attendre ses instructions s'il n'y a pas péril en la demeure.", "OBLIGATION", "WARNING", ["Lorsque le vent souffle, il doit en avertir l'employeur.", "Lorsque le vent souffle, il doit attendre ses instructions s'il n'y a pas péril en la demeure."]),
    ("Le quai est lavé par l'agent et est séché par le chef.", "CONTROLE", "AUXILIARY", ["Le quai est lavé par l'agent.", "Le quai est séché par le chef."]),
    ("Le chef doit laver le quai et peut fermer le port, doit partir.", "OBLIGATION", "MODAL", ["Le chef doit laver le quai.", "Le chef peut fermer le port.", "Le chef doit partir."]),
    ("Le jury se compose de deux agents; et de trois chefs.", "OBLIGATION", "COMPOSITION", ["Le jury se compose de deux agents.", "Le jury se compose de trois chefs."]),
    ("Le jury doit: - Proposer un prix; b) classer les offres", "OBLIGATION", "COLON", ["Le jury doit proposer un prix.", "Le jury doit classer les offres."]),
    ("Le jury est chargé de classer les offres; de fixer le prix; le chef peut partir", "OBLIGATION", "LIST", ["Le jury est chargé de classer les offres.", "Le jury est chargé de fixer le prix.", "le chef peut partir."]),
    ("L'employeur doit fermer la porte et ouvrir le toit.", "OBLIGATION", "INFINITIVE", ["L'employeur doit fermer la porte.", "L'employeur doit ouvrir le toit."]),
    ("L'employeur doit fermer la porte et ouvrir le toit.", "CONDITION", "KEPT", ["L'employeur doit fermer la porte et ouvrir le toit."]),
    ("Le chef doit  partir.", "OBLIGATION", "KEPT", ["Le chef doit partir."]),
    ("", "OBLIGATION", None, []),
    (None, None, None, []),
]


@pytest.fixture(scope="module")
def split(spark):
    df = spark.createDataFrame([(i, *c[:2], "x") for i, c in enumerate(CASES)], "i int, requirement string, kind string, rule string")
    return {r.i: r.parts for r in rewriting.split_statements(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(split, i):
    text, _, rule, want = CASES[i]
    assert [p.text for p in split[i]] == want
    assert all(p.rule == rule and p.source == " ".join(text.split()) for p in split[i])
