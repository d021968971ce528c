"""A lexicon of words that the given tables' text holds, to run the cascades over it. Not the compliance domain's rules."""

#: A whole word, in a form that any regular-expression engine reads alike.
W = r"(?:^|[^\p{{L}}])(?:{})(?:[^\p{{L}}]|$)"

NORMATIVE = [
    ("MANDATORY_DOIT", W.format("the|der|les|los"), 1.4),
    ("MANDATORY_TENU", W.format("with|mit|pour|para"), 1.4),
    ("INTERDICTION", W.format("not|nicht|pas|no"), 1.6),
    ("CONDITION", W.format("from|von|dans|por"), 0.8),
    ("SANCTION", W.format("was|ist|est|es"), 1.5),
    ("EFFECT_LEGAL", r"(tion|ung|ment)", 0.95),
]
DESCRIPTIVE = [
    ("DEFINITION", W.format("this|das|une|una"), 1.6),
    ("SOMMAIRE", W.format("and|und|et|que"), 1.3),
    ("ACTE_INDIVIDUEL_NAME", W.format("are|ein|qui|del"), 2.6),
    ("REFERENCE_META", r"\|", 1.0),
]
STRONG_NORMATIVE = ("INTERDICTION", "SANCTION")
MIXED_DESCRIPTIVE = ("SOMMAIRE", "ACTE_INDIVIDUEL_NAME")
