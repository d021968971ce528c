"""French lexicon. The compliance domain's cue patterns and weights, in their natural order."""

NORMATIVE = [
    ("MANDATORY_DOIT", r"\bdoit(?:vent)?\b", 1.4),
    ("MANDATORY_TENU", r"\best\s+tenu(?:e|s|es)?\s+de\b", 1.4),
    ("INTERDICTION", r"\b(?:est|sont)\s+interdit(?:e|es|s)?\b|\bne\s+doit(?:vent)?\s+pas\b", 1.6),
    ("CONDITION", r"\blorsque\b|\ben\s+cas\s+de\b|\bsi\b|\b[àa]\s+condition\s+de\b", 0.8),
    ("EXCEPTION", r"\bsauf\b|\b[àa]\s+l['’]exception\s+de\b", 0.9),
    ("SANCTION", r"\best\s+puni(?:e|s|es)?\b|\bpuni(?:e|s|es)?\s+de\b", 1.5),
    ("RESPONSABILITE", r"\best\s+responsable\b|\br[ée]pond\s+de\b", 1.2),
    ("REGISTRE", r"\bregistre\b", 0.5),
    ("EFFECT_LEGAL", r"\bb[ée]n[ée]fici\w*\b|\bprend\s+en\s+charge\b|\best\s+accord[ée]e?\b|\bsont\s+fix[ée]es?\b|\bsont\s+recouvr[ée]es?\b|\bsont\s+affect[ée]es?\b|\bentra[iî]ne\b|\bouvre\s+droit\b|\bcommuniqu\w*\b|\btransmett\w*\b|\badress\w*\b", 0.95),
]
DESCRIPTIVE = [
    ("DEFINITION", r"\bon\s+entend\s+par\b|\bd[ée]signe\b|\best\s+défini(?:e)?\s+comme\b", 1.6),
    ("NOMINATION", r"\best\s+nomm[ée]e?\b|\bsont\s+nomm[ée]s\b|\best\s+désign[ée]e?\b|\best\s+charge\b", 1.5),
    ("SOMMAIRE", r"(?m)^\s*(?:chapitre|section|titre|livre|sommaire)\b(?:\s+[ivxlcdm0-9]+)?(?:\s*[:.\-])?", 1.3),
    ("REFERENCE_META", r"\bla\s+pr[ée]sente\s+loi\b|\bjournal\s+officiel\b", 1.0),
    ("ORGANISATION", r"\bobjet\s+de\s+la\s+loi\b|\bdispositions\s+g[ée]n[ée]rales\b", 0.9),
    ("PUBLICATION_BOILERPLATE", r"\ble\s+pr[ée]sent\s+(?:arr[êe]t[ée]?(?:\s+conjoint)?|d[ée]cret|loi)\s+sera\s+publi[ée]\b", 1.8),
    ("META_REGULATORY_INTRO", r"\ble\s+pr[ée]sent\s+(?:arr[êe]t[ée]?|d[ée]cret|code|loi)\s+(?:fixe|d[ée]finit|d[ée]termine|pr[ée]cise)\b|\bfixe\s+les\s+conditions\s+d['’]application\b", 1.7),
    ("ACTE_INDIVIDUEL_NAME", r"\b(?:monsieur|madame|m\.|mme\.?)\s+[a-zàâäéèêëîïôöùûüç][a-zàâäéèêëîïôöùûüç'\-]{1,}", 0.6),
    ("ACTE_INDIVIDUEL_APPOINTMENT", r"\b(?:est|sont)\s+(?:nomm[ée]e?s?|d[ée]sign[ée]e?s?)\b|\bcharg[ée]e?s?\s+des\s+fonctions\s+de\b|\bacceptation\s+de\s+d[ée]mission\b|\bd[ée]l[ée]gation\s+de\s+signature\s+accord[ée]e?\s+[àa]\b", 0.9),
    ("CREATION_ORG", r"\bil\s+est\s+(?:cr[ée][ée]e?|institu[ée]e?|[ée]tabli[ée]?|ouvert)\b|\best\s+organis[ée]e?\s+conform[ée]ment\s+aux\s+dispositions\s+du\s+pr[ée]sent\b|\bconcours\b.{0,60}\best\s+ouvert\b", 1.1),
]
STRONG_NORMATIVE = ("MANDATORY_DOIT", "MANDATORY_TENU", "INTERDICTION", "SANCTION")
MIXED_DESCRIPTIVE = ("SOMMAIRE", "ACTE_INDIVIDUEL_NAME", "ACTE_INDIVIDUEL_APPOINTMENT")
NON_ARTICLE_LABELS = ("annexe", "sommaire", "nomination", "demission", "démission", "acceptation", "table", "tableau")

# Document gate.
SUMMARY_NOTICE = r"\b(?:sommaire|table\s+des\s+mati[eè]res|avis\s+et\s+communications?|situation\s+g[ée]n[ée]rale|index\s+[ée]ditorial|communiqu[ée]\s+officiel)\b"
ARABIC_ONLY = r"\b(?:publi[ée]\s+uniquement\s+en\s+langue\s+arabe|publi[ée]\s+uniquement\s+en\s+arabe|texte\s+publi[ée]\s+en\s+arabe|en\s+langue\s+arabe\s+uniquement|uniquement\s+en\s+arabe)\b"
STRONG_TITLE = r"\b(?:code\s+du\s+travail|code\s+du\s+commerce|loi(?:\s+n(?:[°o?])?\s*)?\d{1,4}(?:[-_/]\d{1,4})+|d[ée]cret(?:-loi)?(?:\s+n(?:[°o?])?\s*)?\d{1,4}(?:[-_/]\d{1,4})+|arr[êe]t[ée](?:\s+n(?:[°o?])?\s*)?\d{1,4}(?:[-_/]\d{1,4})+|l\d{2,4}[-_]\d{1,4}\b|d[_-]\d{2,4}[-_]\d{1,4}\b)\b"
REGULATORY_TITLE = r"\b(?:code\s+du\s+travail|code\s+du\s+commerce|loi\s+n[°o]|d[ée]cret(?:-loi)?(?:\s+n[°o])?|arr[êe]t[ée]\s+fixant|fixant\s+les\s+modalit[ée]s|cahier\s+des\s+charges|conditions?\s+d['’]application|contributions?\s+tarifaires?|obligations?\s+de|registre|proc[ée]dure)\b"
CONCOURS = r"\b(?:concours|examen|candidature|jury|date\s+de\s+cl[ôo]ture|nombre\s+de\s+postes?)\b"
COMMISSION = r"\b(?:commission|quorum|proc[eè]s-verbal|inventaire|conseil\s+d['’]administration|composition\s+de\s+la\s+commission)\b"
ANNEX_DATA = r"\b(?:annexe|tableau|grille|tarifs?|bar[eè]me|liste\s+des\s+postes|liste\s+des\s+sp[ée]cialit[ée]s|quotas?)\b"
INDIVIDUAL = r"\b(?:(?:est|sont)\s+(?:nomm[ée]e?s?|d[ée]sign[ée]e?s?)|(?:est|sont)\s+charg[ée]e?s?\s+des\s+fonctions\s+de|mise?\s+fin\s+aux?\s+fonctions|cessation\s+de\s+fonctions|promotion|r[ée]vocation|d[ée]mission|d[ée]l[ée]gation\s+de\s+signature)\b"
NAMED_PERSON = r"\b(?:monsieur|madame|mme\.?|m\.)\s+[a-zàâäéèêëîïôöùûüç][a-zàâäéèêëîïôöùûüç'\-]{1,}"
INSTITUTIONAL = r"\b(?:jury|commission|candidat(?:s)?|ministre|institut|agence|conseil|direction|secr[ée]tariat|administration)\b"
NORMATIVE_CORE = r"\b(?:doit|doivent|est\s+tenu(?:e|s|es)?(?:\s+de|\b)|interdit(?:e|es|s)?|en\s+cas\s+de|lorsque|sous\s+r[ée]serve\s+de|[àa]\s+condition\s+de|est\s+fix[ée]e?|sont\s+fix[ée]e?s?|est\s+rejet[ée]e?|sont\s+rejet[ée]e?s?)\b"
LIMITED_ACTIONABLE = r"\b(?:est\s+charg[ée]?\s+de|sont\s+charg[ée]s?\s+de|proposer|[ée]valuer|classer|attribuer|d[ée]cerner|est\s+fix[ée]e?|sont\s+fix[ée]e?s?|nombre\s+de\s+postes?|date\s+de\s+cl[ôo]ture|anciennet[ée]|priorit[ée]|pi[eè]ces?\s+suivantes?)\b"

# Article gate.
SUMMARY_LABEL = r"\b(?:sommaire|avis\s+et\s+communications?|table\s+des\s+mati[eè]res|index|communiqu[ée]s?)\b"
SUMMARY_LAYOUT = r"(?m)^\s*(?:-|\*|•)?\s*[A-ZÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ][^\n]{8,120}\s+\.{2,}\s*\d{1,4}\s*$"
META_SCOPE = r"\ble\s+pr[éee]sent\s+(?:arr[êe]t[ée]?|d[ée]cret|code|loi)\s+(?:fixe|d[ée]finit|d[ée]termine|pr[ée]cise)\b|\bfixe\s+les\s+conditions\s+d['’]application\b"
STRONG_INDIVIDUAL = r"\b(?:en\s+remplacement\s+de|mis(?:e)?\s+fin\s+aux?\s+fonctions|est\s+nomm[ée]e?\s+directeur|acceptation\s+de\s+d[ée]mission)\b"
STRONG_NORMATIVE_ARTICLE = r"\b(?:doit|doivent|est\s+tenu(?:e|s|es)?(?:\s+de|\b)|sont\s+tenus?\s+de|interdit(?:e|es|s)?|ne\s+doit(?:vent)?\s+pas|ne\s+peu(?:t|vent)\s+pas|communiqu\w+|transmett?\w+|adress\w+|notifi\w+|pr[ée]sent\w+|tenir\s+un\s+registre|registre)\b"
STANDARD_LABEL = r"^\s*(?:art\.?|article)\s*(?:premier|1er|unique|\d+(?:[-.]\d+)*)\b"

# Scope levels in order, and cues of a level in a requirement's text.
LEVELS = ("ORGANIZATION", "SITE", "PROCESS", "ACTIVITY")
LEVEL_CUES = (("ORGANIZATION", r"\b(?:entreprise|soci[ée]t[ée]|employeur|organisme)\b"), ("SITE", r"\b(?:site|[ée]tablissement|usine|locaux)\b"), ("PROCESS", r"\b(?:processus|proc[ée]d[ée]|proc[ée]dure)\b"), ("ACTIVITY", r"\b(?:activit[ée]|op[ée]ration|poste|atelier|manipulation)\b"))

# Evidence policy.
EVIDENCE_MAX_AGE = {"AUDIT_REPORT": 365, "COMPLIANCE_DOC": 730, "NC_CLOSURE": 180, "GENERIC": 730}
PRIORITIES = ("BASSE", "NORMALE", "HAUTE", "URGENTE")
SEVERITY_PRIORITY = {"CRITIQUE": "URGENTE", "MAJEURE": "HAUTE", "MINEURE": "NORMALE"}

# Months of effective dates.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
