"""Cues of a statement's parts after extraction. The compliance domain's own, in their natural order.

Patterns are for lower-cased text without accents and with straight apostrophes.
"""

CONDITION_CUES = (r"\bsi\b", r"\blorsque\b", r"\ben\s+cas\s+de\b", r"\ba\s+condition\s+de\b", r"\bsous\s+reserve\s+de\b", r"\bne\s+peu(?:t|vent)\s+[^.!?;:]{0,280}\bque\b")
CONDITION_FRAGMENTS = ("en cas de", "a condition de", "sous reserve de")
EXCEPTION_CUES = (r"\bsauf\b", r"\bexcept(?:ion|e?)\b", r"\btoutefois\b|\bcependant\b", r"\bderogation\b|\bpar\s+derogation\b")
EXCEPTION_FRAGMENTS = ("par derogation", "sauf", "toutefois", "cependant", "except")
SCOPE_CUES = (r"\ba\s+l'egard\s+de\b", r"\bau\s+titre\s+de\b", r"\bdans\s+le\s+cadre\s+de\b", r"\bconcernant\b|\brelatif(?:ve)?s?\s+a\b", r"\buniquement\b|\bseulement\b|\blimite?\s+a\b")
SCOPE_FRAGMENTS = ("a l'egard de", "au titre de", "dans le cadre de", "relatif", "concernant")
SCOPE_CHARS, SCOPE_WINDOW, SCOPE_SHARED = 35, 120, 0.25

DANGLING_TAIL = r"(?:\b(?:est|sont)\s+(?:fix(?:e|ees|es)|determin(?:e|ees|es)|prevu(?:e|es|s)?|arret(?:e|ees|es)|defini(?:e|es|s)?)\s+par\b|\b(?:contre|par|pour|de|du|des|a|au|aux|avec|sur|sous)\b)[\s\.,;:!?-]*$"
MISSING_OBJECT = r"(?:\b(?:doit(?:vent)?|est\s+tenu(?:e|s|es)?\s+d(?:e|')|sont\s+tenu(?:s|es)?\s+d(?:e|')|peut(?:vent)?)\s+(?:informer|notifier|communiquer|transmettre|adresser|declarer|indiquer|presenter|soumettre|remettre|tenir|assurer)\b|\b(?:informe|notifie|communique|transmet|adresse|declare|indique|presente|soumet|remet|assure)\b)[\s\.,;:!?-]*(?:[.;:!?]\s|$)"
FUSED_LIST = r"\b(?:doit(?:vent)?|est\s+tenu(?:e|s|es)?\s+d(?:e|')|sont\s+tenu(?:s|es)?\s+d(?:e|')|est\s+habilite?\s+a|sont\s+habilite?s?\s+a|est\s+charge?\s+de|sont\s+charge?s?\s+de)\b"
FUSED_AUXILIARY = r"^.+?\s+(?:est|sont)\s+.+?\bet\s+(?:est|sont)\s+.+$"
FUSED_MODAL = r"^.+?(?:\bdoit(?:vent)?\b|\best\s+tenu(?:e|s|es)?\s+d(?:e|')|\bsont\s+tenu(?:s|es)?\s+d(?:e|')|\best\s+habilite?\s+a\b|\bsont\s+habilite?s?\s+a\b|\best\s+charge?\s+de\b|\bsont\s+charge?s?\s+de\b).+\bet\s+(?:a\s+|de\s+)?[a-z'-]{3,}(?:er|ir|re|oir)\b"
MISSING = (("CONDITION", 0.35), ("EXCEPTION", 0.35), ("SCOPE", 0.3), ("OBJECT", 0.42), ("TAIL", 0.45), ("GRANULARITY", 0.22))
MISSING_REASONS = {"CONDITION": "COMPLETENESS_MISSING_CONDITION", "EXCEPTION": "COMPLETENESS_MISSING_EXCEPTION", "SCOPE": "COMPLETENESS_MISSING_SCOPE", "OBJECT": "COMPLETENESS_MISSING_OBJECT", "TAIL": "COMPLETENESS_DANGLING_TAIL", "GRANULARITY": "COMPLETENESS_FUSED_ACTION_CHAIN"}

STOP = (
    "a", "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "elles", "en", "et", "il", "ils", "je", "la", "le", "les", "leur", "leurs", "lui", "mais", "me", "meme", "ne", "nos", "notre", "nous", "on", "ou",
    "par", "pas", "pour", "qu", "que", "qui", "sa", "se", "ses", "son", "sur", "ta", "te", "tes", "toi", "ton", "tu", "un", "une", "vos", "votre", "vous", "y",
)

# Norms and descriptions; the second form of "ne peut" is a condition where "que" follows.
NORMS = (
    ("OBLIGATION_DOIT", r"\bdoit(?:vent)?\b"),
    ("OBLIGATION_TENU", r"\best\s+tenu(?:e|s|es)?\s+d(?:e|')"),
    ("OBLIGATION_COMMUNICATION", r"\bcommuniqu\w+\b|\btransmett\w+\b|\badress\w+\b|\bfourn\w+\b"),
    ("INTERDICTION", r"\binterdit(?:e|es|s)?\b|\bne\s+doit(?:vent)?\s+pas\b|\bne\s+peu(?:t|vent)\s+pas\b|\bne\s+peu(?:t|vent)\s+(?![^.!?;:]{0,280}\bque\b)(?:participer|concourir|beneficier|pretendre|acceder|exercer|deposer|soumettre)\b"),
    ("CONDITION_RESTRICTIVE_NE_QUE", r"\bne\s+peu(?:t|vent)\s+[^.!?;:]{0,280}\bque\b"),
    ("EXCEPTION", r"\bsauf\b|\bexception\b|\bcependant\b|\btoutefois\b"),
    ("CONDITION", r"\bsi\b|\blorsque\b|\ben\s+cas\s+de\b|\ba\s+condition\s+de\b"),
    ("RESPONSABILITE", r"\bresponsable\b|\brepond\s+de\b"),
    ("DECLARATION", r"\bdeclar(?:er|ation)\b|\bnotifier\b|\bcommuniqu\w+\b|\btransmett\w+\b|\badress\w+\b"),
    ("REGISTRE", r"\bregistre\b|\bconsigner\b|\btenir\s+un\s+registre\b"),
)
DESCRIPTIONS = (
    ("DEFINITION", r"\bon\s+entend\s+par\b|\bdesigne\b|\best\s+definie?\b"),
    ("NOMINATION", r"\best\s+nommee?\b|\best\s+designee?\b|\best\s+chargee?\b"),
    ("SOMMAIRE", r"\blivre\b|\btitre\b|\bchapitre\b|\bsection\b|\bsommaire\b"),
    ("REFERENCE_META", r"\bjournal\s+officiel\b|\bla\s+presente\s+loi\b"),
    ("CREATION_STRUCTURE", r"\bil\s+est\s+(?:creee?|instituee?|etablie?)\b"),
    ("OUVERTURE_CONCOURS", r"\bconcours\b.{0,80}\best\s+ouvert\b|\best\s+ouvert\b.{0,80}\bconcours\b"),
    ("CONFORMITE_PRESENT_ARRETE", r"\best\s+organisee?\s+conformement\s+aux\s+dispositions\s+du\s+present\b"),
)
TYPE_NORMS = {
    "OBLIGATION": (r"\bdoit(?:vent)?\b", r"\best\s+tenu(?:e|s|es)?\s+d(?:e|')", r"\bprend\s+en\s+charge\b", r"\bbenefici\w*\b", r"\bcommuniqu\w+\b|\btransmet\w+\b|\badress\w+\b", r"\bsont?\s+fix\w+\b|\bfix\w+\s+conformement\b", r"\bsont?\s+recouvr\w+\b|\bsont?\s+affect\w+\b"),
    "INTERDICTION": (NORMS[3][1],),
    "RESPONSABILITE": (r"\bresponsable\b", r"\brepond\s+de\b"),
    "EXCEPTION": (r"\bsauf\b|\bexception\b|\bcependant\b|\btoutefois\b",),
    "CONDITION": (r"\bsi\b|\blorsque\b|\ben\s+cas\s+de\b|\ba\s+condition\s+de\b", r"\bne\s+peu(?:t|vent)\s+[^.!?;:]{0,280}\bque\b"),
    "DECLARATION": (r"\bdeclar(?:er|ation)\b|\bnotifier\b|\bcommuniqu\w+\b|\btransmett?\w+\b|\badress\w+\b|\bfourn\w+\b|\binform\w+\b",),
    "REGISTRE": (r"\bregistre\b|\bconsigner\b|\btenir\s+un\s+registre\b",),
    "CONTROLE": (r"\bcontrole\b|\binspection\b",),
}
# The type of a statement whose own type's norms are absent: what comes first.
RESTRICTED = r"\bne\s+peu(?:t|vent)\s+[^.!?;:]{0,280}\bque\b"
FORBIDDEN = r"\binterdit(?:e|es|s)?\b|\bne\s+(?:doit(?:vent)?|peu(?:t|vent))\s+pas\b|\bne\s+peu(?:t|vent)\s+(?![^.!?;:]{0,280}\bque\b)(?:participer|concourir|beneficier|pretendre|acceder|exercer|deposer|soumettre)\b"
REPORTS = r"\bcommuniqu\w+\b|\btransmett?\w+\b|\badress\w+\b|\bfourn\w+\b|\binform\w+\b"
REPORTED_TO = r"\b(?:ministere|autorites?|inspection|administration|service\s+competent|organisme|office|agence|informations?|donnees|renseignements?|rapport)\b"
LEGAL_EFFECT = r"\bprend\s+en\s+charge\b|\bbenefici\w*\b|\bcommuniqu\w+\b|\btransmet\w+\b|\badress\w+\b|\bsont?\s+fix\w+\b|\bfix\w+\s+conformement\b|\bsont?\s+recouvr\w+\b|\bsont?\s+affect\w+\b"

# Strength of the source.
OPTIONAL = r"\bpeut\s+(?:bénéficier|demander|obtenir|solliciter|déposer|recourir|choisir)\b|\bdevrait\b|\bil\s+est\s+recommandé\b|\ba\s+la\s+possibilité\s+de\b|\best\s+susceptible\s+de\b|\bpeut\s+être\s+accordé\b|\bpeut\s+être\s+exonéré\b"
IMPERATIVE = r"\bdoit\b|\best\s+tenu\s+de\b|\best\s+interdit\s+de?\b|\bne\s+peut\s+pas\b|\bne\s+peut\s+en\s+aucun\s+cas\b|\bobligatoirement\b|\bentraîne\s+(?:l'exclusion|la\s+nullité|le\s+rejet)\b|\bsera\s+rejeté\b|\brépond\s+de\b|\best\s+passible\b"

# Out of scope, mixed sources, clauses blended by OCR.
PUBLICATION = r"\b(?:l'|le|la)\s+presente?\s+(?:arrete?|decret(?:-loi)?|loi)\s+sera\s+(?:publiee?|executee?)\b"
ACT_MARKERS = ("est nomme", "est nommee", "sont nommes", "sont nommees", "est designe", "sont designes", "charge des fonctions de", "chargee des fonctions de", "acceptation de demission", "delegation de signature accordee a monsieur", "delegation de signature accordee a madame", "delegation de signature", "par delegation", "est habilite a signer")
GENERAL_NORMS = ("doit", "doivent", "est tenu de", "sont tenus de", "interdit", "en cas de", "lorsque", "communique", "communiquent", "transmet", "transmettent", "adresse", "adressent", "prend en charge", "beneficie", "beneficient")
ACT_NAME = r"\b(?:monsieur|madame|m\.|mme\.?)\s+[a-z][a-z'\-]{1,}"
INSTITUTIONS = ("direction generale", "ministere", "administration", "etablissement", "agriculteurs", "fonds national")
COMPETITIONS = ("jury", "concours", "candidat", "commission", "deliberation", "notation", "classement", "postes a pourvoir", "anciennete dans le grade")
SIGNING = ("habilite a signer", "habilitee a signer")
MIXED_SOURCE = r"\b(?:journal\s+officiel|page\s+\d+|n[??o]\s*\d+|chapitre|section|titre|livre)\b"
ARTICLE_REFERENCE = r"\b(?:article|art\.?)\s*\d{1,3}(?:[-.]\d+)*\b"
BROKEN_HYPHEN = r"\b[a-z0-9']{4,}\s*-\s+[a-z0-9']{4,}\b"
LEADING_BLEND = r"^\s*(?:d'|de\s+)[a-z0-9'-]{4,}\s*-\s+(?:dans|si|lorsque|pour|en\s+cas)\b"
DASH_BLEND = r"(?s)\b(?:doit(?:vent)?|est\s+tenu(?:e|s|es)?\s+d(?:e|')|sont\s+tenu(?:s|es)?\s+d(?:e|'))\b.{0,160}\s-\s+(?:dans|si|lorsque|pour|en\s+cas)\b.{0,260}\b(?:doit(?:vent)?|est\b|sont\b)"
DASH_RESTARTS = (" - dans ", " - si ", " - lorsque ", " - pour ", " - en cas ")
FIRST_MODALS = (" est tenu d'", " est tenue d'", " sont tenus d'", " sont tenues d'", " est tenu de ", " est tenue de ", " sont tenus de ", " sont tenues de ", " doit ", " doivent ")
SECOND_MODALS = (" doit ", " doivent ", " est ", " sont ", " etre ", " etres ")

# Decision after extraction.
HARD_OVERLAP, SOFT_OVERLAP = 0.05, 0.12
HARD_TYPES = ("INTERDICTION", "EXCEPTION", "CONDITION", "RESPONSABILITE")
IMPERATIVE_TYPES = ("OBLIGATION", "INTERDICTION", "RESPONSABILITE")
CONTROLLED = ("DESCRIPTIVE_WITHOUT_NORMATIVE_MARKER", "GROUNDING_HARD_FAIL_DROP", "COMPLETENESS_HARD_FAIL_DROP", "TYPE_MISMATCH_HARD_DROP", "LOW_CONFIDENCE_NON_NORMATIVE", "TOO_SHORT", "OUT_OF_SCOPE_INDIVIDUAL_ACT", "OUT_OF_SCOPE_PUBLICATION")
INCOHERENT, OVERQUALIFIED = 0.18, 0.15

# Groups of candidates.
COMPATIBLE_TYPES = (("OBLIGATION", "DECLARATION"), ("RESPONSABILITE", "OBLIGATION"))
TYPE_PRIORITY = {"INTERDICTION": 90, "REGISTRE": 86, "DECLARATION": 82, "OBLIGATION": 80, "EXCEPTION": 70, "CONDITION": 65, "RESPONSABILITE": 60, "CONTROLE": 45, "AUTRE": 10}
GROUP_PENALTIES = {"DUPLICATE_GROUP": 0.04, "TYPE_CONFLICT_GROUP": 0.08, "OUT_OF_SCOPE_AUTRE_DESCRIPTIVE": 0.15, "OUT_OF_SCOPE_INDIVIDUAL_ACT": 0.22, "OUT_OF_SCOPE_PUBLICATION": 0.22}

# Promotion.
PROMOTED_TYPES = ("OBLIGATION", "INTERDICTION", "CONDITION", "EXCEPTION", "DECLARATION", "REGISTRE")
SUBJECT_PREFIXES = ("l'employeur", "le chef ", "tout travailleur", "le travailleur", "le salarie", "les salaries", "toute personne", "l'entreprise", "les entreprises", "le medecin", "le responsable", "les candidats", "le candidat", "le jury", "la commission", "le directeur", "le ministre", "l'organisme", "l'etablissement", "les membres", "tout employeur", "tout etablissement", "il est interdit", "est interdit", "toute demande", "tout dossier")
NO_SUBJECT_PREFIXES = ("ce ", "cet ", "cette ", "ces ", "le present ", "la presente ", "les presents ", "les presentes ", "lors de ", "au cours de ", "en cas de ")
GENERIC_SUBJECT = r"^(?:l'[a-z]|(?:le|la|les|tout|toute|tous|toutes)\s+[a-z])"
SUBJECT_NORMS = ("doit ", "doivent ", "doit etre", "doivent etre", "est tenu", "sont tenus", "est interdit", "est interdite", "strictement interdit", "strictement interdite", "sont interdits", "sont interdites", "il est interdit", "ne peut ", "ne peuvent ", "peut ", "peuvent ", "peut obliger", "peuvent obliger", "peut prescrire", "peuvent prescrire", "est charge", "sont charges", "est soumis", "sont soumis", "est soumise", "sont soumises", "est attribue", "sont attribues", "n'est attribue", "ne sont attribues", "est autorise", "sont autorises", "n'est autorise", "ne sont autorises", "est admis", "sont admis", "n'est admis", "ne sont admis", "est passible", "sont passibles", "repond de", "repondent de", "doit indiquer", "doit comprendre", "doit comporter")
PROMOTION_VERBS = ("doit ", "est tenu", "est interdit", "est interdite", "strictement interdit", "strictement interdite", "ne peut pas", "ne peut ", "est oblige", "sont tenus", "doivent ", "doit etre", "doit declarer", "doit tenir", "doit presenter", "doit fournir", "repond de", "repondent de", "est habilite", "est charge", "sont charges", "est rejete", "est recouvre", "est affecte", "entraine ", "sont rejetes", "doit etre presente", "doit comporter", "doit comprendre", "doit indiquer", "doit afficher", "est prouvee", "est fixe", "est fixee", "peut ", "peuvent ", "peut obliger", "peuvent obliger", "peut prescrire", "peuvent prescrire", "est passible", "sont passibles", "peut beneficier")
MODAL_COMPANIONS = ("a condition", "sous reserve", "ouvre droit", "ouvrent droit", "est ouvert aux", "sont ouverts aux", "beneficie", "beneficient", "participer", "justifiant", "titulaire", "titulaires", "anciennet", "diplom", "licence", "maitrise")

# Review.
REVIEW_VERBS = ((r"\b(est interdit de)\b", "est interdit de"), (r"\b(sont interdits de)\b", "sont interdits de"), (r"\b(est tenu de)\b", "est tenu de"), (r"\b(sont tenus de)\b", "sont tenus de"), (r"\b(doit)\b", "doit"), (r"\b(doivent)\b", "doivent"), (r"\b(ne peut pas)\b", "ne peut pas"), (r"\b(ne peuvent pas)\b", "ne peuvent pas"), (r"\b(peut)\b", "peut"), (r"\b(peuvent)\b", "peuvent"), (r"\b(repond(?:ent)? de)\b", "répond de"), (r"\b(est passible de)\b", "est passible de"))
REVIEW_CONDITIONS = (" si ", " lorsque ", " lorsqu'", " quand ", " en cas de ", " pour les ", " pour le ", " pour la ", " pour tout ", " pour toute ", " des lors que ", " sous reserve de ", " sous réserve de ")
REVIEW_EXCEPTIONS = (" sauf ", " sauf si ", " a l'exception de ", " à l'exception de ", " hors ", " excepté ", " excepte ")
EDIT_REASONS = ("TEXT_TOO_SHORT", "TEXT_TOO_LONG", "NO_LEGAL_SUBJECT", "NO_NORMATIVE_VERB")
