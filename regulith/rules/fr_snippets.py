"""How a citation is cut out of its source. The compliance domain's own patterns, in their natural order.

Java flags: i any case, u and U Unicode letters and boundaries.
"""

OVERLAP_MARK = r"\[\s*\.\.\.\s*\]"
DOUBLED = ((r"(?iuU)\bil\s+il\b", "il", ("il il",)), (r"(?iuU)\belle\s+elle\b", "elle", ("elle elle",)))  # and what every match in a text of single blanks holds
LEADING_SIGNS = r"^[\]\[(){}:;,\.-]+\s*"
SENTENCE_SPLIT = r"(?U)(?<=[\.;:])\s+|\n+"
CLAUSE_SPLIT = (
    r"(?uU),\s+(?=(?:(?:et|ou)\s+)?(?:sans\b|sauf\b|si\b|lorsque\b|en\s+cas\s+de\b|à\s+condition\s+de\b|a\s+condition\s+de\b|sous\s+r[ée]serve\b|"
    r"ne\s+peu(?:t|vent)\b|doit(?:vent)?\b|est\s+tenu(?:e|s|es)?\s+de\b|sont\s+tenus\s+de\b|peut\b|peuvent\b|communiqu\w+\b|transmett\w+\b|"
    r"adress\w+\b|conclu\w+\b|prend\s+en\s+charge\b|(?:est|sont)\s+présent\w+\b|(?:est|sont)\s+fix\w+\b))"
)
INLINE_SPLIT = r"(?uU)\s+(?=(?:et|ou)\s+(?:sans\b|sauf\b|si\b|lorsque\b|en\s+cas\s+de\b|à\s+condition\s+de\b|a\s+condition\s+de\b|sous\s+r[ée]serve\b))"
INTRO_CUE = r"(?iuU)\b(?:sans|sauf|si\b|lorsque\b|en\s+cas\s+de\b|à\s+condition\s+de\b|a\s+condition\s+de\b|sous\s+r[ée]serve\b)\b"
INTRO_MARKERS = ("doit", "doivent", "est tenu de", "est tenue de", "sont tenus de", "peut", "peuvent", "s'effectuer", "communique", "communiquent", "transmet", "transmettent", "adresse", "adressent", "conclut", "concluent", "prend en charge", "sont presentes", "sont présentées", "est presente", "est présentée")
INTRO_LEAST = 18
DANGLING_END = r"(?iuU)\b(?:contre|par|pour|de|du|des|d['’]|au|aux|a|à|sur|sous|dans|avec|et|ou)$"
CONDITION_CUES = ("à condition", "a condition", "sous réserve", "sous reserve", "sauf", "en cas de", "lorsque", "si ")
NORM_CUES = ("doit", "doivent", "interdit", "sauf", "lorsque", "en cas de")
# Of each cue a word.
CONDITION_WORDS = ("condition", "serve", "sauf", "cas", "lorsque", "si")
NORM_WORDS = ("doit", "doivent", "interdit", "sauf", "lorsque", "cas")
TOKEN = r"[a-zàâäéèêëîïôöùûüç0-9]{3,}"
STOP = ("les", "des", "dans", "avec", "pour", "sur", "par", "une", "du", "de", "la", "le", "au", "aux", "est", "sont", "etre", "été", "ete", "qui", "que", "dont", "ainsi", "tout", "toute", "tous", "toutes", "present", "présent", "presente", "présente", "article", "articles", "loi", "decret", "arrête", "arrete")
LEAST, MOST, WIDEST = 0.18, 280, 420

# Chains of actions under one subject.
_MODAL = r"(?:doit|doivent|peut|peuvent|est\s+tenu(?:e|s|es)?\s+de|sont\s+tenu(?:s|es)?\s+de|est\s+habilit[ée]?\s+[àa]|sont\s+habilit[ée]s?\s+[àa]|est\s+charg[ée]?\s+de|sont\s+charg[ée]s?\s+de)"
_INFINITIVE = r"[a-zàâäéèêëîïôöùûüç'-]{3,}(?:er|ir|re|oir)\b"
MODAL = rf"(?iuU)\b{_MODAL}\b"
AUXILIARY_CHAIN = r"(?iuU)^(.+?)\s+(est|sont)\s+(.+?)\s+\bet\s+(est|sont)\s+(.+)$"
MODAL_CHAIN = rf"(?iuU)^(.+?{_MODAL})\s+(.+)$"
CHAIN_SIGN = rf"(?iuU)\bet\s+(?:est|sont)\s|\b{_MODAL}\s"
# What every sign of a chain holds: a word of a modal, or the auxiliary.
CHAIN_WORDS = ("doit", "doivent", "peut", "peuvent", "tenu", "habilit", "charg")
AUXILIARY_SIGN = r"(?iuU)\bet\s+(?:est|sont)\s"
LIST_SPLIT = r"(?U)\s*;\s*|\s*(?:\n|•)\s*"
AND_SPLIT = rf"(?iuU)\s+\bet\s+(?=(?:[àa]\s+|de\s+)?{_INFINITIVE})"
COMMA_SPLIT = r"(?iuU)\s*,\s*(?=(?:[àa]\s+|de\s+)?(?:etre|être|[a-zàâäéèêëîïôöùûüç'-]{3,}(?:er|ir|re|oir))\b)"
ITEM_SIGN = r"^(?:-|\d+[.)]?|[a-z][.)])\s*"
LINK = r"(?iuU)^(?:[àa]\s+|de\s+)"
LINK_END = r"(?iuU)(?:à|a|de)\s*$"

# Fall-backs of units whose extraction is empty, or misses who supervises.
FALLBACK_TRIGGER = r"(?iuU)\b(?:doit(?:vent)?|est\s+tenu(?:e|s|es)?(?:\s+de|\b)|interdit(?:e|es|s)?|benef\w*|prend\s+en\s+charge|communiqu\w*|transmett?\w*|adress\w*|notifi\w*|fourn\w*|sous\s+reser\w*|condition\b|fix\w*|entrai\w*)\b"
FALLBACK_NORM = r"(?iuU)\b(?:doit(?:vent)?|est\s+tenu(?:e|s|es)?\s+de|interdit(?:e|es|s)?|communiqu\w+|transmett?\w+|adress\w+|notifi\w+|fourn\w+|registre|tenir\s+un\s+registre)\b"
FALLBACK_HEADING = r"(?iuU)\b(?:chapitre|section|titre|livre)\b"
FALLBACK_LEAST, CANDIDATE_LEAST, SENTENCE_LEAST = 40, 20, 30
SUPERVISION = r"(?iuU)\best\s+supervis[ée]e?s?\s+par\s+(?:un|une|le|la)\s+(?:jury|commission|comit[ée])\b"
COMPOSITION_FIXED = r"(?iuU)\b(?:composition\b[^.;:]{0,160}\bfix[ée]e?s?\b|fix[ée]e?s?\b[^.;:]{0,160}\bcomposition\b)"

# Statements with several obligations.
SPLITTABLE_TYPES = ("OBLIGATION", "DECLARATION", "REGISTRE", "CONTROLE")
DOCUMENT_INTRO = r"(?iuU)^(.+?\b(?:doit|doivent)\s+(?:indiquer|mentionner|comprendre|comporter|contenir|enumerer|énumérer|etre\s+accompagn[ée]?\s+de|être\s+accompagn[ée]?\s+de|etre\s+assorti\s+de|être\s+assorti\s+de))\s+(.+)$"
WARNING = r"(?iuU)^(lorsque[^,]+,\s*)([^,]*?)doit\s+en avertir l'employeur\s+et\s+attendre\s+ses\s+instructions\s+(s['’]il n['’]?y a pas péril en la demeure\.?)$"
WARN, WAIT, WARNED = "doit en avertir l'employeur.", "doit attendre ses instructions", "le salarié"
REPEATED_LEAD = rf"(?iuU)^(.+?)\s+({_MODAL})\s+(.+)$"
REPEATED_SPLIT = rf"(?iuU)\s*(?:,|;|\bet\b)\s+(?=(?:{_MODAL})\b)"
MODAL_START = rf"(?iuU)^(?:{_MODAL})\b"
COMPOSITION_CHAIN = r"(?iuU)^(.+?\bcompos\w+\s+de)\s+(.+?)\s*;\s*(?:et\s+)?de\s+(.+)$"
COLON_LIST = rf"(?iuU)^(.+?{_MODAL})\s*:\s*(.+)$"
LEADING_AND = r"(?iuU)^et\s+"
