"""Articles of French legal texts. How headers, annexes, signatures and headings look, in their natural order.

Flags: i any case, u and U Unicode letters and classes, m lines, d only line feeds end lines.
"""

_SUFFIX = r"(?:[\s.]*\(?\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies|undecies|duodecies|nouveau)\s*\)?)?"
_NAMED = rf"(?:article\s+(?:unique|premier|1er|\d+){_SUFFIX}|art\.?\s*\d+(?:[-.]\d+)*{_SUFFIX})"
_NUMBERED = rf"\d{{1,3}}{_SUFFIX}\s*[-:–—.]"
_ARRETE = r"arr[êe]te(?:nt)?(?:\s+ce\s+qui\s+suit)?\s*[:;.]"

# Where an article begins: a name or a bare number at a line's start, a name with a dash anywhere.
HEADER = rf"(?iuU)^(?:{_NAMED}\s*\]?\s*[-:–—.]?|{_NUMBERED})"
# The first sign is looked at before the name, the name before what stands behind it: few places come to the long look back.
BEFORE_HEADER = rf"(?iuUdm)(?=[a\d])(?<!\w)(?:(?={_NAMED}|{_NUMBERED})(?<=^[ \t]{{0,40}}\[?[ \t]{{0,4}})|(?={_NAMED}\s*[-:–—]))"
ANNEX = r"(?iuUds)\n\s*(?:annexes?|tableaux?|liste)\b.*"

# Where OCR lost a line feed.
HARD_BREAKS = (
    rf"(?iuU)\s+(?=article\s+(?:unique|premier|1er|\d+){_SUFFIX}\s*[-:–—])",
    rf"(?iuU)\s+(?=art\.?\s*\d+(?:[-.]\d+)*{_SUFFIX}\s*[-:–—])",
    r"(?iuU)(?<=[.;:])\s+(?=\d{1,3}\s*[-:–—])",
    rf"(?iuU)(?<=[\n.;:])\s+(?=tunis,\s*le\b|le\s+ministre\b|la\s+ministre\b|la\s+cheffe\s+du\s+gouvernement\b|vu\b|{_ARRETE})",
)

# Words one of which every match of these holds, in lower case and plain letters; none known: always tried.
HARD_BREAK_WORDS = (("article",), ("art",), (), ("tunis", "ministre", "cheffe", "vu", "arr"))

# Lines that end an article, lines of the page, and those that only recall other texts.
PAGE = r"(?iuUd)^\s*(?:n[°o]\s*\d+\b|page\s+\d+\b).*journal\s+officiel"
VISA = r"(?iuU)^\s*vu\b"
END = (
    r"(?iuUd)^\s*(?:tunis,\s*le\b|le\s+ministre\b|la\s+ministre\b|la\s+cheffe\s+du\s+gouvernement\b|vu\b"
    rf"|{_ARRETE}|n[°o]\s*\d+\b.*journal\s+officiel"
    r"|(?:arr[êe]t[ée]|d[ée]cret|loi|d[ée]cision|circulaire|convention|r[èe]glement)\s+"
    r"(?:n[°o]\s*\d+|du\b|de\s+la\b|de\s+l['’]|gouvernemental\b|pr[ée]sidentiel\b|organique\b|constitutionnelle\b))"
)

# Clauses: what bridges two acts, titles and noise of the gazette, and words of a rule.
CLAUSE = r"(?U)(?<=[.;:])\s+"
_RULE = (
    r"doit(?:vent)?|est\s+tenu(?:e|s|es)?\s+de|interdit(?:e|es|s)?|b[ée]n[ée]fici\w*|communiqu\w*|transmett\w*|adress\w*|rej(?:ete|eter|eté)\w*"
    r"|prend\s+en\s+charge|entra[iî]ne\w*"
)
_RESERVE = r"sous\s+r[ée]serve\s+de|[àa]\s+condition\s+de"
NORMATIVE = rf"(?iuU)\b(?:{_RULE}|proc[eè]d\w*|redevien\w*|fait\s+foi|fix(?:e|ent|ée?s?)\w*|{_RESERVE})\b"
BRIDGE = rf"(?iuU)\bpar\s+(?:arr[êe]t[ée]|d[ée]cret|loi|d[ée]cision)\b[^.;:\n]{{0,220}}?(?=\b(?:{_RULE}|{_RESERVE})\b|[.;:]|$)"
ACT_TITLE = (
    r"(?iuU)\b(?:arr[êe]t[ée]|d[ée]cret|loi|d[ée]cision|circulaire|convention|r[èe]glement)\s+"
    r"(?:n[°o]\s*\d+|du\s+\d{1,2}\s+[a-zàâäéèêëîïôöùûüç]+\s+\d{4}|pr[ée]sidentiel|gouvernemental|organique|constitutionnelle)\b"
)
GAZETTE = r"(?iuU)\b(?:journal\s+officiel|tunis,\s*le|le\s+ministre\b|la\s+ministre\b|la\s+cheffe\s+du\s+gouvernement\b|n[°o]\s*\d+\b|page\s+\d+\b)\b"
BRIDGE_WORDS, ACT_WORDS, GAZETTE_WORDS, HEADING_WORDS = ("par",), ("arr", "cret", "loi", "cision", "circulaire", "convention", "glement"), ("journal", "tunis", "ministre", "cheffe", "page"), ("livre", "titre", "chapitre", "section")
NUMBERED_ISSUE = r"(?iuU)n[°o]\s*\d"  # what a clause of the gazette without such a word has
WORD = r"(?i)[a-zàâäéèêëîïôöùûüç0-9]{4,}"
COMMON_WORDS = ("article", "articles", "present", "presente", "presentes", "presents", "arrete", "decret", "loi", "decision", "circulaire", "convention", "reglement", "sont", "etre", "dans", "avec", "pour")
MAJOR_HEADING = r"(?iuU)\b(?:livre|titre|chapitre|section|sous[-\s]section)\b[^\n]{0,180}"

# An article that stops in the middle, and what its surroundings give it back.
OPEN_END = (
    r"(?iuU)(?:(?:du pr[ée]sent|[àa] l'article)$|\b(?:du|de|des|d['’]|au|aux|dans|sur|sous|par|pour|et|ou|le|la|les"
    r"|present|présent|presente|présente|titre|article|gouvernorats|campagne)\s*$)"
)
SENTENCE_END = r"[.!?;:]\s*$"
REPAIR = r"(?iuU)\b(?:r[ée]e?chelonn\w*|fonds\s+national\s+de\s+garantie|prend\s+en\s+charge|int[ée]r[êe]ts?|sous\s+r[ée]serve\s+de|[àa]\s+condition\s+de)\b"
LEGAL_START = r"(?iuU)\b(?:en\s+cas\s+de|lorsque|si\s+|doit|doivent|peut|peuvent|est|sont|interdit|tenu\s+de)\b"
