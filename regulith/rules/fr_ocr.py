"""French scans. Patterns of what OCR leaves in legal texts, and what replaces it, in the order of use.

Flags: i any case, u and U Unicode letters and classes, m lines, d only line feeds end lines.
"""

_BIS = r"(?:\s*\(?\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies|undecies|duodecies)\s*\)?)?"
_NAME = r"[A-ZÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ][a-zàâäéèêëîïôöùûüç'’-]{2,}"
_LETTER = "A-Za-zÀ-ÿ"
_LOWER = "a-zàâäéèêëîïôöùûüç"

ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿ]+"
FUSED_MODAL = r"(?iuU)(?<=[a-z])(?=(?:est\s+tenu(?:e|s|es)?(?:\s+de|\b)|sont\s+tenus?(?:\s+de|\b)|doit(?:vent)?\b|interdit(?:e|es|s)?\b|peu(?:t|vent)\b|communiqu\w+\b|transmett?\w+\b|adress\w+\b))"
INLINE_HEADING = r"(?iuU)(?<=[a-z])\s+(?:chapitre|section|titre|livre)\s+[ivxlcdm0-9]+\s*[-.:]?\s+(?=[a-z])"
DUPLICATE_MODAL = r"(?iuU)\b(?:do|de|d)\s+(doit(?:vent)?)\b"

# The normaliser: counter, pattern, replacement.
LEGAL_STEPS = (
    ("soft_hyphen", "­", ""),
    ("zero_width", "[​‌‍⁠﻿]", ""),
    ("hyphen_linebreak", r"(?U)(?<=\w)[\-‐-—]\s*\n\s*(?=\w)", ""),
    ("ocr_pipe", r"(?U)(?<=\w)\|(?=\w)", "l"),
    ("arabic", ARABIC, " "),
    ("word_digit", r"(?U)(?<=[A-Za-z])\d+(?=[A-Za-z]|\s)", ""),
    ("duplicate_modal", DUPLICATE_MODAL, "$1"),
    ("inline_heading", INLINE_HEADING, " "),
    ("fused_modal", FUSED_MODAL, " "),
    ("page_number", r"(?Udm)^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$", ""),
    ("page_header", r"(?iuUdm)^\s*(?:journal\s+officiel|republique\s+tunisienne|jort)\b.*$", ""),
    ("trailing_space", r"(?dm)[ \t]+$", ""),
    ("space_before", r"(?U)\s+([,;:.!?])", "$1"),
    ("space_after", r"(?U)([,;:.!?])(?=\S)", "$1 "),
    ("space_run", r"[ \t]{2,}", " "),
    ("blank_lines", r"\n{3,}", "\n\n"),
)

# Repairs of a line: pattern, replacement.
# Few places have a digit or a capital: that is looked for first.
WORD_DIGIT = rf"(?U)(?=\d)(?:(?<=[{_LETTER}])\d+(?=[{_LETTER}])|(?<=[{_LETTER}]{{3}})\d+\b|\b\d+(?=[{_LETTER}]{{3}}))"
DUPLICATED_TOKEN = rf"(?iuU)\b([{_LOWER}]{{4,}})\1\b"
LEADING_NOISE = r"(?U)^[\]\[(){}:;,\.-]+\s*"
LINE_REPAIRS = (
    (ARABIC, " "),
    (WORD_DIGIT, ""),
    (DUPLICATE_MODAL, "$1"),
    (DUPLICATED_TOKEN, "$1"),
    (INLINE_HEADING, " "),
    (FUSED_MODAL, " "),
    (r"(?iuU)^\s*(?:art\.?|article)\s*[-:'’\"]+\s*", ""),
    (LEADING_NOISE, ""),
)

# Signs and suspicious tokens of the artefact score.
MIDWORD_UPPER = rf"(?U)\b[{_LOWER}]{{2,}}[A-Z]{{2,}}[{_LOWER}]+\b"
SIGNALS = (ARABIC, WORD_DIGIT, FUSED_MODAL, INLINE_HEADING, DUPLICATE_MODAL, MIDWORD_UPPER, DUPLICATED_TOKEN, LEADING_NOISE)
TOKEN = rf"[{_LETTER}0-9']+"
SUSPICIOUS_TOKEN = rf"(?U)(?:[{_LETTER}]{{3,}}\d+|\d+[{_LETTER}]{{3,}}|[{_LOWER}]{{2,}}[A-Z]{{2,}}[{_LOWER}]+|([{_LETTER}]{{4,}})\1)"
HEAVY, HEAVY_WITH_SIGNALS = 0.18, 0.10

# The sanitiser: where lines begin, which lines go, which stay, what goes from the lines joined.
HARD_BREAK = (
    r"(?iuUd)\s+(?=(?:"
    rf"article\s+(?:premier|1er|unique|\d+){_BIS}\s*[-:–—]"
    rf"|art\.?\s*\d+(?:[-\.]\d+)*{_BIS}\s*[-:–—]"
    r"|tunis,\s*le\b|le\s+ministre\b|la\s+ministre\b|la\s+cheffe\s+du\s+gouvernement\b"
    rf"|monsieur\s+[{_LOWER}'’-]+|madame\s+[{_LOWER}'’-]+"
    r"|n[°o]\s*\d+\b.*journal\s+officiel|page\s+\d+\b.*journal\s+officiel))"
)
PAGE_LINE = r"(?iuUd)^\s*(?:n[°o]\s*\d+\b.*journal\s+officiel|page\s+\d+\b.*journal\s+officiel)\s*$"
PAGE_MENTION = r"(?iud)^(?:n° |page ).*journal officiel"
SIGNATURE_LINE = r"(?iuU)^\s*(?:tunis,\s*le\b|le\s+ministre\b|la\s+ministre\b|la\s+cheffe\s+du\s+gouvernement\b|arr[êe]tent\s*:|arr[êe]te\s*:|vu\b)\s*"
PERSON_LINE = r"(?iuU)^\s*(?:monsieur|madame|mme\.?|m\.)\b"
NAME_LINE = rf"(?U)^(?:{_NAME})(?:\s+{_NAME}){{1,3}}$"
NORMATIVE_KEEP = (
    r"(?iuU)\b(?:doit(?:vent)?|est\s+tenu(?:e|s|es)?\s+de|interdit(?:e|es|s)?|b[ée]n[ée]fici\w*|communiqu\w*|transmett\w*|adress\w*|rej(?:ete|eté|eter)\w*"
    r"|prend\s+en\s+charge|entra[iî]ne\w*|proc[eè]d\w*|redevien\w*|fait\s+foi|fix(?:e|ent|ée?s?)\w*|sous\s+r[ée]serve\s+de|[àa]\s+condition\s+de)\b"
)
INLINE_NOISE = (
    (rf"(?iuU)\b(?:le|la)\s+ministre\b[^.;:\n]{{0,120}}\b(?:{_NAME}\s+){{1,3}}{_NAME}\b", " "),
    (rf"(?iuU)\bla\s+cheffe\s+du\s+gouvernement\b[^.;:\n]{{0,100}}\b(?:{_NAME}\s+){{1,3}}{_NAME}\b", " "),
    (rf"(?iuU)\b(?:monsieur|madame|mme\.?|m\.)\s+{_NAME}(?:\s+{_NAME}){{0,3}}[^.;:\n]{{0,120}}", " "),
    (rf"(?iuU)\b(par\s+les\s+)(?:{_NAME}\s+){{1,4}}(articles?\b)", "$1$2"),
    (rf"(?iuU)\b(cr[ée]dits?\s+)(?:{_NAME}\s+){{1,4}}(de\s+campagne\b)", "$1$2"),
    (r"(?iuU)\bvu\s+(?=susvis[ée]e?\b)", " "),
    (r"(?iuUd)\b(bureau\s+d['’]ordre)\s+(?:(?!\bde\s+l['’]administration\b).){20,220}\b(de\s+l['’]administration\b)", "$1 $2"),
    (r"(?iuU)\b(prend\s+en\s+charge)\s+(?:[^.;:\n]{1,80},\s*){2,}[^.;:\n]{1,80}\s+et\s+(?=\s*int[ée]r[êe]ts?)", "$1 "),
    (r"(?=[A-ZÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ])(?<=[a-zàâäéèêëîïôöùûüç])", " "),
)
NAME_LIST = rf"(?U)(?:\b{_NAME}(?:\s+{_NAME}){{0,2}}\b,\s*){{3,}}\b{_NAME}(?:\s+{_NAME}){{0,2}}\b"
SIGNED_ON = rf"(?iuU)\btunis,\s*le\s+\d{{1,2}}\s+[{_LOWER}]+\s+\d{{4}}\b"
EDGES = " ,;:-"

# Words one of which every match of a pattern holds, in lower case and plain letters.
WORDS = {
    DUPLICATE_MODAL: ("doit",),
    INLINE_HEADING: ("chapitre", "section", "titre", "livre"),
    FUSED_MODAL: ("tenu", "doit", "interdit", "peut", "peuvent", "communiqu", "transmet", "adress"),
    HARD_BREAK: ("art", "tunis", "ministre", "cheffe", "monsieur", "madame", "journal"),
    **dict(zip((p for p, _ in INLINE_NOISE), (("ministre",), ("cheffe",), ("monsieur", "madame", "mme", "m."), ("par",), ("campagne",), ("susvis",), ("bureau",), ("prend",)))),
    SIGNED_ON: ("tunis",),
}
