"""Word lists, patterns and constants that define the results.

They are data, not logic. Word lists are defaults of parameters; patterns are used as they are.
"""

# Modal verb forms.
MODAL_VERBS = (
    "devoir", "pouvoir", "vouloir", "falloir", "savoir",
    "doi", "doit", "doivent", "devons", "devez", "devrait", "devraient",
    "peut", "peuvent", "pouvons", "pourrait", "pourraient",
    "faut", "faudrait",
    "veux", "veut", "voulons", "voudrais", "voudrait",
)

# Explicit markers of an administrative line (case-insensitive).
ADMIN_MARKERS = (
    r"sciences\s*po",
    r"cevipof",
    r"imprimerie",
    r"vu,?\s*le\s+candidat",
    r"suppléante?\s*:",
    r"remplaçant\s+éventuel",
    r"[eé]lections?\s+(?:l[eé]gislatives?|pr[eé]sidentielles?)",
    r"\d+(?:e|eme|ème|er|re)?\s*(?:circonscription|arrondissement)",
    r"rassemblement\s+pour\s+la\s+r[eé]publique",
    r"union\s+pour\s+une\s+nouvelle\s+majorit",
)

# Biographical lines (case-sensitive): an age, or "Firstname SURNAME".
BIOGRAPHY_PATTERNS = (
    r"\b\d{2}\s+ans\b",
    r"^\s*[A-ZÉÈÀÊ][a-zéèàê]+\s+[A-ZÉÈÀÊ]{2,}",
)

# Verb endings and auxiliaries (case-insensitive).
VERB_ENDINGS = (
    "ons", "ez", "ais", "ait", "aient", "ions", "iez", "erai", "eras", "era",
    "erons", "erez", "eront", "âmes", "âtes", "èrent",
)
AUXILIARIES = (
    "est", "sont", "était", "étaient", "sera", "seront", "ont", "avons", "avez",
    "avoir", "être",
)

# A line under this many words needs a verb; shorter sentences are dropped.
MIN_LINE_WORDS = 6
MIN_SENTENCE_WORDS = 4

# Month names of a written date.
MONTHS = (
    "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
    "septembre", "octobre", "novembre", "décembre",
)

# Numbers, dates, money and percentages inside a sentence.
DIGIT_PATTERN = r"\d+"
DATE_PATTERNS = (
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}",
    r"\b(?:" + "|".join(MONTHS) + r")\s+\d{4}\b",
)
MONEY_PATTERN = r"\b\d+\s?(?:€|euros?|milliards?|millions?)\b"
PERCENT_PATTERN = r"\d+[.,]?\d*\s*%"

# Abbreviations whose period does not end a sentence; a default, not a fixed value.
ABBREVIATIONS = (
    "M", "MM", "Mme", "Mmes", "Mlle", "Mlles", "Me", "Mgr", "Dr", "Pr", "St", "Ste",
    "art", "al", "av", "bd", "cf", "chap", "dép", "éd", "env", "ex", "fig", "hab",
    "max", "min", "n", "no", "p", "pp", "tél", "vol",
)

# Missing-value tokens of a label sheet.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
