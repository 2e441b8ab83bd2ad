"""Expressions that must be what they are for the same rows to be found, stated as they are, in order."""

# Negated hate.
NEGATION = (
    r"\bdo\s+not\s+\w+",
    r"\bdon't\s+\w+",
    r"\bnever\s+\w+",
    r"\bno\s+one\s+should\s+\w+",
    r"\bshould\s+not\s+\w+",
    r"\bshouldn't\s+\w+",
    r"\bnot\s+(?:hate|attack|threaten|kill|deport|exclude)\b",
)

# Hate that is answered.
COUNTERSPEECH = (
    r"\b(?:stop|oppose|reject|fight|condemn|call\s+out)\s+(?:hate|racism|antisemitism|islamophobia|homophobia|transphobia)\b",
    r"\b(?:racism|antisemitism|islamophobia|homophobia|transphobia)\s+(?:is|are)\s+(?:wrong|unacceptable|bad)\b",
    r"\bstand\s+with\b",
    r"\bsupport\s+(?:refugees|immigrants|muslims|jews|women|disabled|trans|gay|lgbt)\b",
    r"\bdo\s+not\s+(?:attack|threaten|hate|deport|exclude)\b",
)

# Hate that is quoted or reported.
REPORT = (
    r'["\'].+?["\']',
    r"\b(?:said|says|called|reported|reports|quoted|quotes|documented|documenting|wrote|posted)\b",
)

# Identifiers that show by their form, letters in either case but for the handles.
URL = r"\b(?:https?://|hxxps?://|www\.)[^\s<>()]+"
USER = r"(?<!\w)@[A-Za-z0-9._-]{1,64}\b"
ADJACENT_USER = r"@[A-Za-z0-9._-]{1,64}\b"
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{2,4})\b"
AGE = (
    r"\b(?:I am|I'm|aged?)\s+(\d{1,2})(?:\s+years?\s+old)?\b",
    r"\b\d{1,2}[- ]year[- ]old\b",
)
IDENTIFIER = r"\b(?:id|case|ticket|student|user|ref)[-_:#]?(?:[A-Z0-9]+[-_])*[A-Z0-9]*\d[A-Z0-9_-]*\b"

# Addresses that are spelt out, letters in either case.
SPELT_SIGN = r"(?P<at>\s+at\s+|\s*\[\s*at\s*\]\s*|\s*\(\s*at\s*\)\s*|\s*@\s*)|(?P<dot>\s+dot\s+|\s*\[\s*dot\s*\]\s*|\s*\(\s*dot\s*\)\s*)"
SPELT_MARKER = r"@|\[\s*(?:at|dot)\s*\]|\(\s*(?:at|dot)\s*\)|_(?:at|dot)_"
SPELT_EMAIL = (
    r"(?<![\w@])"
    r"(?P<local>[A-Z0-9][A-Z0-9._%+-]{1,63})"
    r"\s*(?P<at_marker>\[\s*at\s*\]|\(\s*at\s*\)|_at_|\bat\b)\s*"
    r"(?P<domain>[A-Z0-9-]{2,63}(?:(?:\s+|[._-]+)[A-Z0-9-]{2,63}){0,3})"
    r"\s*(?P<dot_marker>\[\s*dot\s*\]|\(\s*dot\s*\)|_dot_|\bdot\b)\s*"
    r"(?P<tld>[A-Z]{2,24})"
    r"(?![\w@])"
)

# Marks of personal style.
PLACEHOLDER = r"(\[[A-Z][A-Z_]*(?::[A-Za-z0-9_/-]+)?\])"
TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?"
REPEATED_LETTER = r"([A-Za-z])\1{2,}"
REPEATED_PUNCTUATION = r"[!?]{2,}|\.{2,}|,{2,}"
SYMBOL_BURST = r"(?<!\[)[#$%&*+=~_^|<>/\\]{3,}(?!\])"
HASHTAG = r"(?<!\w)#([A-Za-z][A-Za-z0-9_]{2,})\b"
SIGNATURE = (
    r"(?im)(?:^|\n)\s*(?:--+|~~+)\s*[A-Za-z0-9_ .,'-]{0,80}\s*$",
    r"(?i)(?:^|\s)(?:--+|~~+)?\s*(?:sent from my|signature:|signed,|xoxo,)\s+[A-Za-z0-9_ .,'-]{0,80}$",
)

# What makes a row worth a second look.
PERSON_AMBIGUITY = (
    r"\b(?:kill|threaten|call|called|email|emailed|dm|message|said|says|posted|reported)\s+"
    r"([A-Z][A-Za-z.'-]{2,}(?:\s+[A-Z][A-Za-z.'-]{2,}){0,2})\b"
)
QUASI_CONTEXT = (
    r"\b(?:from|near|at|in|works at|studies at|school at)\s+"
    r"[A-Z][A-Za-z0-9.'-]{2,}(?:\s+[A-Z][A-Za-z0-9.'-]{2,}){0,4}\b"
)
TARGET_AMBIGUITY = r"(?:#\w{5,}|[A-Za-z0-9]\s+[A-Za-z0-9]\s+[A-Za-z0-9])"
