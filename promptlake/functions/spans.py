"""Spans that compression must give back as they were, by kind, as patterns of Python's ``re``."""

from __future__ import annotations

import re

# Kinds of protected spans in the order in which they are taken, larger ones first; pattern and flags.
PROTECTED = (
    ("code", r"(```[\w]*\n.*?\n```|~~~[\w]*\n.*?\n~~~)", re.DOTALL),
    ("yaml", r"^---\n.*?\n---", re.MULTILINE | re.DOTALL),
    ("json", r"\{(?:[^{}]|(?:\{[^{}]{0,500}\})){0,500}\}", 0),
    ("xml", r"<[^>]+>[^<]*</[^>]+>|<[^>]+/>", 0),
    ("math", r"\b[a-zA-Z]\s*[=<>≈≠≤≥±∓×÷∑∏∫∂∇√∞∧∨⊕⊗]\s*[a-zA-Z0-9]|\\\(.*?\\\)|\\\[.*?\\\]|\$[^$]+\$|\$\$[^$]+\$\$", 0),
    ("quoted", r""""(?:[^"\\]|\\.)*"|(?<!\w)\'(?:[^\'\\]|\\.)*\'(?!\w)|«(?:[^»]|\\.)*»|「(?:[^」]|\\.)*」""", 0),
    ("inline_code", r"`[^`\n]+`", 0),
    ("url", r"""https?://[^\s<>"\'(){}]+(?<![.,;!?)\]}>])""", re.I),
    ("semi_url", r"""www\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}[^\s<>"\'(){}]*""", re.I),
    ("iso_datetime", r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", 0),
    ("time_range", r"\b\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\s*[-–to]{1,3}\s*\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\b", 0),
    ("date", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b|\b\d{2}\s+[A-Z][a-z]+\s+\d{4}\b|\b[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}\b", re.I),
    ("time", r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b", 0),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0),
    ("phone", r"(?:(?:\+?\d{1,3}[-. ]?)?\(?\d{2,4}\)?[-. ]?\d{2,4}[-. ]?\d{2,4})(?!\d)", 0),
    ("social", r"@[a-zA-Z0-9_]{1,15}\b", 0),
    ("currency", r"[\$€£¥₩₽₹₿]\s*\d+(?:[.,]\d+)*(?:\s+(?:USD|EUR|GBP|JPY|CHF|KRW|RUB|INR|BTC))?|\b\d+(?:[.,]\d+)*\s*(?:USD|EUR|GBP|JPY|CHF|KRW|RUB|INR|BTC)\b", 0),
    (
        "unit",
        r"\b\d+(?:\.\d+)?\s*(?:mg|g|kg|ml|l|cl|dl|cm|m|km|mm|µm|nm|°[CF]|°[cf]|°C|°F|K|V|W|A|Hz|GHz|MHz|kWh|mph|km/h|m/s|nmi|kn|%|‰|‱|px|em|rem|vw|vh|dpi|ppi|ms|s|min|h|d|wk|mo|yr|GB|MB|TB|kb|mb|gb|tb|bps|kbps|mbps|gbps|"
        r"kl|hl|daL|nL|pL|mol|M|mM|µM|nM|Pa|kPa|MPa|atm|bar|psi|N|J|kJ|cal|kcal|eV|Bq|Gy|Sv|kat)\b",
        re.I,
    ),
    ("legal_ref", r"\b(?:Article|Section|Clause|Paragraph|Part|Title|Chapter|Subclause|Subsection|Appendix|Schedule|Chapitre|Annexe|Paragraphe|Alinéa|Titre)\s+\d+(?:\.\d+)*(?:\.\d+)*\b", re.I),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0),
    (
        "ipv6",
        r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|(?:[0-9a-fA-F]{1,4}:){1,7}:|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}|"
        r"(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}|"
        r":(?::[0-9a-fA-F]{1,4}){1,7}|::",
        0,
    ),
    ("port", r":\d{2,5}(?=[\s,;)\]}.!?:;]|$)", 0),
    ("semver", r"\bv?\d+\.\d+\.\d+(?:-[a-zA-Z0-9.]+)?(?:\+[a-zA-Z0-9.]+)?\b", 0),
    ("uuid", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", re.I),
    ("hash", r"\b[0-9a-f]{32,64}\b", re.I),
    ("hex_color", r"#[0-9a-fA-F]{3}(?:[0-9a-fA-F]{3})?\b", 0),
    ("chemical", r"\b(?:H2O|CO2|O2|N2|NaCl|C6H12O6|CH4|NH3|H2SO4|HCl|NaOH|C2H5OH|C3H8|C8H18|(?=[A-Za-z]*\d)[A-Z][a-z]?\d*(?:[A-Z][a-z]?\d*)*)\b", 0),
    ("coords", r"""\b(-?\d+\.?\d*)\s*[°˚]\s*\d{1,2}\'\s*\d{1,2}(?:\.\d+)?\"?\s*[NSEWO]?\b|\b(-?\d+\.\d+),\s*(-?\d+\.\d+)\b""", 0),
    ("percent", r"\b\d+(?:\.\d+)?\s*%\b", 0),
    ("path", r"(?:/[^\s/]+){2,}(?:\.[a-zA-Z0-9]+)?|(?:[A-Za-z]:(?:\\[^\s\\]+){2,}(?:\.[a-zA-Z0-9]+)?)", re.I),
    ("html_entity", r"&[a-zA-Z]+;|&#\d+;|&#x[0-9a-fA-F]+;", 0),
    ("placeholder", r"\{\{[^}]+\}\}|\{\w+\}|%[sd]|<\s*\w+\s*/?>|<%\s*\w+\s*%>", 0),
)

# Characters of which every span of a kind has one; a text without them is not searched for the kind. Other kinds have no such few.
NEEDS = {
    "json": "{", "xml": "<", "url": ":", "semi_url": ".", "time_range": ":", "time": ":", "email": "@", "social": "@", "ipv4": ".", "ipv6": ":", "port": ":", "semver": ".",
    "uuid": "-", "hex_color": "#", "coords": "°˚.", "percent": "%", "path": "/\\", "html_entity": "&", "placeholder": "{%<", "inline_code": "`", "code": "`~", "yaml": "-", "iso_datetime": ":",
    "math": "=<>≈≠≤≥±∓×÷∑∏∫∂∇√∞∧∨⊕⊗\\$", "quoted": "\"'«「",
}
#: Kinds of which every span has a digit, of any script.
NUMBERED = frozenset(("date", "phone", "legal_ref", "currency", "unit", "ipv4", "coords", "percent", "time", "time_range", "iso_datetime", "port", "semver"))

#: What spans of a kind hold that have no digit; the fewest characters, none of them white space, of a kind; what a kind holds, or else how many colons.
UNNUMBERED, LONG, COLONS = {"chemical": ("NaCl", "HCl", "NaOH")}, {"hash": 32}, {"ipv6": ("::", 7)}

# The phases of each profile that change a text, in order.
PHASES = {
    "safe": ("exact_dedup", "structural"),
    "light": ("exact_dedup", "structural"),
    "balanced": ("exact_dedup", "near_dedup", "structural", "lexical", "logical"),
    "aggressive": ("semantic_chunk", "exact_dedup", "near_dedup", "structural", "lexical", "logical", "temporal"),
    "max": ("semantic_chunk", "exact_dedup", "near_dedup", "structural", "lexical", "logical", "temporal"),
    "industrial": ("semantic_chunk", "exact_dedup", "near_dedup", "structural", "lexical", "logical", "temporal"),
}
# Least likeness of a chunk with the intent by profile, of a text with its compressed form, and from which length blocks are compared.
CHUNK_LIKENESS = {"aggressive": 0.20, "max": 0.25, "industrial": 0.30}
LEAST_SIMILARITY, LEAST_SIMILARITY_INDUSTRIAL, MOST_TOKENS, NEAR_LENGTH = 0.60, 0.55, 2.0, 200
