"""Word lists and rewrite rules of the text operators, as plain phrases.

A phrase becomes a case-insensitive pattern by ``pattern``: white space matches any run of white space, and the ends are ends
of words.
"""

from __future__ import annotations

import re

# Connectives that are rewritten to one word, in the order in which they apply.
LOGICAL_EN = (
    ("because|since|as|due to|owing to", "as"),
    ("therefore|thus|hence|consequently|as a result|accordingly|for this reason", "so"),
    ("if|provided that|providing that|as long as|on condition that|assuming that", "if"),
    ("unless|except when|except if", "unless"),
    ("however|but|nevertheless|nonetheless|although|though|even though|whereas|while|conversely|in contrast", "but"),
    ("moreover|furthermore|in addition|additionally|besides|what is more|further|also", "also"),
    ("in order to|so as to|for the purpose of|with the aim of", "to"),
)
LOGICAL_FR = (
    ("parce que|car|puisque|étant donné que|en raison de|grâce à|à cause de", "car"),
    ("donc|ainsi|par conséquent|en conséquence|c'est pourquoi|de ce fait", "donc"),
    ("si|à condition que|pourvu que|dans l'hypothèse où|supposé que", "si"),
    ("à moins que|sauf si|excepté si", "sauf si"),
    ("cependant|mais|néanmoins|toutefois|bien que|quoique|alors que|tandis que|en revanche|au contraire|pourtant|or", "mais"),
    ("de plus|en outre|par ailleurs|de surcroît|également|aussi|en plus", "aussi"),
    ("afin de|pour que|de sorte que|dans le but de|en vue de", "pour"),
)
TEMPORAL_EN = (("while|during|meanwhile|simultaneously|at the same time", "as"),)
TEMPORAL_FR = (("pendant|durant|entre-temps|simultanément|en même temps", "comme"),)

# Long phrases and their short forms, redundant pairs, abbreviations, in the order in which they apply.
PHRASES_EN = (
    ("due to the fact that", "since"), ("in spite of the fact that", "although"), ("in the event that", "if"), ("in order to", "to"), ("for the purpose of", "to"),
    ("as a result of", "because"), ("as a consequence", "so"), ("in light of", "given"), ("on the basis of", "by"), ("by means of", "via"), ("in accordance with", "per"),
    ("in line with", "per"), ("provided that", "if"), ("assuming that", "if"), ("on condition that", "if"), ("with regard to", "regarding"), ("in relation to", "about"),
    ("with respect to", "re"), ("with reference to", "re"), ("in the context of", "in"), ("when it comes to", "for"), ("on behalf of", "for"), ("on the topic of", "on"),
    ("with regards? to", "about"), ("in terms of", "in"), ("at this point in time", "now"), ("at the present time", "now"), ("at this time", "now"), ("in the near future", "soon"),
    ("in the meantime", "meanwhile"), ("prior to", "before"), ("subsequent to", "after"), ("previous to", "before"), ("following which", "then"), ("a sufficient number of", "enough"),
    ("a large number of", "many"), ("a small number of", "few"), ("a significant number of", "many"), ("a great deal of", "much"), ("a lot of", "many"), ("the majority of", "most"),
    ("a significant amount of", "much"), ("in close proximity to", "near"), ("in the vicinity of", "near"), ("in excess of", "over"), ("on a regular basis", "regularly"),
    ("in a timely manner", "promptly"), ("in a similar vein", "similarly"), ("as per usual", "usually"), ("has the ability to", "can"), ("is able to", "can"), ("is capable of", "can"),
    ("has the capacity to", "can"), ("with the exception of", "except"), ("in the absence of", "without"), ("as well as", "and"), ("in addition to", "plus"),
    ("the question as to whether", "whether"), ("in the case of", "for"), ("in regards? to", "re"), ("as far as", "for"),
    ("whether or not", "whether"), ("each and every", "each"), ("first and foremost", "first"), ("any and all", "all"), ("basic essentials?", "essentials"), ("null and void", "void"),
    ("for example", "e.g."), ("for instance", "e.g."), ("that is", "i.e."), ("in other words", "i.e."), ("such as", "like"), ("in particular", "notably"), ("especially", "esp."), ("particularly", "esp."),
)
# Words that are dropped.
FLUFF_EN = (("basically|actually|literally|essentially|virtually|practically|relatively|fundamentally|quite|rather|somewhat|really|very", ""),)
# Polite phrases and instructions that a prompt can do without; patterns, applied in order.
POLITE_EN = (
    (r"please\s+", ""), (r"I\s+(would\s+)?like\s+(you\s+)?to", ""), (r"(could|would)\s+you\s+(please\s+)?", ""),
    (r"thank\s+you\s+(in\s+advance\s+)?(for\s+(your\s+)?(help|assistance|time))?", ""), (r"I\s+need\s+you\s+to", ""), (r"I\s+want\s+you\s+to", ""),
    (r"pay\s+(close|special|particular)?\s*attention\s+to", "focus on"), (r"you\s+(should|must|need\s+to|are\s+(required|expected)\s+to)\s+", ""),
    (r"your\s+(task|job|goal)\s+is\s+to", ""), (r"the\s+(task|goal|objective)\s+is\s+to", ""), (r"I'm\s+looking\s+for\s+", ""), (r"I\s+am\s+looking\s+for\s+", ""),
    (r"(please\s+)?provide\s+me\s+with", "provide"), (r"give\s+me", "show"), (r"tell\s+me", ""),
)
# Fillers, words that negate, cues of negation, transitions.
FILLERS = "basically|literally|actually|really|quite|just|vraiment|très|trop|bref|wesh|tkt"

# What gives a sentence its modality in English, the first that matches wins.
MODALITY_EN = (
    ("FORBIDDEN", "forbidden|prohibited|not allowed|disallowed|banned|not permitted|expressly forbidden|strictly prohibited"),
    ("MUST_NOT", "must not|shall not|mustn't|shan't|is prohibited|are prohibited|may not|is forbidden|are forbidden"),
    ("MUST", "must|shall|required|is required to|are required to|needs? to|has? to|have to|obligated|mandatory|compulsory|it is necessary|it is mandatory|it is compulsory|requisite"),
    ("SHOULD_NOT", "should not|shouldn't|not recommended|discouraged|not advisable|it is not recommended|best to avoid|it is discouraged"),
    ("SHOULD", "should|recommended|ought to|suggested|it is advisable|it is recommended|best practice|it is preferable|ideally|it is suggested|we recommend"),
    ("MAY", "may|optional|optionally|permitted|allowed|it is possible to|it is permissible|feel free to|at your discretion|you may|one may|is allowed to"),
)
NEGATED = "not|never|no|without|except|unless|ne|pas|plus|jamais|rien|personne|aucun|aucune|nul|nulle|ni|sans|sauf"
NEGATION_CUES_EN = "not|never|no|none|nothing|nobody|nowhere|neither|nor|cannot|without|except|unless|beyond|hardly|barely|scarcely|rarely|seldom|noways|nowise"
NEGATION_CONTRACTED_EN = "can't|cannot|cant|don't|doesn't|didn't|won't|wouldn't|shouldn't|mustn't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|couldn't|needn't|mightn't|ain't"
TRANSITIONS = "en outre|par ailleurs|de plus|cependant|toutefois|especially|notably|importantly|furthermore|moreover|additionally|in addition|on the other hand|in contrast|similarly"

EDGE = r"\b"


def spaced(phrases: str) -> str:
    return phrases.replace(" ", r"\s+")


def pattern(phrases: str) -> str:
    """A Java pattern of alternatives, whole words (letters of any script), any case."""
    return rf"(?iU){EDGE}({spaced(phrases)}){EDGE}"


def any_of(patterns: list[str]) -> str:
    """A Java pattern that is found wherever one of the patterns, made like those of ``pattern``, is: alternatives by their first letter, so that few are tried."""
    by_letter: dict[str, list[str]] = {}
    for p in patterns:
        body = p.removeprefix(f"(?iU){EDGE}")
        if body.startswith("(") and body.endswith(f"){EDGE}") and not re.search(r"[()]", body[1 : -len(EDGE) - 1]):
            parts = [x + EDGE for x in body[1 : -len(EDGE) - 1].split("|")]
        else:
            parts = [body]
        for x in parts:
            first = x[0].lower() if x[0].isalpha() and x[1] not in "?*+{" else ""
            by_letter.setdefault(first, []).append(x[1:] if first else x)
    return rf"(?iU){EDGE}(?:" + "|".join(f"{first}(?:{'|'.join(x)})" for first, x in by_letter.items()) + ")"


def sql_pattern(phrases: str) -> str:
    """The same for engines whose words are of ASCII letters alone; see ``sql_marked``."""
    marked = re.sub(r"([^\x00-\x7F])", r"_\1_", spaced(phrases))
    return (r"(?i)\b(" + marked + r")\b").replace("'", "''")


def sql_mark(text: str) -> str:
    """text where every character beyond ASCII stands between underscores, and so counts as part of a word."""
    return rf"regexp_replace({text}, '([^\x00-\x7F])', '_\1_', 'g')"


def sql_marked(text: str, rewrite) -> str:
    """rewrite(text) where every character beyond ASCII stands between underscores meanwhile, and so counts as part of a word."""
    return rf"regexp_replace({rewrite(sql_mark(text))}, '_([^\x00-\x7F])_', '\1', 'g')"
