"""Phrases that relate sentences and clauses, as patterns of words; where they stand for themselves they are plain phrases (see ``rules``)."""

from __future__ import annotations

# Relations between sentences, in order; of each the first pattern that a sentence matches gives its marker.
SENTENCE_RELATIONS = {
    "cause": (r"(because|since)\s+.+", r"(as)\s+.+", r"due\s+to\b", r"owing\s+to\b", r"as\s+a\s+result\s+of\b"),
    "consequence": (
        r"(therefore|thus|hence|consequently)\b", r"as\s+a\s+result\b", r"as\s+a\s+consequence\b", r"accordingly\b", r"for\s+this\s+reason\b", r"that\s+is\s+why\b", r"leading\s+to\b", r"which\s+(is\s+)?why\b",
    ),
    "contrast": (
        r"(however|nevertheless|nonetheless)\b", r"but\b", r"(although|though|even\s+though)\b", r"despite\b", r"in\s+spite\s+of\b", r"whereas\b", r"while\b", r"on\s+the\s+other\s+hand\b", r"conversely\b",
        r"in\s+contrast\b", r"(yet|still)\b",
    ),
    "condition": (r"if\b", r"(provided|providing)\s+that\b", r"as\s+long\s+as\b", r"on\s+condition\s+that\b", r"unless\b", r"in\s+case\b", r"in\s+the\s+event\s+that\b"),
    "concession": (r"(although|though|even\s+though)\b", r"despite\s+the\s+fact\s+that\b", r"in\s+spite\s+of\b", r"while\s+it\s+is\s+true\b", r"admittedly\b"),
    "purpose": (r"in\s+order\s+to\b", r"so\s+that\b", r"so\s+as\s+to\b", r"for\s+the\s+purpose\s+of\b", r"with\s+the\s+aim\s+of\b", r"designed\s+to\b", r"intended\s+to\b"),
    "addition": (
        r"(moreover|furthermore)\b", r"in\s+addition\b", r"additionally\b", r"besides\b", r"what\s+is\s+more\b", r"not\s+only\b", r"as\s+well\s+as\b", r"further\b", r"likewise\b", r"similarly\b", r"also\b",
    ),
    "exemplification": (
        r"for\s+example\b", r"for\s+instance\b", r"such\s+as\b", r"e\.g\.\b", r"i\.e\.\b", r"namely\b", r"that\s+is\b", r"in\s+particular\b", r"particularly\b", r"specifically\b", r"notably\b",
    ),
    "summary": (
        r"in\s+summary\b", r"to\s+summarize\b", r"in\s+conclusion\b", r"overall\b", r"to\s+conclude\b", r"in\s+short\b", r"briefly\b", r"in\s+brief\b", r"summing\s+up\b", r"ultimately\b",
    ),
    "temporal": (
        r"(before|after)\b", r"(while|during)\b", r"when\b", r"as\s+soon\s+as\b", r"once\b", r"until\b", r"since\b", r"prior\s+to\b", r"subsequently\b", r"afterwards\b", r"meanwhile\b", r"at\s+the\s+same\s+time\b",
        r"(firstly|secondly|finally)\b", r"then\b", r"next\b",
    ),
    "elaboration": (r"in\s+other\s+words\b", r"to\s+put\s+it\s+another\s+way\b", r"more\s+specifically\b", r"to\s+be\s+more\s+precise\b", r"in\s+particular\b"),
    "disjunction": (r"(or|either|alternatively)\b",),
    "conjunction": (r"(and|both|as\s+well\s+as)\b", r"not\s+only\s+.*\s+but\s+also\b"),
}
# Relations whose target is the next sentence, and those whose target is the one before.
FORWARD, BACKWARD = ("cause", "condition", "purpose", "temporal"), ("consequence", "summary")

# Markers within a sentence by relation, in English and French.
MARKERS = {
    "en": {
        "cause": "because|since|as|due to|owing to|as a result of|resulting from|caused by|stemming from",
        "consequence": "therefore|thus|hence|consequently|as a result|as a consequence|accordingly|for this reason|that is why|which is why|leading to|resulting in",
        "contrast": "however|but|nevertheless|nonetheless|although|though|even though|despite|in spite of|whereas|while|on the other hand|conversely|in contrast|alternatively|yet|still|all the same|having said that",
        "condition": "if|unless|provided that|providing that|as long as|on condition that|in case|in the event that|should|were to|assuming that|given that|whether|depending on",
        "purpose": "in order to|so that|so as to|for the purpose of|with the aim of|aimed at|designed to|intended to|in an effort to|as a means to",
        "addition": "moreover|furthermore|in addition|additionally|besides|also|what is more|not only|as well as|along with|further|likewise|similarly",
        "exemplification": r"for example|for instance|such as|e\.g\.|i\.e\.|namely|that is|including|like|in particular|particularly|specifically|notably",
        "summary": "in summary|to summarize|in conclusion|overall|to conclude|in short|briefly|in brief|summing up|all in all|ultimately",
        "temporal": "before|after|while|during|when|as soon as|once|until|since|prior to|subsequently|afterwards|meanwhile|at the same time|firstly|secondly|finally|then|next|previously|earlier|later|eventually",
    },
    "fr": {
        "cause": "parce que|car|puisque|étant donné que|en raison de|grâce à|à cause de|du fait de|dû à|résultant de",
        "consequence": "donc|ainsi|par conséquent|en conséquence|c'est pourquoi|par suite|de ce fait|ce qui explique|ce qui conduit à|d'où",
        "contrast": "cependant|mais|néanmoins|toutefois|bien que|quoique|malgré|en dépit de|alors que|tandis que|en revanche|au contraire|par contre|à l'inverse|pourtant|or|d'un autre côté",
        "condition": "si|à condition que|pourvu que|à moins que|en cas de|dans l'hypothèse où|supposé que|à supposer que|en admettant que|suivant que|selon que",
        "purpose": "afin de|pour que|de sorte que|dans le but de|en vue de|ayant pour but de|destiné à|conçu pour|dans l'intention de",
        "addition": "de plus|en outre|par ailleurs|de surcroît|en supplément|également|aussi|non seulement|ainsi que|de même|en plus",
        "exemplification": "par exemple|comme|tels que|notamment|en particulier|à savoir|c'est-à-dire|y compris|particulièrement|spécifiquement|entre autres",
        "summary": "en résumé|pour résumer|en conclusion|globalement|pour conclure|en bref|brièvement|somme toute|en définitive|finalement|au final|en un mot",
        "temporal": "avant|après|pendant|durant|lorsque|quand|dès que|une fois que|jusqu'à ce que|depuis que|préalablement|ultérieurement|entre-temps|en même temps que|premièrement|deuxièmement|enfin|ensuite|précédemment|plus tard|finalement|d'abord",
    },
}

# What ends the scope of a negation besides . ! ? ; and comma.
SCOPE_ENDS = {"en": "and|or|but|however|therefore|because|although|while", "fr": "et|ou|mais|car|donc|parce que|bien que|tandis que"}
# French cues of negation, in the order of the alternatives.
NEGATION_CUES_FR = r"ne|n'|pas|plus|jamais|rien|personne|aucun|aucune|nul|nulle|ni|sans|sauf|guère|nullement|aucunement|point|nulle part|quiconque"
# What completes ne, with one word between at most.
CONCORD_FR = r"ne\s+(\w+\s+)?(pas|plus|jamais|rien|personne|aucun|aucune|guère|point)"
# Double negations.
DOUBLE_NEGATION = {
    "en": "not (un|in|im|il|ir|dis)|never (un|in|im|il|ir|dis)|not without|not unless|not impossible|not unlikely|not uncommon|not unrelated",
    "fr": r"ne \w+ pas (in|im|il|ir|dés|dé|mé)|pas sans|pas nullement|pas impossible|pas inutile|pas rare",
}
