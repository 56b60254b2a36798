"""Word lists, patterns and palettes that results depend on."""

# The Snowball English stop words.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves
    he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing would should
    could ought i'm you're he's she's it's we're they're i've you've we've
    they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll
    they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't
    didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's
    that's who's what's here's there's when's where's why's how's a an the and
    but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off
    over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than
    too very
    """.split()
)

# Stop words always removed from term tables.
CUSTOM_STOP_WORDS = ("pt", "(e.g.", "translated", "question")

# Term patterns removed from term tables (case-insensitive search).
REGEX_STOP_WORDS = ("^physiothera", "^can$", "^cannot$", "^can’t$", "^without$", "^w/o$")

# Stop words removed from the term table of one question only.
QUESTION_STOP_WORDS = {
    "Q4.2": ("costs", "effective", "save", "saved", "direct", "therapy", "cost"),
    "Q4.3": ("direct", "costs", "+", "services", "models", "processes"),
    "Q4.4": (
        "quality", "development", "continuous", "degrees", "bsc", "bachelors", "msc",
        "advanced", "care", "continuing", "education", "degree", "professional",
        "professionals",
    ),
    "Q4.5": ("tools", "measuring", "measurements"),
    "Q4.6": ("disability", "treatment", "classify", "classifications", "classification"),
    "Q4.7": ("contextual", "experiences", "context", "factors"),
    "Q4.8": ("response", "prognosis", "outcome", "prognostic"),
    "Q4.9": ("clinical", "decision", "decisions", "deciding"),
    "Q4.10": ("data", "technology", "technologies", "technological"),
}

# The eight colours of the "Dark2" palette.
DARK_PALETTE = (
    "#1B9E77", "#D95F02", "#7570B3", "#E7298A", "#66A61E", "#E6AB02", "#A6761D", "#666666",
)

# Frequent function words per language, used by the offline language detector.
LANGUAGE_WORDS = {
    "de": tuple("der die und in den von zu das sich mit auf des für ist im dem nicht ein eine als".split()),
    "en": tuple("the of and to a in is that for it was on with be as by are this at from".split()),
    "es": tuple("de la que el en y los se del las por un no con su una es para al lo".split()),
    "fr": tuple("de la le et les des en un une du que pour est qui dans par pas au sur avec".split()),
    "it": tuple("di il che la e per un in del non con una sono gli della ma ed anche le lo".split()),
}

# A small word-for-word glossary into English, used by the offline translator.
GLOSSARY = {
    "de": {
        "der": "the", "die": "the", "das": "the", "und": "and", "in": "in", "von": "of",
        "zu": "to", "mit": "with", "auf": "on", "für": "for", "ist": "is", "im": "in the",
        "nicht": "not", "ein": "a", "eine": "a", "als": "as",
    },
    "es": {
        "de": "of", "la": "the", "el": "the", "los": "the", "las": "the", "que": "that",
        "en": "in", "y": "and", "por": "by", "un": "a", "una": "a", "no": "not",
        "con": "with", "su": "their", "es": "is", "para": "for",
    },
    "fr": {
        "de": "of", "la": "the", "le": "the", "les": "the", "des": "of the", "et": "and",
        "en": "in", "un": "a", "une": "a", "du": "of the", "que": "that", "pour": "for",
        "est": "is", "qui": "who", "dans": "in", "par": "by", "pas": "not", "sur": "on",
        "avec": "with",
    },
    "it": {
        "di": "of", "il": "the", "la": "the", "gli": "the", "le": "the", "che": "that",
        "e": "and", "per": "for", "un": "a", "una": "a", "in": "in", "non": "not",
        "con": "with", "sono": "are", "ma": "but", "anche": "also",
    },
}


def language_weights(words: dict[str, tuple[str, ...]] = LANGUAGE_WORDS) -> dict[str, dict[str, int]]:
    """Weight of each word per language: 60 shared equally by the languages that list it.

    Integer weights keep the scores exact whatever the order of summation.
    """
    shared: dict[str, int] = {}
    for listed in words.values():
        for word in listed:
            shared[word] = shared.get(word, 0) + 1
    return {lang: {word: 60 // shared[word] for word in listed} for lang, listed in words.items()}
