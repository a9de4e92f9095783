"""Word lists, weights and thresholds of the style analytics."""

from __future__ import annotations

from functools import cache

# Results depend on them.
JUNK_TOKENS = ("http", "https", "www", "com", "org", "html", "php", "amp", "nbsp")
DATE_TOKENS = ("cet", "cest", "utc", "gmt", "jan", "feb", "mär", "mrz", "apr", "jun", "jul", "aug", "sep", "sept", "okt", "nov", "dez")
MARKUP_TOKENS = ("span", "div", "style", "color", "href", "noinclude", "includeonly", "colspan", "rowspan", "font", "src", "alt", "thumb", "px", "img")
CALQUE_TOKENS = ("sir", "aye", "mister", "maam", "madam", "milady", "señor", "senor")
STAGE_TOKENS = ("beifall", "zuruf", "zurufe", "heiterkeit", "widerspruch", "zwischenruf", "zwischenrufe", "lachen", "unruhe")
ARCHAIC_SPELLINGS = {
    "daß": "dass", "muß": "muss", "müßte": "müsste", "müßten": "müssten", "läßt": "lässt", "gewiß": "gewiss", "faßt": "fasst", "schloß": "schloss", "paß": "pass",
    "biß": "biss", "haßt": "hasst", "wußte": "wusste", "seyn": "sein", "thun": "tun", "thut": "tut", "giebt": "gibt", "sey": "sei",
}
SUBTITLE_NOISE = (
    r"untertitel|subtitle|\bsubs\b|sdi media|media group|board\.?user|netflix|amazon|synchron|übersetzung von|korrektur|transcript|www\.|https?:|\.com|\.de\b|\.org|opensubtitles|@"
)
PLENARY_HEADER = r"(deutscher\s+)?bundestag\b.{0,60}?wahlperiode.{0,80}?sitzung.{0,40}?(bonn|berlin)?[\s,\.\d]*"
NOMINAL_SUFFIXES = ("ung", "heit", "keit", "ion", "ierung", "ität", "ismus", "nis", "tum", "schaft", "barkeit", "losigkeit")
PASSIVE_PREFIXES = ("werd", "wird", "wurd", "worden")
ECHO_WORDS = ("faq", "taglines", "tagline", "slogans", "slogan")
TICS = ("inklusive", "smart", "blitz", "easy peasy", "basta", "kein ding")

MIN_WORD_CHARS = 3
MAX_RUN = 3
PERPLEXITY_BAND = (50.0, 1500.0)
REGISTER_WEIGHTS = {"cultural": 32, "web": 23, "political": 18, "expository": 16}
TOKEN_BUDGET = 55_000_000
SUBTITLE_PERCENT = 18
SUBTITLE_SCALE_CAP = 4.0
SENTENCE_WEIGHT_CAP = 1000
PROFILE_TOP_K = 500_000
REFERENCE_DOCS = 250
DEGENERATE_TOKENS = 100
DEGENERATE_PERCENT = 8
CANDIDATE_MIN_COUNT = 20
CANDIDATE_MAX_BASELINE = 300
SLOP_SPREAD = 5
STRIKE_SPREAD = 2
LOOP_RUN = 5
LOOP_BIGRAM = 6
LONG_SENTENCE = 50.0
NOMINAL_RATIO = 8.0
MATTR_WINDOW = 50
MIN_SENTENCE_TOKENS = 3
HIGHLIGHT_MIN_CHARS = 4

#: The common German stop words of the public stemming and stop-word lists: words, and stems that take every ending of the strong declension.
STOP_WORDS = (
    "aber als also am an ander anderm andern anderr anders auch auf aus bei bin bis bist da damit dann das dass dasselbe dazu daß dein dem demselben den "
    "denn denselben der derer derselbe derselben des desselben dessen dich die dies dieselbe dieselben dir doch dort du durch ein einig einmal er es etwas "
    "euch euer für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich ihm ihn ihnen ihr im in indem ins ist jetzt kann kein können könnte "
    "machen man mein mich mir mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein selbst sich sie sind so soll sollte sondern sonst um "
    "und uns unter viel vom von vor war waren warst was weg weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte während würde "
    "würden zu zum zur zwar zwischen über"
)
STOP_STEMS = ("all", "ander", "dein", "dies", "ein", "einig", "eur", "ihr", "jed", "jen", "kein", "manch", "mein", "sein", "solch", "uns", "welch")
STOP_ENDINGS = ("e", "em", "en", "er", "es")

#: Metrics of human reference registers.
STRUCTURAL_REFERENCE = (
    # register, n_sentences, n_tokens, nominalization_per_100, noun_verb_ratio, mean_sentence_len, clauses_per_sentence, mean_parse_depth, passive_ratio
    ("dialog/literary (cultural/dibilit)", 12500, 145291, 1.05, 1.59, 11.6, 1.3, 2.72, 0.03),
    ("forum (web/wikidiscussions)", 969, 12305, 2.13, 2.13, 12.7, 1.19, 2.61, 0.089),
    ("forum-AT (web/onemillionposts)", 5476, 82011, 2.59, 2.2, 15.0, 1.41, 2.79, 0.123),
    ("encyclopedic (web/wikipedia)", 5113, 83309, 2.42, 3.27, 16.3, 1.3, 2.95, 0.205),
    ("academic (scientific/openalex)", 7113, 135410, 3.39, 2.6, 19.0, 1.44, 3.19, 0.136),
    ("speech (political/germanpoliticalspeeches)", 7955, 141362, 3.35, 1.63, 17.8, 1.66, 3.25, 0.076),
)
STRUCTURAL_COLUMNS = ("register", "n_sentences", "n_tokens", "nominalization_per_100", "noun_verb_ratio", "mean_sentence_len", "clauses_per_sentence", "mean_parse_depth", "passive_ratio")
#: The register that scores are held against.
LIVELY = "dialog/literary (cultural/dibilit)"
#: Decimals of the published metrics.
DECIMALS = {"nominalization_per_100": 2, "noun_verb_ratio": 2, "mean_sentence_len": 1, "clauses_per_sentence": 2, "mean_parse_depth": 2, "passive_ratio": 3, "mattr": 4}
SCORED_METRICS = ("nominalization_per_100", "noun_verb_ratio", "mean_sentence_len", "mean_parse_depth", "passive_ratio")

#: (kind, phrase) of the acceptance report.
CANDIDATES = tuple(
    (kind, phrase)
    for kind, phrases in {
        "slop_phrases": (
            "es ist wichtig zu beachten", "spielt eine entscheidende rolle", "von entscheidender bedeutung", "ein wesentlicher aspekt", "ganzheitlicher ansatz", "nahtlose integration",
            "wertvolle einblicke", "rasante entwicklung", "vielfältige möglichkeiten", "facettenreiche welt", "fesselnde geschichte", "pulsierende metropole", "wahres meisterwerk",
            "tiefgreifende auswirkungen", "umfassenden überblick", "wesentlicher bestandteil", "zusammenfassend lässt sich sagen", "im laufe der zeit",
        ),
        "slop_phrases_functionword": ("in der heutigen zeit", "es ist wichtig zu betonen", "tauchen wir ein", "in diesem sinne", "lassen sie uns", "es sei darauf hingewiesen"),
        "slop_words": ("zudem", "somit", "ferner", "letztendlich", "diesbezüglich", "nahtlos", "facettenreich", "essenziell", "maßgeblich", "ganzheitlich"),
        "control_phrases": ("tut mir leid", "mach schon", "mal sehen", "guten tag", "gute idee"),
        "expository_controls": (
            "empirische untersuchung", "systematische analyse", "historischer kontext", "theoretische grundlage", "ökonomische perspektive", "folglich ergibt", "demnach gilt",
            "hierbei handelt", "insbesondere bei", "darüber hinaus", "zunehmend wichtig", "grundsätzlich gilt",
        ),
    }.items()
    for phrase in phrases
)
# End of the fixed values.


@cache
def stopwords() -> tuple[str, ...]:
    """Stop words, `dass` among them, into which the old spelling is turned before the list is asked."""
    return tuple(sorted({*STOP_WORDS.split(), *(stem + ending for stem in STOP_STEMS for ending in STOP_ENDINGS)}))


@cache
def dropped() -> tuple[str, ...]:
    return tuple(sorted({*stopwords(), *JUNK_TOKENS, *DATE_TOKENS, *MARKUP_TOKENS, *CALQUE_TOKENS, *STAGE_TOKENS}))
