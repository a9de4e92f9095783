"""Text functions: columns in, columns out, all inside the JVM but for nfkc()."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as C


def let(value: Column, body) -> Column:
    """body of the value, which is computed once, however often body names it; a plain expression inside a lambda would be
    computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Characters beyond these may change under NFKC.
UNSTABLE = "[^\\x00-\\x7F\\u00C0-\\u00FF]"
BLANKS = "[\\s\\p{Z}]+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC; only texts with characters that may change are sent to Python."""
    return F.coalesce(_nfkc(F.when(F.rlike(text, F.lit(UNSTABLE)), text)), text)


def normalised(text: Column) -> Column:
    """Tags become spaces, letters and marks lower case, all else one space.  Text is taken to be NFKC already."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")), "[^\\p{L}\\p{M}]+", " "))


def modern_spelling(token: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, C.ARCHAIC_SPELLINGS.values())), F.array_position(F.array(*map(F.lit, C.ARCHAIC_SPELLINGS)), token).cast("int") - 1), token)


def capped_runs(tokens: Column, most: int = C.MAX_RUN) -> Column:
    """Drops every token that the `most` tokens before it all equal."""

    def cap(own: Column) -> Column:
        def kept(t: Column, i: Column) -> Column:
            same = F.get(own, i - 1) == t
            for k in range(2, most + 1):
                same = same & (F.get(own, i - k) == t)
            return ~F.coalesce(same, F.lit(False))

        return F.filter(own, kept)

    return let(tokens, cap)


def content_tokens(text: Column) -> Column:
    """The token stream that n-grams are built on."""
    old = F.array(*map(F.lit, C.ARCHAIC_SPELLINGS))
    words = let(F.split(normalised(text), " "), lambda w: F.when(F.arrays_overlap(w, old), F.transform(w, modern_spelling)).otherwise(w))
    return capped_runs(F.filter(words, lambda t: (F.char_length(t) >= C.MIN_WORD_CHARS) & ~t.isin(*C.dropped())))


def squeezed(text: Column) -> Column:
    """Any run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def blank(text: Column) -> Column:
    return ~F.rlike(F.coalesce(text, F.lit("")), F.lit("[^\\s\\p{Z}]"))


def without_header(text: Column) -> Column:
    return F.regexp_replace(text, "(?iu)" + C.PLENARY_HEADER, " ")


def subtitle_noise(sentence: Column) -> Column:
    return F.rlike(sentence, F.lit("(?iu)" + C.SUBTITLE_NOISE))


def without_markdown(text: Column) -> Column:
    """Links to their labels, list marks at line starts away, mark-up characters to spaces; in this order."""
    text = F.regexp_replace(text, r"\[(.*?)\]\(.*?\)", "$1")
    text = F.regexp_replace(text, r"(?m)^\s*[-•\d]+[.\)]?\s+", "")
    return F.regexp_replace(text, r"[#*_`>]+", " ")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """The word tokens that are letters throughout."""
    return F.filter(word_tokens(text), lambda t: F.rlike(t, F.lit("^\\p{L}+$")))


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal."""
    gone = F.char_length(text) - F.char_length(F.replace(text, phrase, F.lit("")))
    return F.when(F.char_length(phrase) > 0, (gone / F.char_length(phrase)).cast("long")).otherwise(F.lit(0).cast("long"))


def ngrams(tokens: Column, n: int) -> Column:
    """Joined by spaces, in order."""

    def grams(own: Column) -> Column:
        def gram(t: Column, i: Column) -> Column:
            parts = [t]
            for k in range(1, n):
                parts += [F.lit(" "), F.get(own, i + k)]
            return F.concat(*parts)

        return F.filter(F.transform(own, gram), lambda g: g.isNotNull())

    return let(tokens, grams)


def longest_run(values: Column) -> Column:
    """Most equal values in a row; 0 of none."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(values, start, step, lambda acc: acc["best"])


def most_repeated(values: Column) -> Column:
    """How often the most frequent value occurs; 0 of none.  Sorted, equal values are a run: no shuffle is needed."""
    return longest_run(F.array_sort(values))


def mattr_sum(tokens: Column, window: int = C.MATTR_WINDOW) -> Column:
    """The sum of types over all windows: token j is the first of its kind in so many windows.

    Sorted by (token, place), a token's last occurrence before it is its neighbour."""

    def summed(placed: Column) -> Column:
        n = F.size(placed)

        def share(x: Column, k: Column) -> Column:
            before = F.get(placed, k - 1)
            last = F.coalesce(F.when(before["t"] == x["t"], before["i"]), F.lit(-1))
            return F.greatest(F.lit(0), F.least(x["i"], n - window) - F.greatest(F.lit(0), x["i"] - (window - 1), last + 1) + 1)

        return F.aggregate(F.transform(placed, share), F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), summed)


def mattr(tokens: Column, window: int = C.MATTR_WINDOW) -> Column:
    """Mean type-token ratio over all windows; of fewer tokens their own ratio; 0 of none."""

    def mean(own: Column) -> Column:
        n = F.size(own)
        return F.when(n == 0, F.lit(0.0)).when(n < window, F.size(F.array_distinct(own)) / n).otherwise(mattr_sum(own, window) / (F.lit(window).cast("long") * (n - window + 1)))

    return let(tokens, mean)


def last_number(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1)).cast("double")


def answer_tail(text: Column) -> Column:
    return F.substring_index(text, "####", -1)


def first_choice(text: Column) -> Column:
    """The first of A to D in the upper-cased text, or null."""
    return F.nullif(F.regexp_extract(F.upper(text), "[ABCD]", 0), F.lit(""))


def choice_block(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.get(F.array(*map(F.lit, "ABCD")), i), F.lit(") "), c)), "\n")


# What prompts and served prompts say before the facts.
FACTS = "Das Wichtigste in Kürze: "
SERVED_FACTS = "Fakten (faktentreu bleiben, nichts erfinden): "


def fact_block(facts: Column, prefix: str = FACTS) -> Column:
    return F.when(F.size(F.coalesce(facts, F.array())) > 0, F.concat(F.lit(prefix), F.array_join(facts, "; "), F.lit("."))).otherwise("")


def shown(text: Column, n: int = 600) -> Column:
    """The text without white space around it, cut for display; what is empty is said to be."""
    own = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")
    return F.when(own == "", "(leer)").otherwise(F.left(own, F.lit(n)))


def with_register(prompt: Column, register: Column) -> Column:
    """A system prompt, and a register's instruction after a space if it says anything."""
    own = F.regexp_replace(F.coalesce(register, F.lit("")), "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")
    return F.when(own == "", prompt).otherwise(F.concat(prompt, F.lit(" "), own))


def escaped_html(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text
