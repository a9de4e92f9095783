"""Phrases in surface text: substring matches, highlight counts, verbal tics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

#: Phrases of one block; a text meets a block at a time.
BLOCK_PHRASES = 512
#: Bytes of short phrases that are broadcast at a time.
BROADCAST_BYTES = 32 << 20


def seed_list(lists: list[DataFrame]) -> DataFrame:
    """phrase: every phrase of the lists once, in order."""
    return reduce(DataFrame.unionByName, (x.select("phrase") for x in lists)).distinct().orderBy("phrase")


def inner_word(phrase: Column) -> Column:
    """The longest of the words inside a phrase, the first and last left out; null if there is none.  A text that holds the
    phrase holds this word between spaces."""
    parts = F.split(phrase, " ")
    inside = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.array_max(F.transform(inside, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]


def met(texts: DataFrame, hay: str, phrases: DataFrame) -> DataFrame:
    """texts' columns and `p`, a phrase (its columns, `needle` among them) that the text `hay` holds, for each such pair.

    Phrases of three words or more are joined by a word inside them, so a text meets only those that it may hold.  A
    shorter phrase has no whole word inside; those are met in blocks, a block at a time in one row, and only hits become
    rows.  Their blocks are broadcast in parts of checked size.  Texts are never broadcast, whatever Spark takes their size for."""
    own = phrases.where(F.col("needle").isNotNull() & (F.col("needle") != "")).select(F.struct("*").alias("p"), inner_word(F.col("needle")).alias("__word"))
    bytes_ = F.octet_length(F.to_json("p"))
    n, size, size_keyed = own.agg(F.count_if(F.col("__word").isNull()), *(F.coalesce(F.sum(F.when(F.col("__word").isNull() == x, bytes_)), F.lit(0)) for x in (True, False))).first()
    long_ = own.where("__word IS NOT NULL")
    long_ = F.broadcast(long_) if size_keyed <= BROADCAST_BYTES else long_.hint("merge")
    keyed = texts.withColumn("__word", F.explode(F.array_distinct(F.split(hay, " ")))).join(long_, "__word")
    found = keyed.where(F.contains(hay, F.col("p.needle"))).drop("__word")
    short = own.where("__word IS NULL").select("p")
    n_parts, n_blocks = -(-size // BROADCAST_BYTES), max(1, -(-n // BLOCK_PHRASES))
    for k in range(n_parts):
        part = short.where(F.pmod(F.xxhash64(F.col("p.needle"), F.lit(1)), F.lit(n_parts)) == k)
        blocks = part.groupBy(F.pmod(F.xxhash64("p.needle"), F.lit(n_blocks)).alias("b")).agg(F.collect_list("p").alias("__list")).select("__list")
        hits = texts.crossJoin(F.broadcast(blocks)).withColumn("p", F.explode(F.filter("__list", lambda p: F.contains(F.col(hay), p["needle"])))).drop("__list")
        found = found.unionByName(hits)
    return found


def phrase_hits(texts: DataFrame, phrases: DataFrame, text: str = "text", lower_phrase: bool = True, squeeze: bool = False) -> DataFrame:
    """texts' other columns, phrase, hits, for each phrase that occurs; a phrase listed twice counts twice."""
    keys = [c for c in texts.columns if c != text]
    own = T.squeezed(F.lower(F.col(text))) if squeeze else F.lower(F.col(text))
    listed = phrases.select("phrase", (F.lower("phrase") if lower_phrase else F.col("phrase")).alias("needle"))
    found = met(texts.select(*keys, own.alias("__hay")), "__hay", listed)
    return found.select(*keys, "p.phrase", T.occurrences(F.col("__hay"), F.col("p.needle")).alias("hits"))


def ngram_hits(grams: DataFrame, banned: DataFrame, by: list[str]) -> DataFrame:
    """by, ngram, hits of listed n-grams in a content-token stream."""
    return grams.join(banned.select("ngram").distinct(), "ngram", "left_semi").groupBy(*by, "ngram").agg(F.count("*").alias("hits"))


def containment(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase: str = "text") -> DataFrame:
    """Pairs of text and phrase, case kept."""
    found = met(texts, text, phrases.select(F.col(key).alias("key"), F.col(phrase).alias("needle")))
    return found.select(*texts.columns, F.col("p.key").alias(key))


def alternation(phrases: list[str]) -> str:
    """Longest first, so that the most specific phrase is the one found; ties in order of spelling."""
    return "|".join(re.escape(p) for p in sorted({p for p in phrases if len(p) >= C.HIGHLIGHT_MIN_CHARS}, key=lambda p: (-len(p), p)))


def highlighted(texts: DataFrame, phrases: list[str], text: str = "text") -> DataFrame:
    """texts' other columns, html (the text escaped, phrases between marks) and hits; phrases are looked for in escaped text."""
    pattern = alternation(phrases)
    escaped = T.escaped_html(F.coalesce(F.col(text), F.lit("")))
    hits = F.regexp_count(F.col("__safe"), F.lit("(?iu)" + pattern)) if pattern else F.lit(0)
    html = F.regexp_replace("__safe", f"(?iu)({pattern})", "<mark>$1</mark>") if pattern else F.col("__safe")
    keys = [c for c in texts.columns if c != text]
    return texts.select(*keys, escaped.alias("__safe")).select(*keys, html.alias("html"), hits.cast("long").alias("hits"))


def highlight_hits(texts: DataFrame, phrases: list[str], text: str = "text") -> DataFrame:
    return highlighted(texts, phrases, text).drop("html")


def _tic_sums(texts: DataFrame, arm: str, text: str, tics: tuple[str, ...]) -> DataFrame:
    """arm, tics: array of ord, tic, hits."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    sums = texts.groupBy(arm).agg(*(F.coalesce(F.sum(T.occurrences(low, F.lit(t))), F.lit(0)).cast("long").alias(f"t{k}") for k, t in enumerate(tics)))
    return sums.select(arm, F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(t).alias("tic"), F.col(f"t{k}").alias("hits")) for k, t in enumerate(tics))).alias("tics"))


def tic_counts(texts: DataFrame, arm: str = "arm", text: str = "text", tics: tuple[str, ...] = C.TICS) -> DataFrame:
    """arm, tic, hits: all tics of every arm."""
    return _tic_sums(texts, arm, text, tics).select(arm, F.explode("tics").alias("x")).select(arm, "x.tic", "x.hits")


def top_tics(texts: DataFrame, arm: str = "arm", text: str = "text", tics: tuple[str, ...] = C.TICS, k: int = 5) -> DataFrame:
    """arm, place, tic, hits: the k most frequent tics of every arm, ties in the order of the list."""
    order = F.array_sort(F.transform("tics", lambda x: F.struct((-x["hits"]).alias("less"), x["ord"].alias("ord"), x["tic"].alias("tic"))))
    each = _tic_sums(texts, arm, text, tics).select(arm, F.posexplode(F.slice(order, 1, k)).alias("place", "x"))
    return each.select(arm, (F.col("place") + 1).alias("place"), "x.tic", (-F.col("x.less")).alias("hits"))


def tic_changes(texts: DataFrame, base: str, other: str, arm: str = "arm", text: str = "text", tics: tuple[str, ...] = C.TICS, k: int = 5) -> DataFrame:
    """place, tic, base, other: the other arm's most frequent tics that occur at all, with the base arm's hits, 0 if it has none."""
    shown = top_tics(texts, arm, text, tics, k).where((F.col(arm) == other) & (F.col("hits") > 0)).select("place", "tic", F.col("hits").alias("other"))
    known = tic_counts(texts, arm, text, tics).where(F.col(arm) == base).select("tic", F.col("hits").alias("base"))
    return shown.join(known, "tic", "left").select("place", "tic", F.coalesce("base", F.lit(0)).cast("long").alias("base"), "other")


def per_thousand(hits, tokens):
    return 1000 * hits / F.nullif(tokens, F.lit(0))
