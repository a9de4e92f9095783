"""Sentence structure: counters over annotated sentences, ratios, composite score.

Annotation: ARRAY<STRUCT<sent_id, tokens ARRAY<STRUCT<text, pos, verbform, depth, is_space, is_punct>>>>.  A real tagger is
plugged in with annotated(); depths() turns its heads into depths.  rule_annotation() is a rough stand-in of rules.

Metrics are published with the decimals of DECIMALS; halves of the true quotient go to the even digit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

#: Hops after which a parse is not followed further.
DEEPEST = 101
TOKEN = "struct<text:string,pos:string,verbform:string,depth:int,is_space:boolean,is_punct:boolean>"
SENTENCES = f"array<struct<sent_id:int,tokens:array<{TOKEN}>>>"
COUNTERS = ("n_sentences", "n_tokens", "n_noun", "n_verb", "n_nominal", "n_finite", "depth_sum", "depth_n", "n_passive")

# Forms of the German auxiliaries, those of them that are infinitives, and participles without the usual form.
AUXILIARIES = (
    "bin", "bist", "ist", "sind", "seid", "war", "warst", "waren", "wart", "gewesen", "habe", "hast", "hat", "haben", "habt", "hatte", "hatten", "werde", "wirst", "wird", "werden",
    "werdet", "wurde", "wurden", "worden", "kann", "können", "konnte", "muss", "müssen", "musste", "soll", "sollen", "sollte", "will", "wollen", "wollte", "darf", "dürfen", "mag", "möchte",
)
INFINITIVES = ("haben", "werden", "können", "müssen", "sollen", "wollen", "dürfen")
PARTICIPLES = ("worden", "gewesen")


def annotated(df: DataFrame, tagger: Callable[[Iterable[str]], Iterable[list[dict]]], text: str = "text") -> DataFrame:
    """df with `sents` from a tagger that maps texts to annotations; it runs once a worker on Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", sents {SENTENCES}"

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sents=list(tagger(frame[text].fillna(""))))

    return df.mapInPandas(run, schema)


def depths(heads: Column) -> Column:
    """How many hops each token of a sentence is from its root, at most DEEPEST.  heads: each token's head, as a place from 0;
    a root is its own.  Each round doubles the hops that are known, so seven do."""

    def further(rows: Column) -> Column:
        return F.transform(rows, lambda x: T.let(F.get(rows, x["at"]), lambda y: F.struct(y["at"].alias("at"), (x["hops"] + y["hops"]).alias("hops"))))

    known = F.transform(heads, lambda h, i: F.struct(h.cast("int").alias("at"), F.when(h == i, 0).otherwise(1).alias("hops")))
    for _ in range(DEEPEST.bit_length()):
        known = T.let(known, further)
    return F.transform(known, lambda x: F.least(x["hops"], F.lit(DEEPEST)))


def rule_annotation(text: Column) -> Column:
    """A rough annotation: capitalised words inside a sentence are nouns, endings make verbs and participles, auxiliaries
    are listed.  The first verb or auxiliary is the root, or else the first token; nouns, verbs and auxiliaries hang on it, any
    other token on the next one, the last on the root.  rules.counters() counts by the same rules without these rows."""
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.rlike(s, F.lit("\\p{L}")))

    def token(word: Column, i: Column) -> Column:
        low = F.lower(word)
        part = F.rlike(low, F.lit("^ge\\p{L}{2,}(t|en)$")) | low.isin(*PARTICIPLES)
        punct = ~F.rlike(word, F.lit("[\\p{L}\\p{N}]"))
        named = F.when(punct, "PUNCT").when(low.isin(*AUXILIARIES), "AUX").when((i > 0) & F.rlike(word, F.lit("^\\p{Lu}\\p{Ll}+")), "NOUN").when(F.rlike(low, F.lit("^\\p{L}{2,}(te|ten|st|en|t)$")), "VERB").otherwise("X")
        return T.let(named, lambda pos: formed(word, low, part, punct, pos))

    def formed(word: Column, low: Column, part: Column, punct: Column, pos: Column) -> Column:
        infinitive = low.isin(*INFINITIVES)
        form = F.when(~pos.isin("AUX", "VERB", "NOUN"), None).when(part, "Part").when((pos == "AUX") & ~infinitive, "Fin").when((pos == "VERB") & F.rlike(low, F.lit("(te|st|t)$")), "Fin")
        return F.struct(word.alias("text"), pos.alias("pos"), form.alias("verbform"), F.lit(None).cast("int").alias("depth"), F.lit(False).alias("is_space"), punct.alias("is_punct"))

    def parsed(tokens: Column) -> Column:
        first = F.array_position(F.transform(tokens, lambda t: t["pos"].isin("VERB", "AUX")), True).cast("int")
        return T.let(F.greatest(first - 1, F.lit(0)), lambda root: T.let(depths(F.transform(tokens, lambda t, i: head(t, i, F.size(tokens), root))), lambda d: F.transform(tokens, lambda t, i: t.withField("depth", F.get(d, i)))))

    def head(t: Column, i: Column, n: Column, root: Column) -> Column:
        return F.when((i == root) | t["pos"].isin("NOUN", "VERB", "AUX") | (i + 1 >= n), root).otherwise(i + 1)

    tagged = F.transform(sentences, lambda s, k: F.struct(k.alias("sent_id"), T.let(F.transform(F.regexp_extract_all(s, F.lit("[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"), F.lit(0)), token), parsed).alias("tokens")))
    return tagged


def nominal(word: Column) -> Column:
    return F.rlike(word, F.lit("(?iu)(" + "|".join(C.NOMINAL_SUFFIXES) + ")$"))


def counters(sents: Column) -> Column:
    """One struct of whole numbers for a text; all ratios derive from it, or from sums of it."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    def werden(t: Column) -> Column:
        low = F.lower(t["text"])
        starts = F.startswith(low, F.lit(C.PASSIVE_PREFIXES[0]))
        for p in C.PASSIVE_PREFIXES[1:]:
            starts = starts | F.startswith(low, F.lit(p))
        return (t["pos"] == "AUX") & starts

    def verb(t: Column) -> Column:
        return t["pos"].isin("VERB", "AUX")

    def counted(kept: Column) -> Column:
        def number(test: Callable[[Column], Column]) -> Column:
            return total(F.transform(kept, lambda ts: F.size(F.filter(ts, lambda t: F.coalesce(test(t), F.lit(False))))))

        passive = F.filter(kept, lambda ts: F.exists(ts, lambda t: F.coalesce(werden(t), F.lit(False))) & F.exists(ts, lambda t: F.coalesce(t["verbform"] == "Part", F.lit(False))))
        return F.struct(
            F.size(kept).cast("long").alias("n_sentences"),
            total(F.transform(kept, F.size)).alias("n_tokens"),
            number(lambda t: t["pos"].isin("NOUN", "PROPN")).alias("n_noun"),
            number(verb).alias("n_verb"),
            number(lambda t: (t["pos"] == "NOUN") & nominal(t["text"])).alias("n_nominal"),
            number(lambda t: verb(t) & (t["verbform"] == "Fin")).alias("n_finite"),
            total(F.transform(kept, lambda ts: total(F.transform(ts, lambda t: F.coalesce(F.least(t["depth"], F.lit(DEEPEST)), F.lit(0)))))).alias("depth_sum"),
            number(lambda t: t["depth"].isNotNull()).alias("depth_n"),
            F.size(passive).cast("long").alias("n_passive"),
        )

    real = F.transform(sents, lambda s: F.filter(s["tokens"], lambda t: ~t["is_space"] & ~t["is_punct"]))
    return T.let(F.filter(real, lambda ts: F.size(ts) >= C.MIN_SENTENCE_TOKENS), counted)


def pooled(df: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the counters; ratios are taken again from these, never averaged."""
    return df.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTERS))


def rounded(top: Column, bottom: Column, digits: int) -> Column:
    """A quotient of whole numbers with so many decimals, in whole numbers up to the last step: halves go to the even digit."""
    scaled, twice = top.cast("long") * 10**digits, F.nullif(bottom.cast("long"), F.lit(0))
    whole, rest = F.try_divide(scaled - F.pmod(scaled, twice), twice).cast("long"), 2 * F.pmod(scaled, twice)
    return (whole + F.when((rest > twice) | (rest == twice) & (F.pmod(whole, F.lit(2)) == 1), 1).otherwise(0)).cast("double") / float(10**digits)


def ratios(df: DataFrame) -> DataFrame:
    """The metrics as published, beside df's columns; null where no sentence counts."""
    some = F.col("n_sentences") > 0

    def ratio(name: str, top: Column, bottom: Column) -> Column:
        return F.when(some, rounded(top, bottom, C.DECIMALS[name])).alias(name)

    return df.select(
        "*",
        ratio("nominalization_per_100", 100 * F.col("n_nominal"), F.col("n_tokens")),
        ratio("noun_verb_ratio", F.col("n_noun"), F.greatest("n_verb", F.lit(1))),
        ratio("mean_sentence_len", F.col("n_tokens"), F.col("n_sentences")),
        ratio("clauses_per_sentence", F.col("n_finite"), F.col("n_sentences")),
        ratio("mean_parse_depth", F.col("depth_sum"), F.col("depth_n")),
        ratio("passive_ratio", F.col("n_passive"), F.col("n_sentences")),
    )


def reference(spark) -> DataFrame:
    kinds = "register string, n_sentences long, n_tokens long, " + ", ".join(f"{c} double" for c in C.STRUCTURAL_COLUMNS[3:])
    return spark.createDataFrame(C.STRUCTURAL_REFERENCE, kinds)


def slop_score(metrics: dict[str, Column], ref: dict[str, Column]) -> Column:
    """Mean relative excess over the reference in percent, one decimal; metrics that are null, or whose reference is null or
    0, are left out; NaN if none is left."""
    pairs = F.array(*(F.struct(metrics[k].cast("double").alias("m"), ref[k].cast("double").alias("r")) for k in C.SCORED_METRICS))
    kept = F.filter(pairs, lambda p: p["m"].isNotNull() & p["r"].isNotNull() & (p["r"] != 0))
    sums = F.aggregate(kept, F.lit(0.0), lambda a, p: a + (p["m"] - p["r"]) / p["r"])
    return F.when(F.size(kept) > 0, F.bround(100 * sums / F.size(kept), 1)).otherwise(float("nan"))


def scored(df: DataFrame, ref: DataFrame, register: str = C.LIVELY) -> DataFrame:
    """df with slop_score against one register's row."""
    row = ref.where(F.col("register") == register).select(*(F.col(k).alias(f"ref_{k}") for k in C.SCORED_METRICS))
    score = slop_score({k: F.col(k) for k in C.SCORED_METRICS}, {k: F.col(f"ref_{k}") for k in C.SCORED_METRICS})
    return df.crossJoin(F.broadcast(row)).withColumn("slop_score", score).drop(*(f"ref_{k}" for k in C.SCORED_METRICS))
