"""Several arms of texts on the same prompts: loops, degenerate outputs, medians, pooled rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from . import phrases as P
from . import rules as R
from . import structure as S


def arms_of(pairs: DataFrame, arms: list[str], key: str = "id") -> DataFrame:
    """Wide arm columns to rows (key, arm, text)."""
    return pairs.unpivot([key], arms, "arm", "text")


def paired(prompts: DataFrame, arms: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """prompts' columns and one for each arm(key, text), joined by key; a prompt that an arm has no text for is an error."""
    out = prompts
    for name, texts in arms.items():
        out = out.join(texts.select(F.col(key).alias("__key"), F.struct(F.col("text")).alias("__text")), out[key] == F.col("__key"), "left")
        missing = F.raise_error(F.concat(F.lit(f"{name} has no text for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        out = out.withColumn(name, F.when(F.col("__text").isNotNull(), F.col("__text.text")).otherwise(missing)).drop("__key", "__text")
    return out


def loops(text: Column) -> tuple[Column, Column]:
    """Most equal tokens in a row, and most repeats of one bigram."""
    tokens = T.word_tokens(F.coalesce(text, F.lit("")))
    return T.longest_run(tokens), T.most_repeated(T.ngrams(tokens, 2))


def degenerate(consec: Column, bigram: Column, sentence_len: Column | None = None, noun_verb: Column | None = None) -> Column:
    bad = (consec >= C.LOOP_RUN) | (bigram >= C.LOOP_BIGRAM)
    if sentence_len is not None:
        bad = bad | F.coalesce(sentence_len > C.LONG_SENTENCE, F.lit(False))
    if noun_verb is not None:
        bad = bad | F.coalesce(noun_verb > C.NOMINAL_RATIO, F.lit(False))
    return bad


def per_text(texts: DataFrame, ref: DataFrame, annotate=None) -> DataFrame:
    """id, arm -> structure, score, MATTR (four decimals) and degeneracy of every text; each text is annotated once."""
    clean = texts.withColumn("clean", T.without_markdown(F.coalesce("text", F.lit(""))))
    with_counters = S.annotated(clean, annotate, "clean").withColumn("m", S.counters(F.col("sents"))) if annotate else clean.withColumn("m", R.counters(F.col("clean")))
    counted = with_counters.select(*texts.columns, "clean", "m.*")
    consec, bigram = loops(F.col("clean"))
    out = S.scored(S.ratios(counted), ref)
    mattr = F.bround(T.mattr(T.letter_tokens(F.col("clean"))), C.DECIMALS["mattr"])
    return out.withColumn("degenerate", degenerate(consec, bigram, F.col("mean_sentence_len"), F.col("noun_verb_ratio"))).withColumn("mattr", mattr).drop("clean")


#: Decimals of the values that medians are taken of.
OF_MEDIANS = {"slop_score": 1, "nominalization_per_100": C.DECIMALS["nominalization_per_100"], "passive_ratio": C.DECIMALS["passive_ratio"], "mattr": C.DECIMALS["mattr"]}


def median(value: Column, digits: int) -> Column:
    """The median of values with so many decimals, with two; taken of whole numbers, so that its halves are exact."""
    units = F.median(F.round(value * 10**digits).cast("long"))
    return F.bround(units / float(10 ** (digits - 2)), 0) / 100 if digits > 2 else F.bround(units * 10 ** (2 - digits), 0) / 100


def report(texts: DataFrame, phrases: DataFrame, ref: DataFrame, annotate=None, tics: tuple[str, ...] = C.TICS) -> DataFrame:
    """One row an arm: medians over texts that have sentences, pooled score, phrase and tic hits, per thousand tokens with
    two decimals, and the five most frequent tics.

    Hits are counted on the raw text of every text, also of those without sentences."""
    each = per_text(texts.select("id", "arm", "text"), ref, annotate)
    good = F.col("n_sentences") > 0
    medians = [median(F.when(good, F.col(c)), d).alias(f"median_{c}") for c, d in OF_MEDIANS.items()]
    sums = each.groupBy("arm").agg(F.count_if(good).cast("long").alias("n_texts"), F.count_if(good & F.col("degenerate")).cast("long").alias("n_degenerate"), *medians, *(F.sum(c).cast("long").alias(c) for c in S.COUNTERS))
    scored = S.scored(S.ratios(sums), ref).withColumnRenamed("slop_score", "pooled_slop_score")
    bans = P.phrase_hits(texts.select("arm", "text"), phrases).groupBy("arm").agg(F.sum("hits").alias("ban_hits"))
    top = P.top_tics(texts, "arm", tics=tics).groupBy("arm").agg(F.array_sort(F.collect_list(F.struct("place", "tic", "hits"))).alias("top_tics"))
    total = P.tic_counts(texts, "arm", tics=tics).groupBy("arm").agg(F.sum("hits").alias("tic_hits"))
    joined = scored.join(bans, "arm", "left").join(total, "arm", "left").join(top, "arm", "left").fillna(0, ["ban_hits", "tic_hits"])
    return joined.select(
        "arm", "n_texts", "n_degenerate", *(f"median_{c}" for c in OF_MEDIANS), "pooled_slop_score",
        F.col("ban_hits").cast("long").alias("ban_hits"), S.rounded(1000 * F.col("ban_hits"), F.col("n_tokens"), 2).alias("ban_per_1k"),
        F.col("tic_hits").cast("long").alias("tic_hits"), S.rounded(1000 * F.col("tic_hits"), F.col("n_tokens"), 2).alias("tic_per_1k"),
        F.transform("top_tics", lambda x: F.struct(x["tic"].alias("tic"), x["hits"].alias("hits"))).alias("top_tics"),
    )


def compared(base: Column, other: Column, down: bool = True) -> Column:
    """win if the other arm is better; a missing value loses."""
    return F.when((other < base) if down else (other > base), "win").otherwise("loss")
