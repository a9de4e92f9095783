"""N-gram tables: explode, count, rank, spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import keys as K


def exploded(df: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """keys, n, ngram: a row for each bigram and trigram.  Explode and partial count stay in one stage."""
    both = F.array(*(F.struct(F.lit(n).alias("n"), T.ngrams(F.col(tokens), n).alias("grams")) for n in (2, 3)))
    return df.select(*keys, F.explode(both).alias("g")).select(*keys, F.col("g.n").alias("n"), F.explode("g.grams").alias("ngram"))


def counted(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    return df.groupBy(*by, "n", "ngram").agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("frequency"))


#: Ranks up to which Spark cuts each partition before it shuffles.
RANKED_EARLY = 1000


#: First characters by which ties at the least frequency are told apart before they are ranked.
TIE_CHARS = 4


def top(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k most frequent of each group, ties by n-gram, with their rank.

    For a large k, the least frequency that can be among them is found from the frequencies' counts first, and the last
    first characters that can be among the ties there; so only about k rows a group are sorted, not the whole group in one
    task."""
    if k > RANKED_EARLY:
        above = F.coalesce(F.sum("c").over(W.partitionBy(*by).orderBy(F.desc("frequency")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = df.groupBy(*by, "frequency").agg(F.count("*").alias("c")).withColumn("above", above).where(F.col("above") < k)
        least = counts.groupBy(*by).agg(F.min(F.struct("frequency", "above")).alias("least"))
        df = df.join(least, by) if by else df.crossJoin(least)
        start = F.left("ngram", F.lit(TIE_CHARS)).alias("start")
        ties = df.where(F.col("frequency") == F.col("least.frequency")).groupBy(*by, start).agg(F.count("*").alias("c"), F.any_value("least.above").alias("above"))
        before = F.coalesce(F.sum("c").over(W.partitionBy(*by).orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        last = ties.withColumn("before", before).where(F.col("before") + F.col("above") < k).groupBy(*by).agg(F.max("start").alias("last"))
        df = df.join(last, by) if by else df.crossJoin(last)
        df = df.where((F.col("frequency") > F.col("least.frequency")) | (F.col("frequency") == F.col("least.frequency")) & (start <= F.col("last"))).drop("least", "last")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("frequency"), "ngram"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def likely_top(df: DataFrame, k: int, by: str | None = None, sizes: tuple[int, ...] = (2, 3), weight: str | None = None) -> DataFrame:
    """n, ngram, frequency (and `by`) of df(tokens, by, weight): all n-grams that can be among the k most frequent of an n and
    group, ties included, and few others; their keys are found first, and only these become strings."""
    own = K.saved(df.select("tokens", *([by] if by else []), *([weight] if weight else [])), "tokens")  # two passes read it
    marked = K.among_top(own, k, sizes, by, weight)
    keys = [by] if by else []
    if marked is None:  # many share a frequency with the last of them
        grams = exploded(own, [*keys, *([weight] if weight else [])]).where(F.col("n").isin(*sizes))
        return counted(grams, keys, weight)
    return K.counted_in(own, keys, marked, sizes, weight).groupBy(*keys, "n", "ngram").agg(F.sum("c").cast("long").alias("frequency"))


def without(df: DataFrame, stop: list[str]) -> DataFrame:
    """Drops n-grams that hold any of the words; they were formed before, so a stop word parts its neighbours."""
    return df.where(~F.arrays_overlap(F.split("ngram", " "), F.array(*map(F.lit, stop)))) if stop else df


def spread(df: DataFrame, subject: str, stop: list[str], min_count: int = 1) -> DataFrame:
    """n, ngram, count, and the number of different subjects of the n-grams of df(subject, tokens) that occur so often.

    Most n-grams are rare; which may be frequent is found from their keys, and only these become strings and are exchanged,
    once, for both counts."""
    if min_count > 1:
        grams = K.counted_in(df, [subject], K.at_least(df, min_count))
    else:
        grams = exploded(df, [subject]).withColumn("c", F.lit(1).cast("long"))
    each = without(grams, stop).repartition(K.parts(df), "n", "ngram").groupBy("n", "ngram", subject).agg(F.sum("c").alias("c"))
    return each.groupBy("n", "ngram").agg(F.sum("c").cast("long").alias("count"), F.count(subject).cast("long").alias("spread")).where(F.col("count") >= min_count)
