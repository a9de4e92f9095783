"""Corpus filters, token budgets and the frequency profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from . import keys as K
from . import ngrams as N

#: Ids of one stretch of a running total.
STRETCH = 1 << 16


def in_band(register: str = "register", perplexity: str = "perplexity", registers: tuple[str, ...] = ("web", "expository")) -> Column:
    """Whether a document passes: the band holds for some registers, and a null passes."""
    p = F.col(perplexity)
    return ~F.coalesce(F.col(register).isin(*registers), F.lit(False)) | p.isNull() | p.between(*C.PERPLEXITY_BAND)


def degenerate(tokens: Column) -> Column:
    """Long documents of which one token makes up too much; in whole numbers."""
    return T.let(tokens, lambda t: F.when(F.size(t) >= C.DEGENERATE_TOKENS, T.most_repeated(t) * 100 > F.size(t) * C.DEGENERATE_PERCENT).otherwise(False))


def running_before(df: DataFrame, key: str, order: str, value: str, out: str = "before") -> DataFrame:
    """df with the sum of `value` over the rows of the same key before this one.

    Two levels: stretches of ids get sums of their own, which are few; so no task holds all rows of a hot key.  A stretch is
    as wide as STRETCH rows take on average, whether ids are dense or hashes.  Three numbers reach the driver."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    width = max(1.0, (float(high) - float(low) + 1) / max(1, -(-n // STRETCH))) if n else 1.0
    own = df.withColumn("stretch", F.floor((F.col(order).cast("double") - float(low or 0)) / width).cast("long"))
    sums = own.groupBy(key, "stretch").agg(F.sum(value).alias("stretch_sum"))
    offset = F.coalesce(F.sum("stretch_sum").over(W.partitionBy(key).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(key).alias("k"), F.col("stretch").alias("s"), offset.alias("offset"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(key, "stretch").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = own.join(sums, own[key].eqNullSafe(sums["k"]) & own["stretch"].eqNullSafe(sums["s"]))
    return joined.withColumn(out, (F.col("offset") + inside).cast("long")).drop("stretch", "k", "s", "offset")


def within_budget(df: DataFrame, budget: int | Column, key: str = "source", order: str = "doc_id", value: str = "n_tokens") -> DataFrame:
    """Documents in order until the budget is met; the one that crosses it is still in."""
    return running_before(df, key, order, value).where(F.col("before") < budget)


def budgets(registers: dict[str, list[str]], weights: dict[str, int], total: int = C.TOKEN_BUDGET) -> dict[str, int]:
    """Tokens of each source, by its register's weight."""
    whole = sum(weights.values())
    return {source: max(1, int(total * weights[r] / whole) // len(sources)) for r, sources in registers.items() for source in sources}


def dealt(df: DataFrame, total: int = C.TOKEN_BUDGET, weights: dict[str, int] | None = None) -> DataFrame:
    """df(register, source) with `pair`, a key of both, and `budget`, what that source of that register gets of the total.

    A source that occurs in several registers is one source of each.  Without weights the registers are equal.  Only the
    distinct pairs reach the driver, and a register's budget the plan."""
    register, pair = F.coalesce("register", F.lit("")), F.to_json(F.struct("register", "source"))
    sources: dict[str, list[str]] = {}
    for r, name in df.select(register, pair).distinct().collect():
        sources.setdefault(r, []).append(name)
    each = budgets(sources, {r: 1 for r in sources} if weights is None else weights, total)
    of_register = [F.lit(x) for r, names in sources.items() for x in (r, each[names[0]])]
    budget = F.element_at(F.create_map(*of_register), register) if of_register else F.lit(0)
    return df.withColumn("pair", pair).withColumn("budget", budget.cast("long"))


def prepared(df: DataFrame, header_registers: tuple[str, ...] = ("political",), nfkc: bool = True) -> DataFrame:
    """register, source, doc_id, text, perplexity -> the same with header-free text, its tokens and n_tokens."""
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("register").isin(*header_registers), T.without_header(text)).otherwise(text)
    df = df.withColumn("text", text)
    own = df.withColumn("plain", T.nfkc(F.col("text")) if nfkc else F.col("text"))
    df = own.withColumn("tokens", T.content_tokens(F.col("plain"))).drop("plain")
    return df.withColumn("n_tokens", F.size("tokens").cast("long"))


def usable(df: DataFrame) -> DataFrame:
    """Documents of too few tokens, or degenerate ones, get null tokens, 0 of them.

    A filter would be pushed below the token column and build the tokens again."""
    tokens = T.let(F.col("tokens"), lambda t: F.when((F.size(t) >= 2) & ~degenerate(t), t))
    return df.withColumn("tokens", tokens).withColumn("n_tokens", F.coalesce(F.size("tokens"), F.lit(0)).cast("long"))


def register_report(df: DataFrame, banded: tuple[str, ...] = ("web", "expository")) -> DataFrame:
    """Per register: documents, characters, tokens kept; documents out of the band and degenerate ones; share of characters."""
    passes = in_band(registers=banded)
    kept = passes & (F.col("n_tokens") >= 2) & ~F.col("bad")
    own = df.withColumn("bad", degenerate(F.col("tokens")))
    sums = own.groupBy("register").agg(
        F.count_if(kept).cast("long").alias("docs"),
        F.coalesce(F.sum(F.when(kept, F.char_length("text"))), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(F.sum(F.when(kept, F.col("n_tokens"))), F.lit(0)).cast("long").alias("tokens"),
        F.count_if(~passes).cast("long").alias("skipped_ppl"),
        F.count_if(passes & (F.col("n_tokens") >= 2) & F.col("bad")).cast("long").alias("skipped_degenerate"),
    )
    whole = sums.agg(F.sum("chars").alias("all_chars"))
    return sums.crossJoin(F.broadcast(whole)).withColumn("char_pct", 100 * F.col("chars") / F.nullif(F.col("all_chars"), F.lit(0))).drop("all_chars")


def weighted_sentences(df: DataFrame) -> DataFrame:
    """sentence, count -> tokens, weight and characters of the sentences that are no credits and leave a bigram."""
    own = df.where(~T.subtitle_noise(F.col("sentence"))).withColumn("tokens", T.content_tokens(T.nfkc(F.col("sentence")))).where(F.size("tokens") >= 2)
    return own.withColumn("w", F.least("count", F.lit(C.SENTENCE_WEIGHT_CAP))).withColumn("contribution", F.char_length("sentence") * F.col("w"))


def scaled_sentences(df: DataFrame, corpus_chars: DataFrame) -> DataFrame:
    """The sentences with `weight`: scaled so that they make up their share of the corpus, the scale capped.

    corpus_chars: one row, total_chars."""
    own = K.saved(weighted_sentences(df).select("sentence", "tokens", "w", "contribution"), "sentences")  # for the mass and the weights
    mass = own.agg(F.coalesce(F.sum("contribution"), F.lit(0)).alias("mass"))
    target = F.col("total_chars") * C.SUBTITLE_PERCENT / (100 - C.SUBTITLE_PERCENT)
    scale = mass.crossJoin(corpus_chars).select(F.least(F.coalesce(target / F.nullif(F.col("mass"), F.lit(0)), F.lit(1.0)), F.lit(C.SUBTITLE_SCALE_CAP)).alias("scale"))
    return own.crossJoin(F.broadcast(scale)).withColumn("weight", F.greatest(F.lit(1), F.bround(F.col("w") * F.col("scale"))).cast("long"))


def profile(documents: DataFrame, budget: int | Column, sentences: DataFrame | None = None, k: int = C.PROFILE_TOP_K, banded: tuple[str, ...] = ("web", "expository"), nfkc: bool = True) -> DataFrame:
    """n, ngram, frequency, rank of the k most frequent bigrams and trigrams of documents within budget and of scaled sentences."""
    kept = within_budget(usable(prepared(documents.where(in_band(registers=banded)), nfkc=nfkc)), budget)
    if sentences is None:
        return N.top(N.likely_top(kept, k), k, ["n"])
    chars = kept.agg(F.coalesce(F.sum(F.when(F.col("n_tokens") > 0, F.char_length("text"))), F.lit(0)).alias("total_chars"))
    more = scaled_sentences(sentences, chars).select("tokens", "weight")
    both = kept.select("tokens", F.lit(1).cast("long").alias("weight")).unionByName(more)
    return N.top(N.likely_top(both, k, weight="weight"), k, ["n"])


def nested_profile(ranked: DataFrame, name: str, total_chars: int | Column) -> DataFrame:
    """One row as exported: model_name, total_chars, top_bigrams, top_trigrams.  Of the truncated profile only."""

    def listed(n: int) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("n") == n, F.struct("rank", "ngram", "frequency"))))
        return F.transform(rows, lambda x: F.struct(x["ngram"].alias("ngram"), x["frequency"].alias("frequency")))

    return ranked.agg(F.lit(name).alias("model_name"), F.lit(total_chars).cast("long").alias("total_chars"), listed(2).alias("top_bigrams"), listed(3).alias("top_trigrams"))
