"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import corpus, discriminate, evaluate, judge, keys, ngrams, phrases, prompts
from . import oracle as O
from .inline import ANSWERS, ARMS, BLIND, COPY_TYPES, LENGTHS, PHRASES, SELECTION, SUBJECTS, TONES, VERDICTS, WORDS, rows

FLAGSHIP = "bigram_topk_by_register"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Tokens of one source in budget_cut and ngram_profile, where they show the cut; the queries that end in _full have the reference's.
BUDGET = 5_000
#: The registers of `lang` that the perplexity band holds for.
BANDED = ("en", "fr")
PROFILE_K = 500


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Columns that queries take of the tables with texts.
TEXTS = {"documents": ["doc_id", "lang", "source", "text"], "pages": ["page_id", "html"], "conversations": ["conv_id", "turn", "role", "text"]}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts is dealt out where its files are fewer than the cores, which a large corpus never is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.select(TEXTS[name]).repartition(cores) if name in TEXTS and len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("register"), "source", "text")


def tokenised(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", T.content_tokens(T.nfkc(F.col("text"))))


def with_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stand-in for perplexity: labels of quality 1 in the band, of quality 0 out of it, others null."""
    marks = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return documents(spark, sf_dir).join(marks, "doc_id", "left").withColumn("perplexity", F.when(F.col("quality") == 1, 100.0).when(F.col("quality") == 0, 5000.0)).drop("quality")


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("arm"), "text")


BAND_SQL = """banded AS (SELECT d.doc_id, d.lang AS register, d.source, coalesce(d.text, '') AS text, CASE q.quality WHEN 1 THEN 100.0 WHEN 0 THEN 5000.0 END AS perplexity
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) q ON d.doc_id = q.doc_id)"""
PASS_SQL = f"(register NOT IN ('en', 'fr') OR perplexity IS NULL OR perplexity BETWEEN {C.PERPLEXITY_BAND[0]} AND {C.PERPLEXITY_BAND[1]})"
#: doc_id, most: how often a document's most frequent token occurs.
MOST_SQL = "most AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(t) AS x FROM tok) GROUP BY doc_id, x) GROUP BY doc_id)"
BAD_SQL = f"(len(t) >= {C.DEGENERATE_TOKENS} AND most * 100 > len(t) * {C.DEGENERATE_PERCENT})"


@query(
    "WITH "
    + O.content("tok", "doc_id", "documents")
    + " SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_types, list_min(t) AS first_token, list_max(t) AS last_token FROM tok"
)
def norm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tokens")
    return tokenised(documents(spark, sf_dir)).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_types"), F.array_min(t).alias("first_token"), F.array_max(t).alias("last_token"))


@query("WITH " + O.content("tok", "doc_id", "documents") + " SELECT doc_id, md5(array_to_string(t, ' ')) AS tokens_md5 FROM tok")
def nfkc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With normalisation, which changes none of these documents."""
    own = documents(spark, sf_dir).select("doc_id", T.nfkc(F.coalesce("text", F.lit(""))).alias("text"))
    return own.select("doc_id", F.md5(F.array_join(T.content_tokens(F.col("text")), " ")).alias("tokens_md5"))


@query(
    "WITH "
    + O.content("tok", "page_id", "pages", "html")
    + " SELECT page_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM tok"
)
def html_strip_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "pages").select("page_id", T.content_tokens(T.nfkc(F.col("html"))).alias("t"))
    return tokens.select("page_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "WITH "
    + O.content("tok", "doc_id, lang AS register", "documents").replace("tok AS (SELECT doc_id, lang AS register", "tok AS (SELECT doc_id, register")
    + ", "
    + O.grams("g", "register", "tok")
    + """, c AS (SELECT register, ngram, count(*) AS frequency FROM g WHERE n = 2 GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY register ORDER BY frequency DESC, ngram) AS INTEGER) AS rank FROM c)
SELECT register, ngram, frequency, rank FROM r WHERE rank <= 50"""
)
def bigram_topk_by_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = ngrams.likely_top(tokenised(documents(spark, sf_dir)), 50, "register", (2,))
    return ngrams.top(grams, 50, ["register"]).select("register", "ngram", "frequency", "rank")


@query("WITH " + O.content("tok", "doc_id", "documents") + ", " + O.grams("g", "doc_id", "tok") + " SELECT ngram, count(*) AS frequency FROM g WHERE n = 3 GROUP BY ngram ORDER BY frequency DESC, ngram LIMIT 100")
def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = ngrams.likely_top(tokenised(documents(spark, sf_dir)), 100, sizes=(3,))
    return grams.select("ngram", "frequency").orderBy(F.desc("frequency"), "ngram").limit(100)


OK_SQL = (
    BAND_SQL
    + ", "
    + O.content("tok", "doc_id, register, source, text", f"(SELECT * FROM banded WHERE {PASS_SQL})")
    + f", {MOST_SQL}, ok AS (SELECT tok.* FROM tok LEFT JOIN most USING (doc_id) WHERE len(t) >= 2 AND NOT coalesce({BAD_SQL}, false)),"
)
KEPT_SQL = (
    OK_SQL
    + " run AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ok),"
    + f" kept AS (SELECT * FROM run WHERE before < {BUDGET})"
)


@query(f"WITH {KEPT_SQL}, {O.grams('g', 'doc_id', 'kept')}, c AS (SELECT n, ngram, count(*) AS frequency FROM g GROUP BY n, ngram), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY frequency DESC, ngram) AS INTEGER) AS rank FROM c) SELECT n, ngram, frequency, rank FROM r WHERE rank <= {PROFILE_K}")
def ngram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profile(with_band(spark, sf_dir), BUDGET, k=PROFILE_K, banded=BANDED)


#: register, budget: a register's part of all tokens, dealt to its sources.
DEALT_SQL = f"dealt AS (SELECT lang AS register, greatest(1, ({C.TOKEN_BUDGET} // (SELECT count(DISTINCT lang) FROM documents)) // count(DISTINCT source)) AS budget FROM documents GROUP BY lang)"


@query(
    f"WITH {OK_SQL} run AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY register, source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ok), {DEALT_SQL}, kept AS (SELECT run.* FROM run JOIN dealt ON run.register = dealt.register WHERE before < budget), "
    f"{O.grams('g', 'doc_id', 'kept')}, c AS (SELECT n, ngram, count(*) AS frequency FROM g GROUP BY n, ngram), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY frequency DESC, ngram) AS INTEGER) AS rank FROM c) SELECT n, ngram, frequency, rank FROM r WHERE rank <= {C.PROFILE_TOP_K}"
)
def ngram_profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the reference's budget and length of the profile."""
    own = corpus.dealt(with_band(spark, sf_dir))
    return corpus.profile(own.withColumn("source", F.col("pair")), F.col("budget"), banded=BANDED)


@query(
    f"WITH {BAND_SQL}, "
    + O.content("tok", "doc_id, register, text, perplexity", "banded")
    + f", {MOST_SQL}, s AS (SELECT register, {PASS_SQL} AS ok, len(t) >= 2 AS two, coalesce({BAD_SQL}, false) AS bad, length(text) AS c, len(t) AS k FROM tok LEFT JOIN most USING (doc_id))"
    + """, a AS (SELECT register, count_if(ok AND two AND NOT bad) AS docs, coalesce(sum(c) FILTER (ok AND two AND NOT bad), 0) AS chars, coalesce(sum(k) FILTER (ok AND two AND NOT bad), 0) AS tokens, count_if(NOT ok) AS skipped_ppl, count_if(ok AND two AND bad) AS skipped_degenerate FROM s GROUP BY register)
SELECT register, CAST(docs AS BIGINT) AS docs, CAST(chars AS BIGINT) AS chars, CAST(tokens AS BIGINT) AS tokens, CAST(skipped_ppl AS BIGINT) AS skipped_ppl, CAST(skipped_degenerate AS BIGINT) AS skipped_degenerate, CAST(100 * chars AS DOUBLE) / CAST(sum(chars) OVER () AS DOUBLE) AS char_pct FROM a"""
)
def register_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.register_report(corpus.prepared(with_band(spark, sf_dir)), BANDED)


HEADER = "Deutscher Bundestag — 12. Wahlperiode — 3. Sitzung. Bonn, den 5. "


@query(f"SELECT doc_id, md5(CASE WHEN lang = 'de' THEN regexp_replace({O.quoted(HEADER)} || text, {O.quoted('(?i)' + C.PLENARY_HEADER)}, ' ', 'g') ELSE {O.quoted(HEADER)} || text END) AS clean_md5 FROM documents")
def header_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plenary header goes in the register that has it."""
    own = documents(spark, sf_dir).withColumn("text", F.concat(F.lit(HEADER), "text"))
    return corpus.prepared(own, header_registers=("de",)).select("doc_id", F.md5("text").alias("clean_md5"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("sentence")).where(~T.blank(F.col("sentence")))
    return lines.groupBy("sentence").agg(F.count("*").alias("count"))


@query(
    "WITH s AS (SELECT sentence, count(*) AS cnt FROM (SELECT unnest(string_split(text, chr(10))) AS sentence FROM documents) WHERE regexp_matches(sentence, '[^\\s\\p{Z}]') GROUP BY sentence), "
    + O.content("tok", "sentence, cnt", f"(SELECT * FROM s WHERE NOT regexp_matches(sentence, {O.quoted('(?i)' + C.SUBTITLE_NOISE)}))", "sentence")
    + f", k AS (SELECT *, least(cnt, {C.SENTENCE_WEIGHT_CAP}) AS w FROM tok WHERE len(t) >= 2), z AS (SELECT least(((SELECT sum(length(text)) FROM documents) * {C.SUBTITLE_PERCENT} / {100 - C.SUBTITLE_PERCENT}) / sum(length(sentence) * w), {C.SUBTITLE_SCALE_CAP}) AS scale FROM k)"
    + ", v AS (SELECT t, CAST(greatest(1, round_even(w * scale, 0)) AS BIGINT) AS weight FROM k, z), "
    + O.grams("g", "weight", "v")
    + " SELECT n, ngram, CAST(sum(weight) AS BIGINT) AS frequency FROM g GROUP BY n, ngram ORDER BY frequency DESC, ngram, n LIMIT 200"
)
def subtitle_scaled_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = documents(spark, sf_dir).agg(F.sum(F.char_length("text")).alias("total_chars"))
    grams = ngrams.likely_top(corpus.scaled_sentences(sentences(spark, sf_dir), chars), 200, weight="weight")
    return grams.orderBy(F.desc("frequency"), "ngram", "n").limit(200)


@query(
    f"WITH {KEPT_SQL}, s AS (SELECT sentence, count(*) AS cnt FROM (SELECT unnest(string_split(text, chr(10))) AS sentence FROM documents) WHERE regexp_matches(sentence, '[^\\s\\p{{Z}}]') GROUP BY sentence), "
    + O.content("st", "sentence, cnt", f"(SELECT * FROM s WHERE NOT regexp_matches(sentence, {O.quoted('(?i)' + C.SUBTITLE_NOISE)}))", "sentence")
    + f", k AS (SELECT *, least(cnt, {C.SENTENCE_WEIGHT_CAP}) AS w FROM st WHERE len(t) >= 2), z AS (SELECT least(((SELECT coalesce(sum(length(text)), 0) FROM kept) * {C.SUBTITLE_PERCENT} / {100 - C.SUBTITLE_PERCENT}) / sum(length(sentence) * w), {C.SUBTITLE_SCALE_CAP}) AS scale FROM k)"
    + ", v AS (SELECT t, CAST(greatest(1, round_even(w * scale, 0)) AS BIGINT) AS weight FROM k, z UNION ALL SELECT t, 1 FROM kept), "
    + O.grams("g", "weight", "v")
    + f", c AS (SELECT n, ngram, CAST(sum(weight) AS BIGINT) AS frequency FROM g GROUP BY n, ngram), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY frequency DESC, ngram) AS INTEGER) AS rank FROM c) SELECT n, ngram, frequency, rank FROM r WHERE rank <= {PROFILE_K}"
)
def ngram_profile_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of documents and of sentences scaled to their share."""
    return corpus.profile(with_band(spark, sf_dir), BUDGET, sentences(spark, sf_dir), k=PROFILE_K, banded=BANDED)


@query(
    "WITH "
    + O.content("tok", "doc_id, source", "documents")
    + f", r AS (SELECT doc_id, source, len(t) AS n_tokens, coalesce(sum(len(t)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tok) SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(before AS BIGINT) AS before FROM r WHERE before < {BUDGET}"
)
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tokenised(documents(spark, sf_dir)).select("doc_id", "source", F.size("tokens").cast("long").alias("n_tokens"))
    return corpus.within_budget(own, BUDGET).select("doc_id", "source", "n_tokens", "before")


@query(
    "WITH "
    + O.content("tok", "doc_id, source, lang AS register", "documents").replace("tok AS (SELECT doc_id, source, lang AS register", "tok AS (SELECT doc_id, source, register")
    + f", {DEALT_SQL}, r AS (SELECT doc_id, register, source, len(t) AS n_tokens, coalesce(sum(len(t)) OVER (PARTITION BY register, source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tok)"
    + " SELECT doc_id, r.register, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(before AS BIGINT) AS before, CAST(budget AS BIGINT) AS budget FROM r JOIN dealt ON r.register = dealt.register WHERE before < budget"
)
def budget_cut_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the reference's budget."""
    own = corpus.dealt(tokenised(documents(spark, sf_dir)).select("doc_id", "register", "source", F.size("tokens").cast("long").alias("n_tokens")))
    return corpus.within_budget(own, F.col("budget"), key="pair").select("doc_id", "register", "source", "n_tokens", "before", "budget")


@query("WITH " + O.content("tok", "doc_id", "documents") + f", {MOST_SQL} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(coalesce(most, 0) AS BIGINT) AS most, coalesce({BAD_SQL}, false) AS degenerate FROM tok LEFT JOIN most USING (doc_id)")
def degenerate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tokenised(documents(spark, sf_dir))
    return own.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), T.most_repeated(F.col("tokens")).cast("long").alias("most"), corpus.degenerate(F.col("tokens")).alias("degenerate"))


#: The profile that samples are held against: n-grams of the conversations.
TALK_SQL = O.content("talk", "conv_id", "(SELECT * FROM conversations WHERE role = 'assistant')") + ", " + O.grams("tg", "conv_id", "talk") + ", base AS (SELECT n, ngram, count(*) AS baseline FROM tg GROUP BY n, ngram)"
STOP = [*C.ECHO_WORDS, "that", "ction"]
MIN_COUNT = 5
SPREAD_SQL = (
    "WITH "
    + O.content("tok", "source", "documents")
    + ", "
    + O.grams("g", "source", "tok")
    + f", {TALK_SQL}, c AS (SELECT n, ngram, count(*) AS cnt, count(DISTINCT source) AS spread FROM g WHERE NOT list_has_any(string_split(ngram, ' '), {O.listed(STOP)}) GROUP BY n, ngram HAVING count(*) >= {MIN_COUNT})"
    + f", f AS (SELECT CASE WHEN spread >= {C.SLOP_SPREAD} THEN 'slop?' WHEN spread <= {C.STRIKE_SPREAD} THEN 'strike' ELSE 'review' END AS keep, c.ngram, cnt AS count, spread, coalesce(baseline, 0) AS baseline FROM c LEFT JOIN base ON c.n = base.n AND c.ngram = base.ngram WHERE coalesce(baseline, 0) < {C.CANDIDATE_MAX_BASELINE})"
)


def talk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = tokenised(read(spark, sf_dir, "conversations").where("role = 'assistant'").select("text"))
    return ngrams.counted(ngrams.exploded(talk, []), [])


@query(SPREAD_SQL + " SELECT keep, ngram, count, spread, baseline FROM f")
def spread_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tokenised(documents(spark, sf_dir)).select(F.col("source").alias("subject_id"), "tokens")
    return discriminate.candidates(samples, talk_profile(spark, sf_dir), STOP, min_count=MIN_COUNT)


@query(SPREAD_SQL + " SELECT keep, count(*) AS n FROM f GROUP BY keep")
def spread_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_candidates(spark, sf_dir).groupBy("keep").agg(F.count("*").alias("n"))


DOC_BASE_SQL = O.content("doc", "doc_id", "documents") + ", " + O.grams("dg", "doc_id", "doc") + ", base AS (SELECT n, ngram, count(*) AS frequency FROM dg GROUP BY n, ngram)"


@query(
    f"WITH {DOC_BASE_SQL}, "
    + O.content("talk", "conv_id", "(SELECT * FROM conversations WHERE role = 'assistant')")
    + ", "
    + O.grams("tg", "conv_id", "talk")
    + ", c AS (SELECT n, ngram, count(*) AS count FROM tg GROUP BY n, ngram ORDER BY count DESC, ngram LIMIT 25) SELECT c.ngram, count, coalesce(frequency, 0) AS baseline, CASE WHEN coalesce(frequency, 0) = 0 THEN 'missing' WHEN frequency < 1000 THEN 'rare' ELSE 'natural' END AS flag FROM c LEFT JOIN base ON c.n = base.n AND c.ngram = base.ngram"
)
def emergent_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = tokenised(read(spark, sf_dir, "conversations").where("role = 'assistant'").select("text"))
    return discriminate.emergent(talk, doc_profile(spark, sf_dir), [])


@query(SPREAD_SQL + f" SELECT keep, ngram, count, spread, baseline FROM f WHERE keep = 'slop?' ORDER BY spread DESC, count DESC, ngram LIMIT 30")
def top_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminate.top_slop(spread_candidates(spark, sf_dir))


def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.counted(ngrams.exploded(tokenised(documents(spark, sf_dir)), []), [])


def asked_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed candidates, and every benchmark text."""
    fixed = rows(spark, "kind string, phrase string", C.CANDIDATES)
    return fixed.unionByName(read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("text").alias("phrase")))


LOOKUP_SQL = (
    f"WITH {DOC_BASE_SQL}, asked AS (SELECT * FROM ({O.values(C.CANDIDATES)}) v(kind, phrase) UNION ALL SELECT 'benchmark', text FROM benchmark), "
    + O.content("pt", "phrase", "(SELECT DISTINCT phrase FROM asked)", "phrase")
    + """, pg AS (SELECT phrase, 2 AS n, unnest(range(1, len(t))) AS i, t FROM pt UNION ALL SELECT phrase, 3, unnest(range(1, len(t) - 1)), t FROM pt),
pk AS (SELECT phrase, n, i, array_to_string(list_slice(t, i, i + n - 1), ' ') AS ngram FROM pg),
pj AS (SELECT phrase, pk.n, i, pk.ngram, coalesce(frequency, 0) AS frequency FROM pk LEFT JOIN base ON pk.n = base.n AND pk.ngram = base.ngram),
pr AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY frequency, n, i) AS k FROM pj),
found AS (SELECT pt.phrase, CASE WHEN len(t) = 0 THEN '' WHEN len(t) = 1 THEN t[1] ELSE ngram END AS ngram, CAST(coalesce(frequency, -1) AS BIGINT) AS frequency,
CASE WHEN len(t) = 0 THEN 'n/a' WHEN len(t) = 1 THEN 'unigram' WHEN frequency = 0 THEN 'absent' WHEN frequency < 100 THEN 'very rare' WHEN frequency < 1000 THEN 'borderline' ELSE 'present' END AS verdict FROM pt LEFT JOIN (SELECT * FROM pr WHERE k = 1) pr ON pt.phrase = pr.phrase)"""
)


@query(LOOKUP_SQL + " SELECT phrase, ngram, frequency, verdict FROM found")
def phrase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminate.lookup(asked_phrases(spark, sf_dir), doc_profile(spark, sf_dir))


@query(LOOKUP_SQL + " SELECT kind, count_if(frequency > 0) AS present, count(*) AS total FROM asked JOIN found ON asked.phrase = found.phrase GROUP BY kind".replace("count_if(frequency > 0)", "CAST(count_if(frequency > 0) AS BIGINT)"))
def control_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discriminate.lookup(asked_phrases(spark, sf_dir), doc_profile(spark, sf_dir))
    return discriminate.coverage(asked_phrases(spark, sf_dir).join(found, "phrase"), "kind")


@query(
    "WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY w) "
    f"SELECT word, coalesce(n, 0) AS count, CASE WHEN coalesce(n, 0) < 500 THEN 'rarely spoken' ELSE 'common in dialogue' END AS hint FROM ({O.values((w,) for w in WORDS)}) v(word) LEFT JOIN c ON lower(word) = w"
)
def word_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = documents(spark, sf_dir).select(F.explode(T.word_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    return discriminate.word_hints(rows(spark, "word string", [(w,) for w in WORDS]), counts).select("word", "count", "hint")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.containment(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), "item_id").select("doc_id", "item_id")


PHRASE_SQL = O.values((p,) for p in PHRASES)


@query(
    f"WITH p AS (SELECT phrase FROM ({PHRASE_SQL}) v(phrase)), h AS (SELECT role, sum({O.occurrences('lower(text)', 'lower(phrase)')}) AS hits FROM conversations, p GROUP BY role), k AS (SELECT role, sum(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS n FROM conversations GROUP BY role) "
    "SELECT k.role AS arm, CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST(n AS BIGINT) AS n_tokens, CAST(1000 * coalesce(hits, 0) AS DOUBLE) / CAST(n AS DOUBLE) AS per_1k FROM k LEFT JOIN h ON k.role = h.role"
)
def ban_hits_per_1k(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = arms(spark, sf_dir)
    hits = phrases.phrase_hits(texts.select("arm", "text"), rows(spark, "phrase string", [(p,) for p in PHRASES])).groupBy("arm").agg(F.sum("hits").alias("hits"))
    tokens = texts.groupBy("arm").agg(F.sum(F.size(T.word_tokens(F.col("text")))).cast("long").alias("n_tokens"))
    return tokens.join(hits, "arm", "left").select("arm", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "n_tokens", phrases.per_thousand(F.coalesce("hits", F.lit(0)), F.col("n_tokens")).alias("per_1k"))


@query(
    f"WITH p AS (SELECT phrase FROM ({PHRASE_SQL}) v(phrase)), s AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\\s\\p{{Z}}]+', ' ', 'g')) AS t FROM documents) SELECT phrase, CAST(sum({O.occurrences('t', 'phrase')}) AS BIGINT) AS hits FROM s, p GROUP BY phrase HAVING sum({O.occurrences('t', 'phrase')}) > 0"
)
def seed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("doc_id", "text")
    return phrases.phrase_hits(own, rows(spark, "phrase string", [(p,) for p in PHRASES]), lower_phrase=False, squeeze=True).groupBy("phrase").agg(F.sum("hits").cast("long").alias("hits"))


HIGHLIGHTED = [*PHRASES, "l'eau", "“and", "r&d <the>"]


@query(f"SELECT doc_id, CAST(len(regexp_extract_all({O.escaped('text')}, {O.quoted('(?i)' + phrases.alternation(HIGHLIGHTED))})) AS BIGINT) AS hits FROM documents")
def highlight_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.highlight_hits(documents(spark, sf_dir).select("doc_id", "text"), HIGHLIGHTED)


@query(f"SELECT conv_id, turn, md5(regexp_replace({O.escaped('text')}, {O.quoted('(?i)(' + phrases.alternation(HIGHLIGHTED) + ')')}, '<mark>\\1</mark>', 'g')) AS html_md5 FROM conversations")
def marked_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped texts with the phrases marked."""
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return phrases.highlighted(talk, HIGHLIGHTED).select("conv_id", "turn", F.md5("html").alias("html_md5"))


BANNED = ["the entire", "que ment", "and the", "nur der", "with that", "the tion the"]


@query(
    "WITH "
    + O.content("tok", "conv_id, turn, role", "conversations")
    + ", "
    + O.grams("g", "role", "tok")
    + f" SELECT role AS arm, ngram, count(*) AS hits FROM g WHERE list_contains({O.listed(BANNED + ['ention entre', 'tion and'])}, ngram) OR ngram IN (SELECT ngram FROM (SELECT ngram, count(*) AS c FROM g GROUP BY ngram ORDER BY c DESC, ngram LIMIT 20)) GROUP BY role, ngram"
)
def ngram_ban_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed n-grams, and the 20 most frequent, in the content-token stream of each arm."""
    grams = ngrams.exploded(tokenised(arms(spark, sf_dir)), ["arm"])
    most = grams.groupBy("ngram").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "ngram").limit(20).select("ngram")
    listed = rows(spark, "ngram string", [(b,) for b in [*BANNED, "ention entre", "tion and"]]).unionByName(most).distinct()
    return phrases.ngram_hits(grams, listed, ["arm"])


TICS = ("the ", "ich ", "que ", "en en", "aa")


TIC_SQL = "x AS (SELECT unnest(" + O.listed(TICS) + f") AS tic, unnest(range({len(TICS)})) AS ord), c AS (SELECT role AS arm, tic, ord, CAST(sum({O.occurrences('lower(text)', 'tic')}) AS BIGINT) AS hits FROM conversations, x GROUP BY role, tic, ord), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY arm ORDER BY hits DESC, ord) AS INTEGER) AS place FROM c)"


@query(f"WITH {TIC_SQL} SELECT arm, place, tic, hits FROM o WHERE place <= 3")
def top_tics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_tics(arms(spark, sf_dir), tics=TICS, k=3)


@query(f"WITH {TIC_SQL} SELECT o.place, o.tic, coalesce(b.hits, 0) AS base, o.hits AS other FROM o LEFT JOIN o b ON b.arm = 'user' AND b.tic = o.tic WHERE o.arm = 'assistant' AND o.place <= 5 AND o.hits > 0")
def tic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.tic_changes(arms(spark, sf_dir), "user", "assistant", tics=TICS)


SEED_LISTS = [[p for k, p in C.CANDIDATES if k == kind] for kind in ("slop_phrases", "slop_phrases_functionword")] + [PHRASES]


@query(f"SELECT DISTINCT phrase FROM ({O.values((p,) for x in SEED_LISTS for p in x)}) v(phrase)")
def seed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of three lists once."""
    return phrases.seed_list([rows(spark, "phrase string", [(p,) for p in x]) for x in SEED_LISTS])


@query("WITH x AS (SELECT unnest(" + O.listed(TICS) + f") AS tic) SELECT role AS arm, tic, CAST(sum({O.occurrences('lower(text)', 'tic')}) AS BIGINT) AS hits FROM conversations, x GROUP BY role, tic")
def tic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.tic_counts(arms(spark, sf_dir), tics=TICS)


LOOP_SQL = r"""WITH w AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM conversations),
e AS (SELECT conv_id, turn, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM w),
g AS (SELECT conv_id, turn, x, i - row_number() OVER (PARTITION BY conv_id, turn, x ORDER BY i) AS island FROM e),
c AS (SELECT conv_id, turn, max(n) AS consec FROM (SELECT conv_id, turn, x, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY conv_id, turn),
b AS (SELECT conv_id, turn, max(n) AS bigram FROM (SELECT conv_id, turn, g2, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) AS g2 FROM w) GROUP BY ALL) GROUP BY conv_id, turn),
l AS (SELECT w.conv_id, w.turn, w.role, CAST(coalesce(consec, 0) AS BIGINT) AS consec, CAST(coalesce(bigram, 0) AS BIGINT) AS bigram FROM w LEFT JOIN c USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn))"""


def looped(spark: SparkSession, sf_dir: str) -> DataFrame:
    consec, bigram = evaluate.loops(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", consec.cast("long").alias("consec"), bigram.cast("long").alias("bigram"))


@query(LOOP_SQL + " SELECT conv_id, turn, consec, bigram FROM l")
def token_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looped(spark, sf_dir).drop("role")


@query(LOOP_SQL + f" SELECT role AS arm, CAST(count_if(consec >= {C.LOOP_RUN} OR bigram >= {C.LOOP_BIGRAM}) AS BIGINT) AS n_degenerate, count(*) AS n_texts FROM l GROUP BY role")
def degenerate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = evaluate.degenerate(F.col("consec"), F.col("bigram"))
    return looped(spark, sf_dir).groupBy(F.col("role").alias("arm")).agg(F.count_if(bad).cast("long").alias("n_degenerate"), F.count("*").alias("n_texts"))


LETTERS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '\\p{L}+'))"
LETTER_SQL = f"WITH w AS (SELECT doc_id, lang, {LETTERS} AS t FROM documents)"


@query(LETTER_SQL + ", c AS (SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS k FROM w WHERE len(t) > 0) SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(k AS BIGINT) AS n_types, CAST(k AS DOUBLE) / CAST(n AS DOUBLE) AS ttr, CAST(k AS DOUBLE) / sqrt(CAST(n AS DOUBLE)) AS rttr FROM c")
def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.letter_tokens(F.col("text"))
    own = documents(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_types")).where("n_tokens > 0")
    return own.select("*", (F.col("n_types") / F.col("n_tokens")).alias("ttr"), (F.col("n_types") / F.sqrt(F.col("n_tokens").cast("double"))).alias("rttr"))


@query(LETTER_SQL + ", e AS (SELECT lang, unnest(t) AS x FROM w) SELECT lang AS register, count(*) AS n_tokens, count(DISTINCT x) AS n_types FROM e GROUP BY lang")
def pooled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = documents(spark, sf_dir).select("register", F.explode(T.letter_tokens(F.col("text"))).alias("x")).groupBy("register", "x").agg(F.count("*").alias("c"))
    return each.groupBy("register").agg(F.sum("c").cast("long").alias("n_tokens"), F.count("*").alias("n_types"))


def mattr_sql(key: str, source: str) -> str:
    n = C.MATTR_WINDOW
    return f"""w AS (SELECT {key}, {LETTERS} AS t FROM {source}),
e AS (SELECT {key}, len(t) AS n, unnest(t) AS x, unnest(range(0, len(t))) AS j FROM w),
p AS (SELECT *, coalesce(lag(j) OVER (PARTITION BY {key}, x ORDER BY j), -1) AS p FROM e),
s AS (SELECT {key}, any_value(n) AS n, count(DISTINCT x) AS k, sum(greatest(0, least(j, n - {n}) - greatest(0, j - {n - 1}, p + 1) + 1)) AS total FROM p GROUP BY {key}),
m AS (SELECT {key}, CASE WHEN n < {n} THEN CAST(k AS DOUBLE) / CAST(n AS DOUBLE) ELSE CAST(total AS DOUBLE) / CAST({n} * (n - {n} + 1) AS DOUBLE) END AS mattr FROM s)"""


@query("WITH " + mattr_sql("doc_id", "documents") + " SELECT documents.doc_id, coalesce(mattr, 0) AS mattr FROM documents LEFT JOIN m ON documents.doc_id = m.doc_id")
def mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.mattr(T.letter_tokens(F.coalesce("text", F.lit("")))).alias("mattr"))


@query("WITH c AS (SELECT conv_id || '-' || turn AS id, role, text FROM conversations), " + mattr_sql("id", "c") + " SELECT role AS arm, median(mattr) AS median_mattr, count(*) AS n FROM c JOIN m ON c.id = m.id GROUP BY role")
def median_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = arms(spark, sf_dir).withColumn("t", T.letter_tokens(F.col("text"))).where(F.size("t") > 0)
    return own.groupBy("arm").agg(F.median(T.mattr(F.col("t"))).alias("median_mattr"), F.count("*").alias("n"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, '# T' || chr(10) || '- ' || text || ' [l](u) **x**' || chr(10) || '1. y' AS t FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(t, '\[(.*?)\]\(.*?\)', '\1', 'g'), '(?m)^\s*[-•\d]+[.\)]?\s+', '', 'g'), '[#*_`>]+', ' ', 'g')) AS clean_md5 FROM s"""
)
def md_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("# T\n- "), F.col("text"), F.lit(" [l](u) **x**\n1. y"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.without_markdown(marked)).alias("clean_md5"))


def configuration(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    subjects = rows(spark, "id string, name string, branche string, fakten array<string>, profiling boolean", SUBJECTS)
    return subjects, rows(spark, "id string, label string, template string, ord int", [(*x, k) for k, x in enumerate(COPY_TYPES)]), rows(spark, "id string, hint string", TONES), rows(spark, "id string, hint string", LENGTHS)


def _config_sql() -> str:
    def facts(x) -> str:
        return "CAST([] AS VARCHAR[])" if not x else O.listed(x)

    subjects = " UNION ALL ".join(f"SELECT {O.quoted(i)} AS id, {O.quoted(n)} AS name, {O.quoted(b)} AS branche, {facts(f)} AS fakten, {'NULL' if p is None else str(p).lower()}::BOOLEAN AS profiling" for i, n, b, f, p in SUBJECTS)
    return f"""WITH su AS ({subjects}), ct AS (SELECT * FROM ({O.values((*x, k) for k, x in enumerate(COPY_TYPES))}) v(id, label, template, ord)), tn AS (SELECT * FROM ({O.values(TONES)}) v(id, hint)), ln AS (SELECT * FROM ({O.values(LENGTHS)}) v(id, hint)),
ax AS (SELECT id, hint, true AS uses FROM ln UNION ALL SELECT 'na', '', false)"""


PROMPT_SQL = "trim(regexp_replace(replace(replace(replace(replace(replace(ct.template, '{name}', su.name), '{branche}', su.branche), '{fakten_block}', CASE WHEN len(su.fakten) > 0 THEN 'Das Wichtigste in Kürze: ' || array_to_string(su.fakten, '; ') || '.' ELSE '' END), '{tone_hint}', tn.hint), '{length_hint}', ax.hint), '[\\s\\p{Z}]+', ' ', 'g'))"
GRID_SQL = f"{_config_sql()}, grid AS (SELECT concat_ws('__', su.id, ct.id, tn.id, ax.id) AS id, su.id AS subject_id, su.branche, ct.id AS copy_type, tn.id AS tone, ax.id AS length, {PROMPT_SQL} AS prompt FROM su, ct, tn, ax WHERE coalesce(su.profiling, true) AND ax.uses = contains(ct.template, '{{length_hint}}'))"


@query(GRID_SQL + " SELECT * FROM grid")
def prompt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.grid(*configuration(spark))


HELD_SQL = f"SELECT concat_ws('__', su.id, ct.id, tn.id, ax.id) AS id, su.id AS subject_id, su.branche, ct.id AS copy_type, tn.id AS tone, ax.id AS length, {PROMPT_SQL} AS prompt FROM sel JOIN ct ON ct.id = sel.c JOIN tn ON tn.id = sel.t JOIN ax ON ax.id = CASE WHEN contains(ct.template, '{{length_hint}}') THEN sel.l ELSE 'na' END, su WHERE su.id = {O.quoted(SUBJECTS[0][0])}"


def flagship(spark: SparkSession) -> DataFrame:
    return prompts.looked_up(configuration(spark)[0], SUBJECTS[0][0])


@query(f"{_config_sql()}, sel AS (SELECT * FROM ({O.values(SELECTION)}) v(c, t, l)) {HELD_SQL}")
def holdout_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, types, tones, lengths = configuration(spark)
    return prompts.selected(rows(spark, "copy_type string, tone string, length string", SELECTION), flagship(spark), types, tones, lengths)


@query(f"{_config_sql()}, sel AS (SELECT ct.id AS c, j.t, ['kurz', 'ausfuehrlich'][(ct.ord + j.k) % 2 + 1] AS l FROM ct, (VALUES ('sachlich', 0), ('modern', 1), ('emotional', 2)) j(t, k)) {HELD_SQL}")
def holdout_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, types, tones, lengths = configuration(spark)
    return prompts.selected(prompts.broad_selection(types, ["sachlich", "modern", "emotional"], ["kurz", "ausfuehrlich"]), flagship(spark), types, tones, lengths)


@query(
    GRID_SQL
    + f""", h AS (SELECT *, md5('42|' || id) AS chance, subject_id = {O.quoted(SUBJECTS[1][0])} AS marked FROM grid), f AS (SELECT *, marked AND row_number() OVER (PARTITION BY marked ORDER BY chance, id) = 1 AS lead FROM h),
r AS (SELECT *, CASE WHEN lead THEN 0 WHEN row_number() OVER (PARTITION BY copy_type, lead ORDER BY chance, id) = 1 THEN 1 ELSE 2 END AS step FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY step, CASE WHEN step = 1 THEN copy_type END, chance, id) AS k FROM r) SELECT id, subject_id, branche, copy_type, tone, length, prompt FROM o WHERE k <= 30"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the flagship subject, one more of every type, then others."""
    return prompts.stratified(prompts.grid(*configuration(spark)), 30, "copy_type", first=F.col("subject_id") == SUBJECTS[1][0])


@query(GRID_SQL + " SELECT copy_type, array_to_string(list_sort(list(id)), ',') AS ids FROM grid GROUP BY copy_type")
def prompts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.by_type(prompts.grid(*configuration(spark))).select("copy_type", F.array_join("ids", ",").alias("ids"))


SERVED_SQL = "regexp_replace(replace(replace(replace(replace(replace(ct.template, '{name}', su.name), '{branche}', su.branche), '{fakten_block}', CASE WHEN len(su.fakten) > 0 THEN 'Fakten (faktentreu bleiben, nichts erfinden): ' || array_to_string(su.fakten, '; ') || '.' ELSE '' END), '{tone_hint}', tn.hint), '{length_hint}', ax.hint), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"


@query(f"{_config_sql()} SELECT concat_ws('__', su.id, ct.id, tn.id, ax.id) AS id, {SERVED_SQL} AS prompt FROM su, ct, tn, ax WHERE ax.uses = contains(ct.template, '{{length_hint}}')")
def served_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject's prompts as a served model is asked."""
    subjects, types, tones, lengths = configuration(spark)
    what = types.select(F.col("id").alias("copy_type"), "template", F.contains("template", F.lit(prompts.LENGTH)).alias("uses_length")).join(prompts.axes(lengths), "uses_length")
    each = subjects.select(F.col("id").alias("subject_id"), "name", "branche", "fakten").crossJoin(F.broadcast(what)).crossJoin(F.broadcast(tones.select(F.col("id").alias("tone"), F.col("hint").alias("tone_hint"))))
    return prompts.served(each.withColumn("id", F.concat_ws("__", "subject_id", "copy_type", "tone", "length")))


def _number_sql(text: str) -> str:
    return f"TRY_CAST(list_last(regexp_extract_all(replace(string_split({text}, '####')[-1], ',', ''), '-?\\d+(?:\\.\\d+)?')) AS DOUBLE)"


@query(
    f"WITH a AS (SELECT * FROM ({O.values(ANSWERS)}) v(task, arm, output, gold)), k AS (SELECT task, arm, CASE WHEN task = 'choice' THEN coalesce(nullif(regexp_extract(upper(output), '[ABCD]'), '') = gold, false) ELSE coalesce(abs({_number_sql('output')} - {_number_sql('gold')}) < 1e-3, false) END AS ok FROM a), p AS (SELECT task, 100 * avg(CAST(ok AS INTEGER)) FILTER (arm = 'base') AS base_pct, 100 * avg(CAST(ok AS INTEGER)) FILTER (arm = 'tuned') AS other_pct FROM k GROUP BY task) SELECT task, base_pct, other_pct, other_pct - base_pct AS delta FROM p"
)
def capability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.accuracy(rows(spark, "task string, arm string, output string, gold string", ANSWERS), "base", "tuned")


@query(
    f"WITH v AS (SELECT * FROM ({O.values(VERDICTS)}) v(id, best, worst)), b AS (SELECT * FROM ({O.values(BLIND)}) v(id, label, arm)), a AS (SELECT * FROM ({O.values((x,) for x in ARMS)}) v(arm)), w AS (SELECT arm, count(*) AS n FROM v JOIN b ON v.id = b.id AND v.best = b.label GROUP BY arm), l AS (SELECT arm, count(*) AS n FROM v JOIN b ON v.id = b.id AND v.worst = b.label GROUP BY arm) SELECT a.arm, coalesce(w.n, 0) AS wins, coalesce(l.n, 0) AS losses FROM a LEFT JOIN w ON a.arm = w.arm LEFT JOIN l ON a.arm = l.arm"
)
def verdict_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.tally(rows(spark, "id string, best string, worst string", VERDICTS), rows(spark, "id string, label string, arm string", BLIND), rows(spark, "arm string", [(a,) for a in ARMS]))


def _reference_sql(most: int) -> str:
    return f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) SELECT doc_id, lang AS register, CAST(length(substring(coalesce(text, ''), 1, 4000)) AS BIGINT) AS chars FROM d WHERE k <= {most}"


def first_documents(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The first documents of each register, by id, cut to 4000 characters: what a structural reference is measured on."""
    from pyspark.sql import Window as W

    ranked = documents(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("register").orderBy("doc_id")))
    return ranked.where(F.col("k") <= most).select("doc_id", "register", F.char_length(F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.lit(4000))).cast("long").alias("chars"))


@query(_reference_sql(25))
def reference_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_documents(spark, sf_dir, 25)


@query(_reference_sql(C.REFERENCE_DOCS))
def reference_documents_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the reference's number of documents."""
    return first_documents(spark, sf_dir, C.REFERENCE_DOCS)


@query(
    f"WITH {DOC_BASE_SQL} SELECT n, count(*) AS n_unique, CAST(sum(frequency) AS BIGINT) AS occurrences FROM base GROUP BY n"
)
def unique_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.unique(tokenised(documents(spark, sf_dir)))


from . import evaluation, files  # noqa: E402, F401  # they add their queries
