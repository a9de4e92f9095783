"""Queries that write a file and read it back: every reader and every sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import discriminate
from ..operators import ngrams as N
from ..operators.prompts import suffix
from ..sources import readers as R
from ..sources import writers as S
from ..sources.scratch import lines, scratch
from . import oracle as O
from .catalogue import MIN_COUNT, SPREAD_SQL, STOP, documents, query, read, sentences, talk_profile, tokenised
from .inline import COPY_TYPES, LENGTHS, SUBJECTS, TONES, rows


@query("SELECT doc_id, source FROM documents WHERE lang = 'de'")
def corpus_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus written by register and source; choosing a register prunes the others' files."""
    path = scratch(spark, "corpus")
    documents(spark, sf_dir).write.partitionBy("register", "source").parquet(path)
    return R.corpus(spark, path, ["de"]).select("doc_id", "source")


@query("SELECT sentence, count(*) AS count FROM (SELECT unnest(string_split(text, chr(10))) AS sentence FROM documents) WHERE regexp_matches(sentence, '[^\\s\\p{Z}]') GROUP BY sentence")
def sentence_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sentences")
    sentences(spark, sf_dir).write.options(**R.CSV).csv(path)
    return R.weighted_sentences(spark, path)


WORD_COUNTS = [("Das", 3), ("das", 5), ("baum", 1), ("Über", 7)]


@query("SELECT lower(word) AS word, CAST(max(count) AS BIGINT) AS count FROM (" + O.values(WORD_COUNTS) + ") v(word, count) GROUP BY lower(word)")
def word_count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of words, and one that is missing."""
    found = R.word_counts(spark, lines(spark, "words", "word,count\n" + "\n".join(f"{w},{n}" for w, n in WORD_COUNTS)))
    return found.unionByName(R.word_counts(spark, scratch(spark, "no-words")))


@query("SELECT conv_id, turn, role, text FROM conversations")
def sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, strictly read."""
    path = scratch(spark, "samples")
    S.json_lines(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return R.samples(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT * FROM (VALUES (''), ('o'), ('t'), ('u')) v(text)")
def text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with a bad one, whose text lies under several names."""
    return R.texts(spark, lines(spark, "texts", '{"text":"","output":"o"}\n{bad\n{"text":"t"}\n{"x":1}\n{"output":"u"}'))


@query("SELECT * FROM (VALUES ('eins' || chr(10) || 'zwei'), ('drei')) v(text)")
def block_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.blocks(spark, lines(spark, "blocks", "eins\nzwei\n\n  \n\ndrei"))
    return found.select(F.regexp_replace("text", "\n$", "").alias("text"))


@query("SELECT * FROM (VALUES ('a'), ('b')) v(prompt)")
def prompt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prompts(spark, lines(spark, "prompts", '{"prompt":"a"}\n\n{"prompt":"b"}\n{"other":1}'))


BANS = ["a b", ["c", 3], {"phrase": "d"}, {"ngram": "e"}, {"z": "f"}, "", "a b"]
GROUPS = {"_comment": "hand-made [list]", "extra": ["im laufe der zeit", "nahtlos"], "tics": ["basta"], "none": []}


@query("SELECT * FROM (VALUES ('a b'), ('a b'), ('c'), ('d'), ('e'), ('f'), ('x y'), ('z')) v(phrase)")
def ban_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases from a mixed list and from an object's keys."""
    return R.ban_list(spark, lines(spark, "bans", json.dumps(BANS))).unionByName(R.ban_list(spark, lines(spark, "keys", '{"x y": 1, "z": 2}')))


@query("SELECT * FROM (" + O.values((g, p) for g, x in GROUPS.items() if isinstance(x, list) for p in x) + ') v("group", phrase)')
def ban_group_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grouped_bans(spark, lines(spark, "groups", json.dumps(GROUPS, indent=1)))


PROFILE_SQL = (
    "WITH "
    + O.content("talk", "conv_id", "(SELECT * FROM conversations WHERE role = 'assistant')")
    + ", "
    + O.grams("tg", "conv_id", "talk")
    + ", c AS (SELECT n, ngram, count(*) AS frequency FROM tg GROUP BY n, ngram), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY frequency DESC, ngram) AS k FROM c)"
)


@query(PROFILE_SQL + " SELECT n, ngram, frequency FROM r WHERE k <= 300")
def profile_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested export of a profile, read back as rows."""
    path = scratch(spark, "profile")
    S.profile_json(K.nested_profile(N.top(talk_profile(spark, sf_dir), 300, ["n"]), "human", 1), path)
    return R.profile(spark, path)


@query("SELECT lang AS register, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's map of characters by register, read back."""
    own = documents(spark, sf_dir).groupBy("register").agg(F.sum(F.char_length("text")).cast("long").alias("chars"), F.count("*").alias("tokens"), F.lit(1.0).alias("char_pct"))
    path = scratch(spark, "report")
    S.report_json(own, path)
    return spark.read.schema("register_chars map<string,bigint>").json(path).select(F.explode("register_chars").alias("register", "chars"))


CANDIDATE_KINDS = "keep string, ngram string, count long, branchen long, baseline long"


@query(SPREAD_SQL + " SELECT keep, ngram, count, spread AS branchen, baseline FROM f")
def candidate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table for review, read back under its own header."""
    samples = tokenised(documents(spark, sf_dir)).select(F.col("source").alias("subject_id"), "tokens")
    path = scratch(spark, "candidates")
    S.candidate_tsv(discriminate.candidates(samples, talk_profile(spark, sf_dir), STOP, min_count=MIN_COUNT), path)
    return spark.read.schema(CANDIDATE_KINDS).option("header", True).option("enforceSchema", False).option("sep", "\t").csv(path)


SEEDS, EMERGENT = [("nahtlos", 4), ("im laufe der zeit", 2)], [("und die", 9, 0), ("der zeit", 3, 1200)]


@query(
    f"SELECT '?' AS keep, ngram, CAST(count AS BIGINT) AS gemma_count, '-' AS baseline_freq, 'seed' AS quelle FROM ({O.values(SEEDS)}) v(ngram, count) UNION ALL SELECT '?', ngram, count, CAST(baseline AS VARCHAR), 'emergent' FROM ({O.values(EMERGENT)}) v(ngram, count, baseline)"
)
def review_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "review")
    S.review_tsv(rows(spark, "phrase string, hits long", SEEDS), rows(spark, "ngram string, count long, baseline long", EMERGENT), path)
    kinds = "keep string, ngram string, gemma_count long, baseline_freq string, quelle string"
    return spark.read.schema(kinds).option("header", True).option("enforceSchema", False).option("sep", "\t").csv(path)


@query("SELECT CAST(conv_id AS VARCHAR) AS id, text AS prompt FROM conversations WHERE role = 'user' AND turn = 0")
def pair_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs under a path that names their parameters."""
    path, named = scratch(spark, "pairs"), suffix(0.7, 1.2)
    S.pairs(read(spark, sf_dir, "conversations").where("role = 'user' AND turn = 0").select(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("prompt")), path, named)
    return R.samples(spark, f"{path}_t0.7_rp1.2", "id string, prompt string")


@query(f"SELECT su.id, len(su.fakten) AS facts, coalesce(su.profiling, true) AS profiled FROM ({' UNION ALL '.join(f'SELECT {O.quoted(i)} AS id, CAST({O.listed(f)} AS VARCHAR[]) AS fakten, CAST({chr(39) + str(p).lower() + chr(39) if p is not None else chr(78) + chr(85) + chr(76) + chr(76)} AS BOOLEAN) AS profiling' for i, _, _, f, p in SUBJECTS)}) su".replace("len(su.fakten)", "CAST(len(su.fakten) AS INTEGER)"))
def subject_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with fields that may be missing."""
    found = [{"id": i, "name": n, "branche": b, "fakten": f} | ({} if p is None else {"profiling": p}) for i, n, b, f, p in SUBJECTS]
    own = R.subjects(spark, lines(spark, "subjects", json.dumps({"subjects": found}, indent=1)))
    return own.select("id", F.size("fakten").alias("facts"), F.coalesce("profiling", F.lit(True)).alias("profiled"))


@query(
    f"SELECT 'tone' AS kind, id, hint AS said FROM ({O.values(TONES)}) v(id, hint) UNION ALL SELECT 'length', id, hint FROM ({O.values(LENGTHS)}) v(id, hint) UNION ALL SELECT 'type' || ord, id, template FROM ({O.values((*x, k) for k, x in enumerate(COPY_TYPES))}) v(id, label, template, ord)"
)
def copy_config_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = {"tones": [{"id": i, "hint": h} for i, h in TONES], "lengths": [{"id": i, "hint": h} for i, h in LENGTHS], "copy_types": [{"id": i, "label": x, "template": t} for i, x, t in COPY_TYPES]}
    tones, lengths, types = R.copy_config(spark, lines(spark, "config", json.dumps(whole, indent=1)))
    typed = types.select(F.concat(F.lit("type"), F.col("ord").cast("string")).alias("kind"), "id", F.col("template").alias("said"))
    return tones.select(F.lit("tone").alias("kind"), "id", F.col("hint").alias("said")).unionByName(lengths.select(F.lit("length").alias("kind"), "id", F.col("hint").alias("said"))).unionByName(typed)


@query("SELECT count(*) AS n, count(DISTINCT item_id) AS items FROM (SELECT item_id FROM benchmark LIMIT 10)")
def answer_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a benchmark's rows, the same whenever it is drawn."""
    first, again = (R.answers(spark, f"{sf_dir}/benchmark.parquet", "number", 10) for _ in range(2))
    both = first.select("item_id").join(again.select("item_id"), "item_id")
    return both.agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))
