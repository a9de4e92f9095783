"""Readers with stated schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PROFILE = "`human-authored` struct<model_name:string,total_chars:bigint,top_bigrams:array<struct<ngram:string,frequency:bigint>>,top_trigrams:array<struct<ngram:string,frequency:bigint>>>"
SUBJECTS = "subjects array<struct<id:string,name:string,branche:string,zielgruppe:string,fakten:array<string>,profiling:boolean,flaggschiff:boolean>>"
COPY_TYPES = "tones array<struct<id:string,hint:string>>, lengths array<struct<id:string,hint:string>>, copy_types array<struct<id:string,label:string,template:string>>"

#: Quotes inside a field are doubled, white space counts.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def corpus(spark: SparkSession, path: str, registers: list[str] | None = None) -> DataFrame:
    """Documents partitioned by register and source; choosing registers prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("register").isin(*registers)) if registers else df


def weighted_sentences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sentence string, count bigint").options(**CSV).option("mode", "FAILFAST").csv(path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """word (lower-cased), count; without the file, empty.  Of words that come twice, the larger count stays."""
    schema = "word string, count bigint"
    if not there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**CSV).csv(path).groupBy(F.lower("word").alias("word")).agg(F.max("count").alias("count"))


def profile(spark: SparkSession, path: str) -> DataFrame:
    """A nested profile as rows n, ngram, frequency."""
    nested = spark.read.option("multiLine", True).schema(PROFILE).json(path).select("human-authored.*")
    return nested.select(F.lit(2).alias("n"), F.inline("top_bigrams")).unionByName(nested.select(F.lit(3).alias("n"), F.inline("top_trigrams")))


def subjects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(SUBJECTS).json(path).select(F.inline("subjects"))


def copy_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tones, lengths, copy_types (with ord, their place)."""
    df = spark.read.option("multiLine", True).schema(COPY_TYPES).json(path)
    types = df.select(F.posexplode("copy_types").alias("ord", "c")).select("c.*", "ord")
    return df.select(F.inline("tones")), df.select(F.inline("lengths")), types


def samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def texts(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """JSON lines with bad ones dropped; text is the first of field, output and text that isn't empty, or empty."""
    names = list(dict.fromkeys([field, "output", "text"]))
    df = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("mode", "DROPMALFORMED").json(path)
    return df.select(F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit("")).alias("text"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Plain text parted at blank lines; blank blocks go."""
    return spark.read.text(path, lineSep="\n\n").select(F.col("value").alias("text")).where(~T.blank(F.col("text")))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("prompt string").json(path).where(F.col("prompt").isNotNull())


def ban_list(spark: SparkSession, path: str) -> DataFrame:
    """phrase, from a JSON list of strings, [phrase, count] pairs and objects, or from an object's keys; repeats stay."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("j"))
    keys = whole.where(F.startswith("j", F.lit("{"))).select(F.explode(F.json_object_keys("j")).alias("phrase"))
    items = whole.where(F.startswith("j", F.lit("["))).select(F.explode(F.from_json("j", "array<string>")).alias("x"))
    pair, fields = F.from_json("x", "array<string>"), F.from_json("x", "map<string,string>")
    named = F.coalesce(F.nullif(F.try_element_at(fields, F.lit("phrase")), F.lit("")), F.nullif(F.try_element_at(fields, F.lit("ngram")), F.lit("")), F.get(F.map_values(fields), F.lit(0)))
    phrase = F.when(F.startswith("x", F.lit("[")), F.get(pair, F.lit(0))).when(F.startswith("x", F.lit("{")), named).otherwise(F.col("x"))
    return keys.unionByName(items.select(phrase.alias("phrase"))).where(F.col("phrase").isNotNull() & (F.col("phrase") != ""))


def grouped_bans(spark: SparkSession, path: str) -> DataFrame:
    """group, phrase of a JSON object whose lists are groups of phrases; its other entries are remarks."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.trim("value"), "map<string,string>")).alias("group", "list"))
    lists = whole.where(F.startswith("list", F.lit("[")) & F.json_array_length("list").isNotNull())
    return lists.select("group", F.explode(F.from_json("list", "array<string>")).alias("phrase")).where("phrase <> ''")


def answers(spark: SparkSession, path: str, task: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of a benchmark table, the same for a seed."""
    df = spark.read.parquet(path).withColumn("task", F.lit(task))
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.to_json(F.struct(*df.columns))))).limit(n)
