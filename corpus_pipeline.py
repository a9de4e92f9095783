"""The corpus pipeline: from documents to packed training sequences.

Every stage takes any rows: null ids and texts, repeated rows, empty and very long texts, empty tables, and further columns,
which all stages but the last carry along.  A stage's docstring says what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.llm.common import saved, table
from stylomill.llm.decontam import keep_clean
from stylomill.llm.near_dup import keep_first
from stylomill.llm.packing import pack
from stylomill.llm.quality import keep_good
from stylomill.llm.secrets import redact


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (score under 0.3).

    Null texts are scored as empty ones; each row is judged by its text alone, so rows that repeat a text stay or go together,
    whatever their ids.  Without any label all rows stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document of the least id stays.

    One row of each group stays: rows that share this id count as one group, of which the text of the least hash stays; rows
    without an id yield to those with one.  Null texts and texts without a word are like nothing and all stay."""
    return keep_first(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other names and numbers, go.

    Null texts hold nothing and stay; rows that repeat stay or go together.  With an empty benchmark all rows stay."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are replaced by a mark; every row stays, and n_chars, if there is one, counts the new text.

    Null texts stay null; rows that repeat are changed alike.  Without a source each row is owned by the same unknown owner."""
    own = docs if "source" in docs.columns else docs.withColumn("source", F.lit(None).cast("string"))
    found = redact(own).select(*(F.col(f"`{c}`") for c in docs.columns))
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048: one row for each piece, without the documents' further columns.

    A null or empty text is its end id alone; rows that repeat an id are packed each by itself."""
    return pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", first_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The stages learn, hash and tokenise, which SQL cannot express; tests/llm hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
