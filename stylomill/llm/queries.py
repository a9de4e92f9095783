"""The training-data queries by name; ORACLE holds DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat import chat_digest, format_examples
from .common import table
from .decontam import contaminated
from .langid import identify
from .near_dup import near_duplicates
from .packing import pack
from .quality import assess
from .repeats import repeat_digest
from .secrets import secret_digest
from .token_file import token_digest
from .topk import exact_top_k


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds what looks like the template's own marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok").alias("text")
    more = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), hard) for k, role in enumerate(("user", "assistant"))]
    return chat_digest(format_examples(turns.unionByName(spark.range(1).select(F.inline(F.array(*more))))))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"), length=200)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_output": op2_token_output,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_exact_topk": op4_exact_topk,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.OP1,
    "op3_chat_formatting": oracles.OP3,
    "op4_exact_topk": oracles.OP4,
    "op7_suffix_array_dedup": oracles.OP7,
    "op10_secret_scan": oracles.OP10,
}
