"""Scores of answers and tallies of blind verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import paired


def marked(answers: DataFrame) -> DataFrame:
    """answers(task, arm, output, gold) with ok: numbers within a thousandth, or the first letter of A to D."""
    said, meant = T.last_number(T.answer_tail(F.col("output"))), T.last_number(T.answer_tail(F.col("gold")))
    number = F.coalesce(F.abs(said - meant) < 1e-3, F.lit(False))
    letter = F.coalesce(T.first_choice(F.col("output")) == F.col("gold"), F.lit(False))
    return answers.withColumn("ok", F.when(F.col("task") == "choice", letter).otherwise(number))


def accuracy(answers: DataFrame, base: str, other: str) -> DataFrame:
    """task, base and other arm's percentage, and the difference."""
    share = marked(answers).groupBy("task").pivot("arm", [base, other]).agg(100 * F.avg(F.col("ok").cast("int")))
    return share.select("task", F.col(base).alias("base_pct"), F.col(other).alias("other_pct"), (F.col(other) - F.col(base)).alias("delta"))


def with_arm(rows: DataFrame, arm: DataFrame, name: str, key: str = "id") -> DataFrame:
    """rows with a further arm's text, looked up by key in another file's rows(key, name); a key it lacks is an error."""
    return paired(rows, {name: arm.select(key, F.col(name).alias("text"))}, key)


def tally(verdicts: DataFrame, blind: DataFrame, arms: DataFrame) -> DataFrame:
    """arm, wins, losses over verdicts(id, best, worst) and blind(id, label, arm); arms without either stay with 0."""
    each = verdicts.unpivot(["id"], ["best", "worst"], "verdict", "label")
    named = each.join(blind, ["id", "label"])
    sums = named.groupBy("arm").agg(F.count_if(F.col("verdict") == "best").alias("wins"), F.count_if(F.col("verdict") == "worst").alias("losses"))
    return arms.join(sums, "arm", "left").select("arm", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("wins", "losses")))


def blinded(ids: DataFrame, arms: list[str], seed: int = 42) -> DataFrame:
    """id, label, arm: for each id a shuffle of the arms; written down, it is the key to the verdicts."""
    shuffled = F.array_sort(F.array(*(F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id"), F.lit(a))).alias("h"), F.lit(a).alias("arm")) for a in arms)))
    labels = F.array(*(F.lit(chr(65 + k)) for k in range(len(arms))))
    return ids.select("id", F.posexplode(shuffled).alias("k", "x")).select("id", F.get(labels, F.col("k")).alias("label"), "x.arm")
