"""N-gram counts over a landing folder, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ngrams as N


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def ngram_counts(stream: DataFrame, by: list[str]) -> DataFrame:
    """Running counts by group; to be written in update or complete mode.  Only the aggregate keeps state."""
    return N.counted(N.exploded(stream.withColumn("tokens", T.content_tokens(F.col("text"))), by), by)


def into_parts(stream: DataFrame, by: list[str], path: str, checkpoint: str):
    """Every batch's own counts become a part of their own: no state is kept, and a retried batch replaces its part."""

    def write(batch: DataFrame, number: int) -> None:
        ngram_counts(batch, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def parts_summed(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*by, "n", "ngram").agg(F.sum("frequency").cast("long").alias("frequency"))
