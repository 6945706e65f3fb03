"""Human corrections: an append-only log, its latest state, and the refresh of touched batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillfold import schemas
from quillfold.functions import text as T


def corrections_of(reviews: DataFrame) -> DataFrame:
    """Log rows of reviews (filename, system_guess, final, confidence, method_used, batch_id, harvested_at).

    A review that confirms the guess is no correction.
    """
    changed = reviews.where("NOT (trim(coalesce(system_guess, '')) <=> trim(final))")
    return changed.select(
        "filename",
        "system_guess",
        F.trim("final").alias("human_correction_ground_truth"),
        T.similarity(F.coalesce("system_guess", F.lit("")), F.trim("final")).alias("similarity_score"),
        "confidence",
        "method_used",
        "batch_id",
        "harvested_at",
    )


def latest_corrections(log: DataFrame) -> DataFrame:
    """(batch, filename, truth, similarity): the last correction of each file of a batch."""
    last = log.groupBy("batch_id", "filename").agg(F.max_by(F.struct("human_correction_ground_truth", "similarity_score"), "harvested_at").alias("c"))
    return last.select(F.col("batch_id").alias("batch"), "filename", F.col("c.human_correction_ground_truth").alias("truth"), F.col("c.similarity_score").alias("similarity"))


def refresh(spark: SparkSession, folder: str, checkpoint: str, recompute: Callable[[DataFrame], None]) -> StreamingQuery:
    """Follows the log; each micro-batch of new corrections recomputes the batches it names, once.

    recompute(batches) gets a table (batch); running it again with the same batches must be safe.
    """
    stream = spark.readStream.schema(schemas.CORRECTION).json(folder)

    def touched(rows: DataFrame, _: int) -> None:
        recompute(rows.select(F.col("batch_id").alias("batch")).distinct())

    return stream.writeStream.foreachBatch(touched).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
