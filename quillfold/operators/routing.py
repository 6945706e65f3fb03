"""Statuses after filing, and where each document goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.config import TrustConfig
from quillfold.functions import text as T
from quillfold.functions.validate import is_failed

SUCCESS, REVIEW, FAILED = "Success", "Manual Review Required", "Failed"


def filed_status(df: DataFrame) -> DataFrame:
    """Adds status, job, method and error to rows (raw_job, corrected_job, reason, has_red, method).

    A red mark sends the row to review with its own read; its correction is suggested_job.
    """
    red = F.coalesce(F.col("has_red"), F.lit(False))
    lost = is_failed(F.col("corrected_job"))
    changed = ~lost & ~F.coalesce(F.col("corrected_job") == F.col("raw_job"), F.lit(False))
    own = F.when(is_failed(F.col("raw_job")), F.lit(None)).otherwise(F.col("raw_job"))
    return df.withColumns(
        {
            "status": F.when(red, REVIEW).when(lost, FAILED).otherwise(SUCCESS),
            "job": F.when(red, own).when(lost, F.lit(None)).otherwise(F.col("corrected_job")),
            "method": F.when(~red & changed, F.concat("method", F.lit(" (+smart_filing: "), "reason", F.lit(")"))).otherwise(F.col("method")),
            "error": F.when(red, "correction_mark_detected").when(lost, F.coalesce(F.nullif("reason", F.lit("")), F.lit("extraction_failed"))),
            "suggested_job": F.when(red, F.col("corrected_job")),
        }
    )


def trusted(status: Column, confidence: Column, job: Column, config: TrustConfig = TrustConfig()) -> Column:
    ok = (status == SUCCESS) & (confidence >= config.threshold) & ~is_failed(job)
    return F.coalesce(ok, F.lit(False)) & F.lit(not config.force_manual)


def trusted_guess(confidence: Column, guess: Column, config: TrustConfig = TrustConfig()) -> Column:
    """The metrics' own notion: the status plays no part."""
    return F.coalesce((confidence >= config.threshold) & (guess != "") & (guess != "failed"), F.lit(False))


def destination(df: DataFrame, config: TrustConfig = TrustConfig()) -> DataFrame:
    """Adds dest_path to rows (status, confidence, job, filename, original_filename)."""
    filed = F.concat(F.lit("success/"), T.safe_folder(F.col("job")), F.lit("/"), F.col("original_filename"))
    return df.withColumn("dest_path", F.when(trusted(F.col("status"), F.col("confidence"), F.col("job"), config), filed).otherwise(F.concat(F.lit("holding_zone/"), "filename")))


def failed_destination(filename: Column, error: Column) -> Column:
    return F.concat(F.lit("failed/"), T.safe_folder(F.coalesce(error, F.lit("unknown_error"))), F.lit("/"), filename)
