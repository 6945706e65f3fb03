"""Verification of corrected identifiers against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.config import ValidationConfig
from quillfold.functions import text as T
from quillfold.functions.validate import Validator

NOT_READ = ("", "failed", "None")


def category(expected: Column, actual: Column, validation: ValidationConfig = ValidationConfig(), not_read: tuple[str, ...] = NOT_READ) -> Column:
    """match, extraction_failure, single_char_typo, base_mismatch or suffix_mismatch."""
    v = Validator(validation)
    want, got = T.comparable(expected), T.comparable(actual)
    base = lambda raw, form: F.coalesce(v.base(raw), F.split_part(form, F.lit("-"), F.lit(1)))
    pair = F.array(F.struct(base(expected, want).alias("e"), base(actual, got).alias("a")))
    by_base = F.transform(pair, lambda p: F.when(T.hamming(p["e"], p["a"]) == 1, "single_char_typo").when(p["e"] != p["a"], "base_mismatch").otherwise("suffix_mismatch"))[0]
    return F.when(actual.isNull() | actual.isin(*not_read), "extraction_failure").when(want == got, "match").otherwise(by_base)


def verify(files: DataFrame, truth: DataFrame, validation: ValidationConfig = ValidationConfig()) -> DataFrame:
    """files (batch, filename, status, job, reason, confidence) -> the same with scan_id, expected, outcome.

    truth: (scan_id, job_number), ids in any case, the last of repeated ones already chosen.
    outcome: extraction_failure, unverified (no ground truth), match or an error category.
    """
    gt = truth.select(F.lower("scan_id").alias("_gid"), F.col("job_number").alias("expected"))
    df = files.withColumn("scan_id", T.scan_id(F.col("filename")))
    df = df.join(gt, df["scan_id"] == gt["_gid"], "left").drop("_gid")
    lost = (F.coalesce("status", F.lit("")) != "Success") | F.coalesce(F.col("job") == "failed", F.lit(False))
    outcome = F.when(lost, "extraction_failure").when(F.col("expected").isNull(), "unverified").otherwise(category(F.col("expected"), F.col("job"), validation))
    return df.withColumn("outcome", outcome)


def summary(verified: DataFrame, *by: str) -> DataFrame:
    """Counters of a verification: rows, verified, passed, errors, accuracy, confidences."""
    checked = ~F.col("outcome").isin("extraction_failure", "unverified")
    out = verified.groupBy(*by).agg(
        F.count("*").alias("total_in_batch"),
        F.count_if(checked).alias("total_verified"),
        F.count_if(F.col("outcome") == "match").alias("passed"),
        F.count_if(checked & (F.col("outcome") != "match")).alias("verification_errors"),
        F.count_if(F.col("outcome") == "extraction_failure").alias("extraction_failures"),
        F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.count_if(F.col("confidence") < 0.70).alias("low_confidence"),
    )
    out = out.withColumn("total_errors", F.col("verification_errors") + F.col("extraction_failures"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("passed").cast("double"), "total_verified"), F.lit(0.0)))


#: Tier of a file without metadata, and of one whose metadata have no reason: fixed values.
UNKNOWN_TIER, NO_REASON = "unknown (check smart_filing logs)", "kept: valid"


def verify_report(truth: DataFrame, rows: DataFrame, enhanced: DataFrame | None = None, validation: ValidationConfig = ValidationConfig()) -> DataFrame:
    """Ground truth found in a text report, with confidence and tier from the run's metadata.

    truth: (scan_id, job_number); rows: (report, scan_id, job), as report_table gives them;
    enhanced: (report, scan_id, confidence, reason), as enhanced_files does, or none. Scans
    that a report lacks are left out of it; scans without metadata get 0.0 and UNKNOWN_TIER.
    """
    out = truth.select("scan_id", F.col("job_number").alias("expected")).join(rows.select("report", "scan_id", F.col("job").alias("actual")), "scan_id")
    if enhanced is None:
        out = out.withColumn("confidence", F.lit(0.0)).withColumn("tier", F.lit(UNKNOWN_TIER))
    else:
        meta = enhanced.select("report", "scan_id", F.coalesce("confidence", F.lit(0.0)).alias("_confidence"), F.coalesce("reason", F.lit(NO_REASON)).alias("_tier"))
        out = out.join(meta, ["report", "scan_id"], "left")
        out = out.withColumn("confidence", F.coalesce("_confidence", F.lit(0.0))).withColumn("tier", F.coalesce("_tier", F.lit(UNKNOWN_TIER))).drop("_confidence", "_tier")
    passed = T.comparable(F.col("expected")) == T.comparable(F.col("actual"))
    out = out.withColumn("passed", F.coalesce(passed, F.lit(False)))
    return out.withColumn("error_type", F.when(~F.col("passed"), category(F.col("expected"), F.col("actual"), validation)))


def report_summary(results: DataFrame, totals: DataFrame, failures: DataFrame) -> DataFrame:
    """Counters of each report: verified, passed, errors, and accuracy by the whole batch where its size is known.

    results: verify_report's; totals: (report, total); failures: (report, failures).
    """
    conf = F.col("confidence")
    out = results.groupBy("report").agg(
        F.count("*").alias("total_verified"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("verification_errors"),
        F.avg(conf).alias("mean_confidence"),
        F.min(conf).alias("min_confidence"),
        F.max(conf).alias("max_confidence"),
        F.count_if(conf < 0.70).alias("low_confidence"),
    )
    out = out.join(totals.select("report", F.col("total").alias("total_in_batch")), "report", "left").join(failures.select("report", F.col("failures").alias("extraction_failures")), "report", "left")
    out = out.withColumn("extraction_failures", F.coalesce("extraction_failures", F.lit(0)))
    out = out.withColumn("total_errors", F.col("verification_errors") + F.col("extraction_failures"))
    by_checks = F.coalesce(F.try_divide(F.col("passed").cast("double"), "total_verified"), F.lit(0.0))
    return out.withColumn("accuracy", F.when(F.col("total_in_batch") > 0, (F.col("total_in_batch") - F.col("total_errors")) / F.col("total_in_batch").cast("double")).otherwise(by_checks))


def histogram(verified: DataFrame, column: str, *by: str) -> DataFrame:
    return verified.groupBy(*by, column).agg(F.count("*").alias("n"))


def failed_lists(verified: DataFrame, *by: str) -> DataFrame:
    """The names of files that failed, and of those not read, for each group."""
    wrong = ~F.col("outcome").isin("match", "unverified", "extraction_failure")
    return verified.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(wrong, F.col("scan_id")))).alias("failed_files"),
        F.sort_array(F.collect_list(F.when(F.col("outcome") == "extraction_failure", F.col("scan_id")))).alias("not_read_files"),
    )
