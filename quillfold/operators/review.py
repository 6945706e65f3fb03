"""What a person reviews: held files with the system's guesses and latest crops, and the rows of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions import text as T
from quillfold.operators.routing import REVIEW, SUCCESS


def pending_queue(holding: DataFrame, guesses: DataFrame) -> DataFrame:
    """Held files with their guess, or the defaults of a file that no report names.

    holding: (filename); guesses: (filename, corrected_job, raw_job, confidence, method,
    batch_id), one row a file (see io.last_report_wins).
    """
    g = guesses.select("filename", "corrected_job", "raw_job", "confidence", "method", "batch_id")
    df = holding.select("filename").join(g, "filename", "left")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.select(
        "filename",
        T.display_id(F.col("filename")).alias("scan_id"),
        F.trim(F.coalesce(blank("corrected_job"), blank("raw_job"), F.lit(""))).alias("system_guess"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("method", F.lit("unknown")).alias("method_used"),
        F.coalesce("batch_id", F.lit("Unknown")).alias("batch_id"),
    )


def latest_crops(files: DataFrame, crops: DataFrame) -> DataFrame:
    """files (filename) with the last, by name, of their crops `<stem>_micro_*.jpg`; else null.

    crops: (path). The stem is taken from a crop's own name, so that the join is on equality.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_extract(name, r"^(.*)_micro_.*\.jpg$", 1)
    last = crops.select(stem.alias("_stem"), name.alias("_name"), "path").where("_stem <> ''").groupBy("_stem").agg(F.max_by("path", "_name").alias("crop"))
    own = F.regexp_replace("filename", r"\.[^.]*$", "")
    return files.withColumn("_stem", own).join(last, "_stem", "left").drop("_stem")


def _stem(width: int) -> Column:
    return F.substring(F.regexp_replace(F.coalesce("original_filename", "filename"), r"\.[^.]*$", ""), 1, width)


def report_rows(files: DataFrame, *by: str) -> DataFrame:
    """The lines of a run report for filed and held documents: (by..., section, place, line).

    files: filename, original_filename, status, job, proc_sec, error; in order of filename.
    """
    good = F.concat(F.rpad(_stem(23), 23, " "), F.lit(" | "), F.rpad(F.coalesce("job", F.lit("Unknown")), 20, " "), F.lit(" | "), F.rpad(T.duration(F.coalesce("proc_sec", F.lit(0.0))), 12, " "), F.lit(" | "))
    held = F.concat(F.rpad(_stem(21), 21, " "), F.lit(" | System Guess: "), F.rpad(F.coalesce("job", F.lit("No Guess")), 15, " "), F.lit(" | Reason: "), F.coalesce("error", F.lit("Unknown")))
    rows = files.where(F.col("status").isin(SUCCESS, REVIEW)).withColumn("section", F.when(F.col("status") == SUCCESS, "filed").otherwise("held"))
    rows = rows.withColumn("line", F.when(F.col("section") == "filed", good).otherwise(held))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by, "section").orderBy("filename")))
    return rows.select(*by, "section", "place", "line").orderBy(*by, "section", "place")
