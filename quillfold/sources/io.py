"""Sources and sinks: scans, ground truth, run reports, metrics and legacy text reports."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold import schemas
from quillfold.functions import text as T

SUFFIXES = ("pdf", "jpg", "jpeg", "png")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own that all executors share: under spark.checkpoint.dir, on one machine else a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillfold-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = "file://" + root
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder (not below), by suffix in any case: path, modified, bytes, content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    keep = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES)
    return df.where(keep).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: documents as they are dropped into a folder, each once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).load(path)
    keep = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES)
    return df.where(keep).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def batch_images(files: DataFrame, batch: str) -> DataFrame:
    """Converted pages of one batch, by its name prefix."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(F.startswith("name", F.concat(T.safe_folder(F.lit(batch)), F.lit("_"))) & F.endswith("name", F.lit("_ready.jpg")))


def attach_originals(images: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with their original file, images without one) by stem; originals: stem, original."""
    last = originals.groupBy("stem").agg(F.max("original").alias("original"))
    return images.join(last, "stem"), images.join(last, "stem", "left_anti")


def ground_truth(spark: SparkSession, path: str, default: dict[str, str] | None = None) -> DataFrame:
    """(scan_id, job_number, notes): trimmed, blanks dropped, the last of repeated ids; default if there is no file."""
    if default is not None and not _exists(spark, path):
        return spark.createDataFrame([(k.lower(), v, "") for k, v in default.items()], schemas.GROUND_TRUTH)
    lines = spark.read.schema(schemas.GROUND_TRUTH).option("header", True).csv(path)
    # order within a file: the row's place in it
    df = lines.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    key = F.lower(F.regexp_replace(F.trim("scan_id"), r"(?i)\.pdf", ""))
    df = df.select(key.alias("scan_id"), F.trim("job_number").alias("job_number"), F.coalesce(F.trim("notes"), F.lit("")).alias("notes"), "_at")
    df = df.where("coalesce(scan_id, '') <> '' AND coalesce(job_number, '') <> ''")
    return df.groupBy("scan_id").agg(F.max_by("job_number", "_at").alias("job_number"), F.max_by("notes", "_at").alias("notes"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports (one object a file) with their report name; unreadable files keep their text in _corrupt."""
    df = spark.read.schema(schemas.RUN_REPORT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return _named(df, "_run_data")


def metrics_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored metrics in either dialect, absent fields null; `latest` copies left out."""
    df = spark.read.schema(schemas.METRICS).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return _named(df, "_metrics").where("_corrupt IS NULL")


def _named(df: DataFrame, ending: str) -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_name", "/"), -1), r"\.json$", "")
    return df.withColumn("report", name).where(~F.contains("report", F.lit("latest"))).withColumn("batch", F.regexp_replace("report", ending + "$", ""))


def history(metrics: DataFrame) -> DataFrame:
    """One row a batch from metrics of both dialects, with the defaults of absent fields."""
    s = lambda n: F.col(f"summary.{n}")
    total = F.coalesce(s("total_in_batch"), F.lit(0))
    mean = F.coalesce("confidence_stats.mean", F.lit(0.0))
    auto = F.coalesce(s("theoretical_automation"), F.lit(0.0))
    return metrics.select(
        F.coalesce("batch_info.batch_id", "report").alias("batch"),
        F.to_timestamp("timestamp").alias("run_at"),
        T.run_label(F.to_timestamp("timestamp")).alias("run_label"),
        total.alias("total_in_batch"),
        F.coalesce(s("verified_files"), total).alias("verified_files"),
        F.coalesce(s("verified_trusted_count"), s("theoretical_auto_count"), F.lit(0)).alias("verified_trusted_count"),
        F.coalesce(s("human_corrections"), F.lit(0)).alias("human_corrections"),
        F.coalesce(s("theoretical_auto_count"), F.round(auto * total).cast("long")).alias("theoretical_auto_count"),
        F.coalesce(s("silent_failures"), F.lit(0)).alias("silent_failures"),
        (100 * auto).alias("theoretical_automation_pct"),
        (100 * F.coalesce(s("actual_accuracy"), s("accuracy"), F.lit(0.0))).alias("accuracy_pct"),
        (100 * F.coalesce(s("silent_failure_rate"), F.lit(0.0))).alias("silent_failure_pct"),
        F.coalesce(s("total_wall_time_sec"), F.lit(0.0)).alias("total_wall_time_sec"),
        F.coalesce(s("avg_speed_sec"), F.lit(0.0)).alias("avg_speed_sec"),
        F.coalesce("confidence_stats.sum", mean * total).alias("confidence_sum"),
        F.coalesce("confidence_stats.count", total).alias("confidence_count"),
        F.coalesce(s("avg_typo_similarity"), F.lit(1.0)).alias("avg_typo_similarity"),
        F.coalesce(s("initial_success"), F.lit(0)).alias("initial_success"),
        F.coalesce(s("initial_hitl"), F.lit(0)).alias("initial_hitl"),
        F.coalesce(s("initial_failed"), F.lit(0)).alias("initial_failed"),
        F.coalesce(s("parallel_speedup"), F.lit(1.0)).alias("parallel_speedup"),
    )


def last_report_wins(files: DataFrame, key: str = "filename", order: str = "report") -> DataFrame:
    """The row of the last report for each file."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Batches with a run report and no metrics."""
    return runs.select("batch").distinct().join(metrics.select("batch"), "batch", "left_anti")


def text_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line) of text reports; a report is read whole, its lines numbered in order."""
    df = spark.read.text(path, wholetext=True)
    lines = F.posexplode(F.split("value", r"\r?\n"))
    return df.select(F.col("_metadata.file_path").alias("file"), lines.alias("no", "line"))


def report_table(lines: DataFrame) -> DataFrame:
    """(file, scan_id, job) of the last table of each report; the last of repeated ids."""
    w = Window.partitionBy("file")
    head = F.contains("line", F.lit("FILENAME")) & F.contains("line", F.lit("JOB NUMBER"))
    df = lines.withColumn("_head", F.coalesce(F.max(F.when(head, F.col("no"))).over(w), F.lit(0))).where("no > _head")
    stop = F.contains("line", F.lit("===")) | F.contains("line", F.lit("FAILED FILES"))
    df = df.withColumn("_stop", F.min(F.when(stop, F.col("no"))).over(w)).where("_stop IS NULL OR no < _stop")
    df = df.where(F.contains("line", F.lit("|")) & ~F.contains("line", F.lit("---")))
    part = lambda i: F.trim(F.split_part("line", F.lit("|"), F.lit(i)))
    df = df.where(part(1) != "").select("file", "no", F.split_part(part(1), F.lit("_"), F.lit(1)).alias("scan_id"), part(2).alias("job"))
    return df.groupBy("file", "scan_id").agg(F.max_by("job", "no").alias("job"))


def report_total(lines: DataFrame) -> DataFrame:
    """(file, total): the first `Total Files Processed` of each report."""
    n = F.regexp_extract("line", r"Total Files Processed:\s*(\d+)", 1)
    return lines.where(n != "").groupBy("file").agg(F.min_by(n.cast("long"), "no").alias("total"))


def report_failures(lines: DataFrame) -> DataFrame:
    """(file, no, scan_id) of the section of failed files."""
    w = Window.partitionBy("file")
    head = F.min(F.when(F.contains("line", F.lit("FAILED FILES:")), F.col("no"))).over(w)
    df = lines.withColumn("_head", head).where("no > _head")
    end = F.contains("line", F.lit("===")) | (F.trim("line") == "")
    df = df.withColumn("_end", F.min(F.when(end, F.col("no"))).over(w)).where("_end IS NULL OR no < _end")
    name = F.trim(F.replace(F.split_part("line", F.lit("|"), F.lit(1)), F.lit("❌"), F.lit("")))
    return df.where(F.contains("line", F.lit("❌")) & F.contains("line", F.lit("|")) & (name != "")).select("file", "no", F.split_part(name, F.lit("_"), F.lit(1)).alias("scan_id"))


def enhanced_files(reports: DataFrame) -> DataFrame:
    """(report, scan_id, job, confidence, reason): the last row of each scan of a report."""
    df = reports.select("report", F.posexplode("files").alias("no", "f"))
    df = df.select("report", "no", F.lower(F.regexp_extract("f.filename", r"(?i)(scan\d+)", 1)).alias("scan_id"), "f").where("scan_id <> ''")
    last = df.groupBy("report", "scan_id").agg(F.max_by("f", "no").alias("f"))
    return last.select("report", "scan_id", F.col("f.corrected_job").alias("job"), "f.confidence", "f.reason")


def known_jobs(text: str | None) -> list[str] | None:
    """Known jobs of a comma-separated parameter; none if it is blank."""
    jobs = list(dict.fromkeys(j.strip() for j in (text or "").split(",") if j.strip()))
    return jobs or None


def write_json(df: DataFrame, path: str, by: str = "batch") -> None:
    """One folder of JSON a batch; rewriting replaces only the batches written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def latest(df: DataFrame, at: str = "run_at") -> DataFrame:
    """The last report, in place of a `latest` copy."""
    return df.agg(F.max_by(F.struct(*df.columns), at).alias("r")).select("r.*")
