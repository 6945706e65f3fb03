"""Batch, human-review, historical and trend metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.config import TrustConfig
from quillfold.functions import text as T
from quillfold.operators.routing import REVIEW, SUCCESS, trusted_guess


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def run_summary(files: DataFrame, *by: str, wall: Column | None = None) -> DataFrame:
    """Counts by status, rates and times of each batch; wall: elapsed seconds of a batch, else their sum."""
    total = F.count("*")
    good, held = F.count_if(F.col("status") == SUCCESS), F.count_if(F.col("status") == REVIEW)
    spent = F.sum(F.coalesce("proc_sec", F.lit(0.0)))
    elapsed = spent if wall is None else F.coalesce(F.nullif(F.max(wall), F.lit(0.0)), spent)
    return files.groupBy(*by).agg(
        total.alias("total_files"),
        good.alias("successful_autofiling"),
        held.alias("manual_review_required"),
        (total - good - held).alias("failed"),
        (100 * ratio(good, total)).alias("success_rate_pct"),
        (100 * ratio(held, total)).alias("hitl_rate_pct"),
        spent.alias("total_sec"),
        F.avg(F.coalesce("proc_sec", F.lit(0.0))).alias("avg_sec"),
        elapsed.alias("total_wall_time_sec"),
        F.when(elapsed > 0, spent / elapsed).otherwise(1.0).alias("parallel_speedup"),
    )


def method_efficiency(files: DataFrame, *by: str) -> DataFrame:
    """Files and seconds of each method, over files that were not lost."""
    kept = files.where(F.col("status").isin(SUCCESS, REVIEW))
    return kept.groupBy(*by, T.ocr_method(F.col("method")).alias("ocr_method")).agg(
        F.count("*").alias("files"), F.sum("proc_sec").alias("total_sec"), F.avg("proc_sec").alias("avg_sec")
    )


def review_state(files: DataFrame, corrections: DataFrame, holding: DataFrame, config: TrustConfig = TrustConfig()) -> DataFrame:
    """Each file with pending, trusted and corrected flags and its similarity.

    files: batch, filename, guess, confidence, method. corrections: batch, filename, truth,
    similarity - the latest of each file. holding: batch, filename of files still held.
    """
    fix = corrections.select("batch", "filename", "truth", "similarity")
    held = holding.select("batch", "filename").distinct().withColumn("_held", F.lit(True))
    df = files.join(fix, ["batch", "filename"], "left").join(held, ["batch", "filename"], "left")
    df = df.withColumn("pending", F.coalesce("_held", F.lit(False))).drop("_held")
    df = df.withColumn("trusted", trusted_guess(F.col("confidence"), F.col("guess"), config))
    wrong = F.col("truth").isNotNull() & (F.coalesce("guess", F.lit("")) != "") & (F.col("guess") != F.trim("truth"))
    return df.withColumn("corrected", F.coalesce(wrong, F.lit(False)))


def review_metrics(state: DataFrame, *by: str) -> DataFrame:
    done, fixed, sure = ~F.col("pending"), F.col("corrected"), F.col("trusted")
    out = state.groupBy(*by).agg(
        F.count("*").alias("total_in_batch"),
        F.count_if(done).alias("verified_files"),
        F.count_if(~done).alias("pending_files"),
        F.count_if(done & sure).alias("verified_trusted_count"),
        F.count_if(fixed).alias("human_corrections"),
        F.count_if(sure).alias("theoretical_auto_count"),
        F.count_if(done & sure & fixed).alias("silent_failures"),
        F.coalesce(F.avg(F.when(fixed, F.col("similarity"))), F.lit(1.0)).alias("avg_typo_similarity"),
        F.sum("confidence").alias("confidence_sum"),
        F.count("confidence").alias("confidence_count"),
    )
    return out.withColumns(
        {
            "theoretical_automation": ratio(F.col("theoretical_auto_count"), F.col("total_in_batch")),
            "actual_accuracy": ratio(F.col("verified_files") - F.col("human_corrections"), F.col("verified_files")),
            "silent_failure_rate": ratio(F.col("silent_failures"), F.col("verified_trusted_count")),
            "mean_confidence": ratio(F.col("confidence_sum"), F.col("confidence_count")),
        }
    )


def method_accuracy(state: DataFrame, *by: str) -> DataFrame:
    """Totals and correct reads of each method over verified files."""
    done = state.where(~F.col("pending"))
    out = done.groupBy(*by, "method").agg(F.count("*").alias("total"), F.count_if(~F.col("corrected")).alias("correct"))
    return out.withColumn("accuracy", 100 * ratio(F.col("correct"), F.col("total")))


def method_accuracy_of_maps(metrics: DataFrame) -> DataFrame:
    """The same over stored reports with a map method_stats<struct<total, correct>>."""
    rows = metrics.select(F.explode("method_stats").alias("method", "s"))
    out = rows.groupBy("method").agg(F.sum("s.total").alias("total"), F.sum("s.correct").alias("correct"))
    return out.withColumn("accuracy", 100 * ratio(F.col("correct"), F.col("total")))


def global_kpis(history: DataFrame) -> DataFrame:
    """Ratios of sums over all batches (never means of ratios), and the mean speed-up."""
    s = lambda c: F.sum(c)
    timed = F.col("total_wall_time_sec") > 0
    return history.agg(
        s("total_in_batch").alias("total_processed"),
        s("verified_files").alias("total_verified"),
        s("human_corrections").alias("total_corrections"),
        (100 * ratio(s("verified_files") - s("human_corrections"), s("verified_files"))).alias("accuracy_pct"),
        (100 * ratio(s("theoretical_auto_count"), s("total_in_batch"))).alias("automation_pct"),
        (100 * ratio(s("silent_failures"), s("verified_trusted_count"))).alias("silent_failure_pct"),
        (100 * ratio(s("initial_hitl"), s("total_in_batch"))).alias("hitl_pct"),
        (100 * ratio(s("initial_success"), s("total_in_batch"))).alias("success_pct"),
        (100 * ratio(s("initial_failed"), s("total_in_batch"))).alias("failed_pct"),
        F.coalesce(F.avg("parallel_speedup"), F.lit(1.0)).alias("avg_speedup"),
        (100 * ratio(s("confidence_sum"), s("confidence_count"))).alias("avg_confidence_pct"),
        ratio(F.sum(F.when(timed, F.col("total_wall_time_sec"))), F.sum(F.when(timed, F.col("total_in_batch")))).alias("avg_speed_sec"),
        F.coalesce(100 * F.try_divide(s(F.col("avg_typo_similarity") * F.col("human_corrections")), s("human_corrections").cast("double")), F.lit(100.0)).alias("weighted_similarity_pct"),
    )


def latest_vs_all(history: DataFrame) -> DataFrame:
    """The last batch by run_at and its differences from all time."""
    last = history.agg(F.max_by(F.struct(*history.columns), F.struct("run_at", "batch")).alias("l")).select("l.*")
    rate = lambda c: 100 * ratio(F.col(c), F.col("total_in_batch"))
    last = last.select(
        "batch",
        rate("initial_success").alias("success_pct"),
        rate("initial_hitl").alias("hitl_pct"),
        rate("initial_failed").alias("failed_pct"),
        (100 * ratio(F.col("verified_files") - F.col("human_corrections"), F.col("verified_files"))).alias("accuracy_pct"),
        (100 * ratio(F.col("silent_failures"), F.col("verified_trusted_count"))).alias("silent_failure_pct"),
        F.col("parallel_speedup").alias("avg_speedup"),
    )
    every = global_kpis(history)  # one row
    names = ["success_pct", "hitl_pct", "failed_pct", "accuracy_pct", "silent_failure_pct", "avg_speedup"]
    out = last.alias("l").join(every.alias("g"))
    return out.select("l.batch", *[F.col(f"l.{n}").alias(n) for n in names], *[(F.col(f"l.{n}") - F.col(f"g.{n}")).alias(f"{n}_delta") for n in names])


def accuracy_trend(history: DataFrame) -> DataFrame:
    """Least-squares slope of accuracy by report order, its label, and range statistics.

    history: one row a report (report, accuracy, size): report names order the trend.
    """
    # one row a batch report: the order is global by nature, the table small beside the scans
    ranked = history.withColumn("x", F.row_number().over(Window.orderBy("report")) - 1)
    out = ranked.agg(
        F.count("*").alias("reports"),
        F.avg("accuracy").alias("avg_accuracy"),
        F.min("accuracy").alias("min_accuracy"),
        F.max("accuracy").alias("max_accuracy"),
        F.coalesce(F.regr_slope("accuracy", "x"), F.lit(0.0)).alias("slope"),
        F.avg(F.nullif("size", F.lit(0))).alias("avg_batch_size"),
        F.min(F.nullif("size", F.lit(0))).alias("min_batch_size"),
        F.max(F.nullif("size", F.lit(0))).alias("max_batch_size"),
    )
    return out.withColumn("trend", T.trend_label(F.col("slope"), F.col("reports")))


def evolution(counts: DataFrame, reports: DataFrame, kind: str) -> DataFrame:
    """For each kind its counts over all reports in order, 0 where absent; all-zero kinds dropped.

    counts: (report, kind, n); reports: (report). Reports are numbered; each kind's counts
    are put at their numbers, so nothing is made for reports that lack it but a zero.
    """
    # one row a batch report: the order is global by nature, the table small beside the scans
    order = reports.select("report").distinct().withColumn("at", F.row_number().over(Window.orderBy("report")))
    known = counts.where("n > 0").join(order, "report").groupBy(kind).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("of"))
    size = order.agg(F.max("at").alias("size"))  # one row
    full = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0)).cast("long"))
    return known.join(F.broadcast(size)).select(kind, full.alias("counts"))


def confidence_trend(history: DataFrame) -> DataFrame:
    """Mean and range of the reports' mean confidences; no row if there are fewer than two reports or all are 0.

    history: (report, mean_confidence), an absent mean counting as 0.
    """
    mean = F.coalesce("mean_confidence", F.lit(0.0))
    out = history.agg(F.count("*").alias("reports"), F.avg(mean).alias("avg_confidence"), F.min(mean).alias("min_confidence"), F.max(mean).alias("max_confidence"), F.max(mean != 0).alias("_any"))
    return out.where("reports >= 2 AND _any").drop("_any")


def log_summary(files: DataFrame, *by: str) -> DataFrame:
    """What a finished run logs: counts, success rate, time in all and a file, and methods with their counts by name."""
    good = F.col("status") == SUCCESS
    total = files.groupBy(*by).agg(
        F.count("*").alias("total_files"),
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
        (100 * ratio(F.count_if(good), F.count("*"))).alias("success_rate_pct"),
        F.sum("proc_sec").alias("total_sec"),
        ratio(F.sum("proc_sec"), F.count("*")).alias("avg_sec"),
    )
    methods = files.groupBy(*by, "method").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("method", "n"))).alias("methods"))
    return total.join(methods, list(by))


def methods_by_time(efficiency: DataFrame) -> DataFrame:
    """Methods in the order of a run report: most seconds in all first, equals by name; place counts from 1."""
    # one row a method
    return efficiency.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total_sec"), "ocr_method"))).orderBy("place")


def methods_by_accuracy(accuracy: DataFrame) -> DataFrame:
    """Methods in the order of the chart: least accurate first, equals by name; place counts from 1."""
    return accuracy.withColumn("place", F.row_number().over(Window.orderBy("accuracy", "method"))).orderBy("place")


def shares(counts: DataFrame, kind: str) -> DataFrame:
    """Each kind's count and percentage of all."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.groupBy(kind).agg(F.sum("n").alias("n")).join(total).select(kind, "n", (100 * ratio(F.col("n"), F.col("total"))).alias("pct"))


def batch_accuracy(total: Column, errors: Column, correct: Column, checks: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) > 0, (total - errors) / total.cast("double")).otherwise(ratio(correct, checks))
