"""A scan log derived from the events table: the input of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def logged(name: Column) -> Column:
    """Names of files (or texts that hold some) as the log has them: six digits of a number."""
    return F.regexp_replace(name, r"(scan\d{6})\d+", "$1")


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename has six digits, as in the SQL, and repeats from event 1,000,000 on; file has all, so it is what to join and group by."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    g = F.floor(F.col("event_id") / 5)
    e = e.withColumn("g", g).withColumn("sfx", 1 + F.col("g") % 20)
    base = F.concat((21 + F.col("g") % 7).cast("string"), F.lit("0"), F.lpad(((F.col("g") * 37) % 1000).cast("string"), 3, "0"))
    e = e.withColumn("base_job", base)
    dashed = lambda s: F.concat(F.col("base_job"), F.lit("-"), F.lpad(s.cast("string"), 2, "0"))
    right = dashed(F.col("sfx"))
    bought = F.col("event_type") == "purchase"
    raw = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", F.col("base_job"))
        .when(bought & (F.col("k") % 2 == 0), dashed(F.col("sfx") + 1))
        .when(bought, dashed(99 - F.col("sfx")))
        .otherwise(right)
    )
    number = F.col("event_id").cast("string")
    return e.select(
        F.floor(F.col("event_id") / 500).alias("batch"),
        F.col("event_id").alias("scan_idx"),
        F.lit(0).cast("long").alias("ordinal"),
        F.concat(F.lit("scan"), F.lpad(number, 6, "0"), F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("scan"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number), F.lit(".pdf")).alias("file"),
        right.alias("true_job"),
        raw.alias("raw_job"),
        F.when(F.col("event_type") == "error", 0.0).otherwise((40 + F.col("k") % 60) / 100.0).cast("double").alias("confidence"),
        (F.col("k") % 17 == 0).alias("has_red"),
        (F.col("value") / 10).cast("double").alias("proc_sec"),
        "ts",
        "event_type",
        "k",
    )


#: The same in DuckDB's SQL.
SCAN_SQL = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(event_id / 5) AS BIGINT) AS g FROM events),
j AS (SELECT *, 1 + g % 20 AS sfx, CAST(21 + g % 7 AS VARCHAR) || '0' || lpad(CAST((g * 37) % 1000 AS VARCHAR), 3, '0') AS base_job FROM e),
scan AS (
  SELECT CAST(floor(event_id / 500) AS BIGINT) AS batch, event_id AS scan_idx,
         'scan' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '.pdf' AS filename,
         base_job || '-' || lpad(CAST(sfx AS VARCHAR), 2, '0') AS true_job,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN base_job
              WHEN event_type = 'purchase' AND k % 2 = 0 THEN base_job || '-' || lpad(CAST(sfx + 1 AS VARCHAR), 2, '0')
              WHEN event_type = 'purchase' THEN base_job || '-' || lpad(CAST(99 - sfx AS VARCHAR), 2, '0')
              ELSE base_job || '-' || lpad(CAST(sfx AS VARCHAR), 2, '0') END AS raw_job,
         CAST(CASE WHEN event_type = 'error' THEN 0.0 ELSE (40 + k % 60) / 100.0 END AS DOUBLE) AS confidence,
         k % 17 = 0 AS has_red, value / 10 AS proc_sec, ts, event_type, k
  FROM j)
"""
