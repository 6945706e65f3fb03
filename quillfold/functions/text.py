"""File names, durations, method strings and string distances."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def safe_folder(name: Column) -> Column:
    t = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    t = F.substring(F.regexp_replace(t, r"^\s+|\s+$", ""), 1, 100)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unnamed"))


def unique_name(name: Column, batch: Column) -> Column:
    return F.concat(safe_folder(batch), F.lit("_"), name)


def original_name(name: Column, batch: Column) -> Column:
    prefix = F.concat(safe_folder(batch), F.lit("_"))
    return F.when(F.startswith(name, prefix), F.substring(name, F.length(prefix) + 1, F.length(name))).otherwise(name)


def ready_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, "_ready$", "")


def scan_index(name: Column, fallback: Column | int = 0) -> Column:
    digits = F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)")), F.lit(-1))
    first = F.nullif(F.regexp_extract(name, r"(?i)scan(\d+)", 1), F.lit(""))
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(first.try_cast("long"), digits.try_cast("long"), fallback.cast("long"))


def scan_id(name: Column) -> Column:
    found = F.lower(F.regexp_extract(name, r"(?i)(scan\d+)", 1))
    return F.when(found != "", found).otherwise(F.split_part(name, F.lit("."), F.lit(1)))


def display_id(stem: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(stem, "_"), lambda p: F.startswith(F.lower(p), F.lit("scan"))), F.lit(0)), stem)


def safe_job(job: Column) -> Column:
    return F.regexp_replace(job, r"[^\p{L}\p{N}_-]", "")


def comparable(job: Column) -> Column:
    """Without notes of corrections, brackets, stars and white space."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(job, F.lit("")), r"\(corrected:[^)]*\)?", ""), r"[)*\s]", "")


def hamming(a: Column, b: Column) -> Column:
    """Differing positions; infinite for unequal lengths."""
    at = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    differ = F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(F.length(a) == F.length(b), differ.cast("double")).otherwise(F.lit(float("inf")))


def one_off(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (hamming(a, b) == 1), F.lit(False))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which no built-in function gives."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similarity_band(percent: Column) -> Column:
    return F.when(percent >= 90, "High").when(percent >= 80, "Moderate").otherwise("Low")


def duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%.2fs", seconds)).otherwise(F.format_string("%dm %.2fs", F.floor(seconds / 60), seconds - F.floor(seconds / 60) * 60))


def duration_detailed(seconds: Column) -> Column:
    hours, rest = F.floor(seconds / 3600), seconds - F.floor(seconds / 3600) * 3600
    return F.when(seconds < 3600, duration(seconds)).otherwise(F.format_string("%dh %dm %.2fs", hours, F.floor(rest / 60), rest - F.floor(rest / 60) * 60))


MARK = "smart_filing:"


def ocr_method(method: Column, strip_marker: bool = True) -> Column:
    """The reader's own method; a corrected method keeps a trailing ` (+` unless stripped."""
    t = F.trim(F.split_part(method, F.lit(MARK), F.lit(1)))
    if strip_marker:
        t = F.regexp_replace(t, r"\s*\(\+$", "")
    return F.when(F.coalesce(method, F.lit("")) == "", F.lit("unknown")).otherwise(t)


def method_confidence(method: Column, fallback: Column) -> Column:
    stated = F.regexp_extract(F.coalesce(method, F.lit("")), r"conf\s*([0-9.]+)", 1).try_cast("double")
    return F.coalesce(fallback.cast("double"), stated, F.lit(0.0))


def correction_reason(method: Column) -> Column:
    reason = F.regexp_replace(F.trim(F.split_part(method, F.lit(MARK), F.lit(2))), r"\)$", "")
    return F.when(F.contains(F.coalesce(method, F.lit("")), F.lit(MARK)), reason).otherwise(F.lit("kept: valid"))


def run_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, HH:mm:ss")


def method_title(method: Column) -> Column:
    return F.initcap(F.replace(method, F.lit("_"), F.lit(" ")))


def batch_of_report(name: Column) -> Column:
    return F.regexp_replace(name, "_run_data$", "")


def trend_label(slope: Column, n: Column) -> Column:
    return F.when(n < 2, "INSUFFICIENT").when(slope > 0.01, "IMPROVING").when(slope < -0.01, "DECLINING").otherwise("STABLE")
