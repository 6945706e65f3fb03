"""Repair of bad reads from their neighbours in scan order.

The rules read neighbours that earlier steps of the same sweep may have changed. Tiers 1
and 2 have closed forms over runs of rows; tier 3 is a fold over short runs of unreadable
rows, each with its four neighbours, so no task folds a whole batch.

Records: batch (any), scan_idx long, ordinal long, raw_job string, confidence double and,
for red ink, has_red boolean and candidates array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.config import FAILED_MARKERS, FilingConfig, ValidationConfig
from quillfold.functions import text as T
from quillfold.functions.validate import Validator, is_failed


# Reasons, as they stand in reports (those that end in a bracket are closed behind a value): fixed values.
RED_SUFFIX = "Tier 0: Red Ink Suffix Override ("
RED_SWAP = "Tier 0: Red Ink Positional Swap via Known Jobs ("
RED_OVERWRITE = "Tier 0: Red Ink Overwrite Resolved ("
KEPT_UNIQUE = "kept: valid unique suffix (conf "
SANDWICH = "Tier 1: Sandwich Rule (bracketed by "
INHERITED = "Tier 2: Suffix Inheritance (from "
CONSENSUS = "Tier 3: Weighted Consensus (adopted "
NOTHING_FOUND = "no_correction_found"
KEPT = "kept: valid"


def _order() -> Window:
    return Window.partitionBy("batch").orderBy("scan_idx", "ordinal")


def _known(df: DataFrame, known: DataFrame | None) -> DataFrame:
    """Flags rows whose present job is a known one; known: (job), null for none."""
    if known is None:
        return df.withColumn("known", F.lit(False))
    jobs = known.select(F.col("job").alias("_k")).distinct()
    return df.join(jobs, df["job"] == jobs["_k"], "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")


def prepare(records: DataFrame, known: DataFrame | None = None, validation: ValidationConfig = ValidationConfig()) -> DataFrame:
    """Adds job (null for failure markers), reason, valid, base and known."""
    v = Validator(validation)
    df = records.withColumn("job", F.when(is_failed(F.col("raw_job")), F.lit(None).cast("string")).otherwise(F.col("raw_job")))
    df = df.withColumn("reason", F.lit(None).cast("string"))
    return _state(_known(df, known), v)


def _state(df: DataFrame, v: Validator) -> DataFrame:
    df = df.withColumn("_v", v.verdict(F.col("job")))
    return df.withColumn("valid", F.coalesce("_v.is_valid", F.lit(False))).withColumn("base", F.split_part("_v.normalized", F.lit("-"), F.lit(1))).drop("_v")


def _adopt(df: DataFrame, on: Column, job: Column, base: Column, reason: Column) -> DataFrame:
    """Takes over a valid neighbour's job where on holds."""
    on = F.coalesce(on, F.lit(False))
    return df.withColumns(
        {
            "job": F.when(on, job).otherwise(F.col("job")),
            "reason": F.when(on, reason).otherwise(F.col("reason")),
            "base": F.when(on, base).otherwise(F.col("base")),
            "valid": F.col("valid") | on,
        }
    )


def red_ink(df: DataFrame, known: list[str] | None = None, validation: ValidationConfig = ValidationConfig()) -> DataFrame:
    """Tier 0: handwritten corrections, row by row. known is a job parameter."""
    v = Validator(validation)
    raw = F.col("raw_job")
    head, first, last = (F.regexp_extract(raw, r"^(\d{6})-(\d)\d(\d)", i) for i in (1, 2, 3))
    override = F.when(last != "", F.concat(head, F.lit("-"), first, last))
    override = F.when(v.is_valid(override), override)
    job, digit = F.regexp_extract(raw, r"(\d{6}-\d{2})\s*(\d)$", 1), F.regexp_extract(raw, r"(\d{6}-\d{2})\s*(\d)$", 2)
    swaps = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.substring(job, F.lit(1), i - 1), digit, F.substring(job, i + 1, F.lit(99))))
    jobs = F.array(*[F.lit(k) for k in known or []]).cast("array<string>")
    swap = F.when(digit != "", F.get(F.filter(swaps, lambda s: F.array_contains(jobs, s)), F.lit(0)))
    options = F.filter(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: v.is_valid(c)) if "candidates" in df.columns else F.array().cast("array<string>")
    many = F.size("candidates") >= 2 if "candidates" in df.columns else F.lit(False)
    # a positional swap that fails leaves the row to the candidates only if it has no job yet
    over = F.when(many & (F.size(options) >= 2), F.get(options, F.lit(0)))
    over = F.when((digit != "") & F.col("job").isNotNull(), F.lit(None)).otherwise(over)
    on = F.coalesce(F.col("has_red"), F.lit(False)) & (F.coalesce(raw, F.lit("")) != "")
    new = F.when(on, F.coalesce(override, swap, over))
    kind = F.when(override.isNotNull(), RED_SUFFIX).when(swap.isNotNull(), RED_SWAP).otherwise(RED_OVERWRITE)
    df = df.withColumn("_new", new)
    df = df.withColumn("reason", F.when(F.col("_new").isNotNull(), F.concat(kind, raw, F.lit(" -> "), F.col("_new"), F.lit(")"))).otherwise(F.col("reason")))
    df = df.withColumn("job", F.coalesce("_new", "job")).drop("_new")
    return _state(df, v)


def sandwich(df: DataFrame, config: FilingConfig = FilingConfig()) -> DataFrame:
    """Tier 1: between two equal jobs on adjoining scans, take theirs, unless a sure read has a suffix of its own.

    A row that follows a changed one sees two different neighbours and stays. So, in each
    run of rows that could change, those at offsets 0, 2, 4, ... do.
    """
    w = _order()
    prev, nxt = F.lag("job").over(w), F.lead("job").over(w)
    df = df.withColumns(
        {
            "_p": prev,
            "_pb": F.lag("base").over(w),
            "_n": nxt,
            "_dp": F.abs(F.col("scan_idx") - F.lag("scan_idx").over(w)),
            "_dn": F.abs(F.lead("scan_idx").over(w) - F.col("scan_idx")),
        }
    )
    differs = F.coalesce(F.col("job") != F.col("_p"), F.lit(True))
    cond = F.coalesce((F.col("_p") == F.col("_n")) & ~is_failed(F.col("_p")), F.lit(False)) & differs & ~F.col("known")
    mine, theirs = F.nullif(F.split_part("job", F.lit("-"), F.lit(2)), F.lit("")), F.nullif(F.split_part("_p", F.lit("-"), F.lit(2)), F.lit(""))
    typo = mine.isNotNull() & theirs.isNotNull() & T.one_off(mine, theirs)
    shielded = F.coalesce(F.col("valid") & (F.col("base") == F.col("_pb")) & ~typo & (F.col("confidence") >= config.shield), F.lit(False))
    df = df.withColumn("_shield", cond & shielded).withColumn("_cand", cond & ~shielded & (F.col("_dp") <= 1) & (F.col("_dn") <= 1))
    df = df.withColumn("_run", F.count_if(~F.col("_cand")).over(w))
    df = df.withColumn("_hit", F.col("_cand") & (F.row_number().over(Window.partitionBy("batch", "_run", "_cand").orderBy("scan_idx", "ordinal")) % 2 == 1))
    after = F.coalesce(F.lag("_hit").over(w), F.lit(False))
    df = df.withColumn("_keep", F.col("_shield") & ~after)
    df = df.withColumn("reason", F.when(F.col("_keep"), F.concat(F.lit(KEPT_UNIQUE), F.format_string("%.2f", "confidence"), F.lit(")"))).otherwise(F.col("reason")))
    # the neighbour's own verdict, since a bracketing job need not be valid
    df = df.withColumn("_pv", F.lag("valid").over(w))
    df = df.withColumns(
        {
            "reason": F.when(F.col("_hit"), F.concat(F.lit(SANDWICH), F.col("_p"), F.lit(")"))).otherwise(F.col("reason")),
            "job": F.when(F.col("_hit"), F.col("_p")).otherwise(F.col("job")),
            "base": F.when(F.col("_hit"), F.col("_pb")).otherwise(F.col("base")),
            "valid": F.when(F.col("_hit"), F.col("_pv")).otherwise(F.col("valid")),
        }
    )
    return df.drop("_p", "_pb", "_n", "_dp", "_dn", "_shield", "_cand", "_run", "_hit", "_keep", "_pv")


def inherit_suffix(df: DataFrame) -> DataFrame:
    """Tier 2: a valid job without suffix takes a neighbour's with the same base.

    Within a run of such rows of one base the left neighbour's suffix passes on to all;
    without one, only the last row can take the right neighbour's.
    """
    w = _order()
    dashed = F.col("valid") & F.contains("job", F.lit("-"))
    df = df.withColumn("_open", F.coalesce(F.col("valid") & ~F.contains("job", F.lit("-")) & ~F.col("known"), F.lit(False)))
    df = df.withColumn("_dash", F.coalesce(dashed, F.lit(False)))
    starts = F.col("_open") & ~F.coalesce(F.lag("_open").over(w) & (F.lag("base").over(w) == F.col("base")), F.lit(False))
    df = df.withColumn("_start", starts)
    df = df.withColumn("_run", F.count_if(F.col("_start") | ~F.col("_open")).over(w))
    before = F.when(F.lag("_dash").over(w) & (F.lag("base").over(w) == F.col("base")), F.lag("job").over(w))
    after = F.when(F.lead("_dash").over(w) & (F.lead("base").over(w) == F.col("base")), F.lead("job").over(w))
    df = df.withColumn("_before", F.when(F.col("_start"), before)).withColumn("_after", after)
    run = Window.partitionBy("batch", "_run", "_open").orderBy("scan_idx", "ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_left", F.first("_before").over(run))
    take = F.when(F.col("_open"), F.coalesce("_left", "_after"))
    df = df.withColumn("_take", take)
    df = _adopt(df, F.col("_take").isNotNull(), F.col("_take"), F.col("base"), F.concat(F.lit(INHERITED), F.col("_take"), F.lit(")")))
    return df.drop("_open", "_dash", "_start", "_run", "_before", "_after", "_left", "_take")


def consensus(df: DataFrame, config: FilingConfig = FilingConfig()) -> DataFrame:
    """Tier 3: an unreadable row takes the job that its neighbours weigh most for.

    Rows filled in the same sweep vote at once, so the vote cascades. Targets less than
    three rows apart form a run; runs don't see each other and are folded one by one.
    """
    w = _order()
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_target", ~F.col("valid") & ~F.col("known"))
    gate = (F.col("confidence") >= config.gate) | F.contains(F.coalesce("reason", F.lit("")), F.lit("Tier"))
    df = df.withColumn("_me", F.struct(F.col("_rn").alias("n"), "scan_idx", "job", "base", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce(gate, F.lit(False)).alias("gate")))
    near = [F.lag("_me", d).over(w) if d > 0 else F.lead("_me", -d).over(w) for d in range(config.window, -config.window - 1, -1) if d]
    df = df.withColumn("_near", F.array(*near))
    last = F.last(F.when(F.col("_target"), F.col("_rn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("_target") & F.coalesce(F.col("_rn") - last > config.window, F.lit(True))
    df = df.withColumn("_fresh", fresh).withColumn("_run", F.count_if(F.col("_fresh")).over(w))
    runs = df.where("_target").groupBy("batch", "_run").agg(F.sort_array(F.collect_list(F.struct("_rn", "scan_idx", "_near"))).alias("rows"))
    filled = runs.select("batch", F.explode(F.expr(_fold(config))).alias("f")).select("batch", F.col("f.n").alias("_rn"), F.col("f.job").alias("_take"), F.col("f.base").alias("_tbase"))
    df = df.alias("a").join(filled.alias("b"), F.expr("a.batch <=> b.batch AND a._rn = b._rn"), "left").select("a.*", "_take", "_tbase")
    df = _adopt(df, F.col("_take").isNotNull(), F.col("_take"), F.col("_tbase"), F.concat(F.lit(CONSENSUS), F.col("_take"), F.lit(")")))
    return df.drop("_rn", "_target", "_me", "_near", "_fresh", "_run", "_take", "_tbase")


def _fold(c: FilingConfig) -> str:
    """SQL of the fold over `rows` (_rn, scan_idx, _near), sorted: array<struct<n, job, base>>."""
    # what a neighbour is by now: filled earlier in this run, or as it was
    now = """transform(filter(x._near, y -> y IS NOT NULL), y -> named_struct(
        'n', y.n, 'scan_idx', y.scan_idx, 'f', get(filter(last, z -> z.n = y.n AND z.job IS NOT NULL), 0), 'o', y))"""
    now = f"""transform({now}, y -> named_struct('n', y.n, 'dist', abs(y.scan_idx - x.scan_idx),
        'job', coalesce(y.f.job, y.o.job), 'base', coalesce(y.f.base, y.o.base),
        'valid', y.f IS NOT NULL OR y.o.valid, 'gate', y.f IS NOT NULL OR y.o.gate))"""
    voters = f"filter({now}, y -> y.valid)"
    major = "array_max(transform(v, y -> struct(size(filter(v, z -> z.base = y.base)) AS c, -y.n AS k, y.base AS b))).b"
    weight = f"""CAST({c.window + 1} - abs(y.n - x._rn) AS DOUBLE)
        * CASE WHEN y.dist <= 1 THEN CAST({c.near} AS DOUBLE) ELSE CAST({c.far} AS DOUBLE) END
        * CASE WHEN y.base = m THEN 1.0D ELSE CAST({c.outlier} AS DOUBLE) END"""
    weighed = f"transform(filter(v, y -> y.dist <= {c.max_distance} AND y.gate), y -> struct(y.n AS n, y.job AS job, y.base AS base, {weight} AS w))"
    best = "array_max(transform(q, y -> struct(aggregate(filter(q, z -> z.job = y.job), 0.0D, (t, z) -> t + z.w) AS t, -y.n AS k, y.job AS job, y.base AS base)))"
    # neighbours lie within the window, so the last results are all that a row can see
    recent = f"slice(s, greatest(size(s) - {c.window - 1}, 1), {c.window})"
    one = f"transform(array({voters}), v -> transform(array({major}), m -> transform(array({weighed}), q -> {best})[0])[0])[0]"
    one = f"transform(array({recent}), last -> {one})[0]"
    step = f"transform(array({one}), r -> concat(s, array(named_struct('n', x._rn, 'job', r.job, 'base', r.base))))[0]"
    return f"aggregate(rows, CAST(array() AS array<struct<n:int,job:string,base:string>>), (s, x) -> {step})"


def finish(df: DataFrame) -> DataFrame:
    """Nothing found keeps the raw read; a job without reason was right as read."""
    none = F.coalesce("job", F.lit("")) == ""
    return df.withColumn("reason", F.when(none, F.lit(NOTHING_FOUND)).otherwise(F.coalesce("reason", F.lit(KEPT)))).withColumn("corrected_job", F.when(none, F.col("raw_job")).otherwise(F.col("job")))


def smart_correct_batch(records: DataFrame, known_jobs: list[str] | None = None, config: FilingConfig = FilingConfig(), validation: ValidationConfig = ValidationConfig(), known: DataFrame | None = None) -> DataFrame:
    """All tiers: records with corrected_job and reason. known_jobs is a parameter list; known a table (job)."""
    if known is None and known_jobs:
        known = records.sparkSession.createDataFrame([(j,) for j in sorted(set(known_jobs))], "job string")
    df = prepare(records, known, validation)
    if "has_red" in records.columns:
        df = _refresh(red_ink(df, known_jobs, validation), known)
    df = _refresh(sandwich(df, config), known)
    df = _refresh(inherit_suffix(df), known)
    df = finish(consensus(df, config))
    return df.select(*records.columns, "corrected_job", "reason")


def _refresh(df: DataFrame, known: DataFrame | None) -> DataFrame:
    """Membership of the present jobs; nothing to do without known jobs."""
    return df if known is None else _known(df.drop("known"), known)


__all__ = ["FAILED_MARKERS", "consensus", "finish", "inherit_suffix", "prepare", "red_ink", "sandwich", "smart_correct_batch"]
