from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sequential import file_batch

from quillfold.operators import filing

JOBS = ["failed", "bad", "", "250371", "250371-01", "250371-02", "250371-10", "240283-16", "240283", "250371-04"]
ROW = st.tuples(st.integers(0, 3), st.sampled_from(JOBS), st.sampled_from([0.5, 0.72, 0.8, 0.9]))
SCHEMA = "batch long, scan_idx long, ordinal long, raw_job string, confidence double"


def _table(batches):
    rows = []
    for b, batch in enumerate(batches):
        at = 0
        for i, (step, job, conf) in enumerate(batch):
            at += step
            rows.append((b, at, i, job, conf))
    return rows


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ROW, min_size=1, max_size=14), min_size=60, max_size=120))
def test_tiers_equal_the_sequential_rules(spark, batches):
    rows = _table(batches)
    want = {}
    for b in range(len(batches)):
        own = [r for r in rows if r[0] == b]
        for r, job in zip(own, file_batch([(r[1], r[3], r[4]) for r in own], {"250371-04"}), strict=True):
            want[r[:3]] = job
    got = filing.smart_correct_batch(spark.createDataFrame(rows, SCHEMA), ["250371-04"]).collect()
    assert {(r.batch, r.scan_idx, r.ordinal): r.corrected_job for r in got} == want


def test_alternating_reads_change_every_other_row(spark):
    jobs = ["250371-01", "250371-02", "250371-01", "250371-02", "250371-01"]
    df = spark.createDataFrame([(0, i, 0, j, 0.5) for i, j in enumerate(jobs)], SCHEMA)
    out = filing.sandwich(filing.prepare(df)).orderBy("scan_idx").collect()
    assert [r.job for r in out] == ["250371-01"] * 3 + ["250371-01", "250371-01"]


def test_a_sure_suffix_is_kept(spark):
    jobs = [("250371-01", 0.9), ("250371-10", 0.8), ("250371-01", 0.9)]
    df = spark.createDataFrame([(0, i, 0, j, c) for i, (j, c) in enumerate(jobs)], SCHEMA)
    row = filing.smart_correct_batch(df).where("scan_idx = 1").first()
    assert (row.corrected_job, row.reason) == ("250371-10", "kept: valid unique suffix (conf 0.80)")


def test_red_ink(spark):
    rows = [
        (0, 0, 0, "240298-145", 0.9, True, []),
        (0, 1, 0, "260355-32 4", 0.9, True, []),
        (0, 2, 0, "failed", 0.0, True, ["240283-16", "x", "240292-20"]),
        (0, 3, 0, "240298-145", 0.9, False, []),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", has_red boolean, candidates array<string>")
    out = filing.red_ink(filing.prepare(df), ["240355-32"]).orderBy("scan_idx").collect()
    assert [r.job for r in out] == ["240298-15", "240355-32", "240283-16", "240298-145"]
    assert out[1].reason.startswith("Tier 0: Red Ink Positional Swap")


def test_no_rows(spark):
    assert filing.smart_correct_batch(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_found_keeps_the_raw_read(spark):
    df = spark.createDataFrame([(0, 0, 0, "failed", 0.0)], SCHEMA)
    row = filing.smart_correct_batch(df).first()
    assert (row.corrected_job, row.reason) == ("failed", "no_correction_found")
    assert filing.prepare(df).select(F.col("valid")).first()[0] is False
