import json

import pytest
from pyspark.sql import functions as F

from quillfold.sources import io
from quillfold.streaming import hitl


def test_ground_truth_trims_and_takes_the_last(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("scan_id,job_number,notes\nScan1.PDF, 250371-01,\n scan2 ,250371-02,x\nscan1,250371-03,\n,250371-04,\n")
    got = {r.scan_id: r.job_number for r in io.ground_truth(spark, str(tmp_path / "gt.csv")).collect()}
    assert got == {"scan1": "250371-03", "scan2": "250371-02"}
    assert io.ground_truth(spark, str(tmp_path / "none.csv"), {"Scan9": "1"}).first().scan_id == "scan9"


def test_scan_files_by_suffix(spark, tmp_path):
    for name in ("a.PDF", "b.jpg", "c.txt", "d.png"):
        (tmp_path / name).write_bytes(b"x")
    got = io.scan_files(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1)).collect()
    assert sorted(r[0] for r in got) == ["a.PDF", "b.jpg", "d.png"]


def test_text_report(spark, tmp_path):
    (tmp_path / "r.txt").write_text(
        "FILENAME | JOB NUMBER\nscan9_x | 1\nTotal Files Processed: 12\nFILENAME | JOB NUMBER | Z\n---|---\nscan1_ready.jpg | 250371-01 | a\n"
        "scan1_b | 250371-02 | a\n=====\nscan3 | no\nFAILED FILES:\n❌ scan7_x | why\n\n❌ scan8 | no\n",
        encoding="utf-8",
    )
    lines = io.text_report_lines(spark, str(tmp_path / "r.txt"))
    assert [(r.scan_id, r.job) for r in io.report_table(lines).collect()] == [("scan1", "250371-02")]
    assert io.report_total(lines).first().total == 12
    assert [r.scan_id for r in io.report_failures(lines).collect()] == ["scan7"]


def test_metrics_of_both_dialects(spark, tmp_path):
    a = {"timestamp": "2026-01-02T03:04:05.5", "summary": {"total_in_batch": 10, "accuracy": 0.8}, "confidence_stats": {"mean": 0.5}, "batch_info": {"batch_id": "A"}}
    b = {"timestamp": "2026-01-03T03:04:05", "summary": {"total_in_batch": 4, "verified_files": 2, "actual_accuracy": 0.5, "human_corrections": 1}, "confidence_stats": {"sum": 3.0, "count": 4}, "batch_info": {"batch_id": "B"}}
    for name, x in (("A_metrics", a), ("B_metrics", b), ("latest_metrics", b)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=1))
    (tmp_path / "C_metrics.json").write_text("{broken")
    got = {r.batch: r for r in io.history(io.metrics_reports(spark, str(tmp_path))).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].verified_files, got["A"].confidence_sum, got["A"].accuracy_pct) == (10, 5.0, 80.0)
    assert (got["B"].verified_files, got["B"].confidence_sum, got["B"].run_label) == (2, 3.0, "Jan 03, 03:04:05")


def test_write_json_replaces_only_its_batches(spark, tmp_path):
    path = str(tmp_path / "out")
    io.write_json(spark.createDataFrame([("a", 1), ("b", 1)], "batch string, n int"), path)
    io.write_json(spark.createDataFrame([("b", 2)], "batch string, n int"), path)
    assert sorted(tuple(r) for r in spark.read.json(path).select("batch", "n").collect()) == [("a", 1), ("b", 2)]


def test_known_jobs_parameter():
    assert io.known_jobs(" a, b,,a ") == ["a", "b"]
    assert io.known_jobs("  ") is None


def test_corrections_refresh_touched_batches(spark, tmp_path):
    rows = [("f1", "250371-01", "250371-02", 0.9, "m", "A", "2026-01-01"), ("f1", "250371-01", "250371-03", 0.9, "m", "A", "2026-01-02"), ("f2", "1", "1", 0.9, "m", "B", "2026-01-02")]
    reviews = spark.createDataFrame(rows, "filename string, system_guess string, final string, confidence double, method_used string, batch_id string, harvested_at string")
    log = hitl.corrections_of(reviews)
    assert log.count() == 2  # the confirmed guess is none
    latest = hitl.latest_corrections(log).collect()
    assert [(r.batch, r.filename, r.truth) for r in latest] == [("A", "f1", "250371-03")]
    log.write.json(str(tmp_path / "log"))
    seen = []
    q = hitl.refresh(spark, str(tmp_path / "log"), str(tmp_path / "cp"), lambda b: seen.extend(r.batch for r in b.collect()))
    q.awaitTermination(60)
    assert seen == ["A"]


def test_dropped_files_come_once(spark, tmp_path):
    drop, seen = tmp_path / "drop", []
    drop.mkdir()

    def go():
        q = io.incoming(spark, str(drop)).writeStream.foreachBatch(lambda df, _: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)

    (drop / "a.pdf").write_bytes(b"1")
    (drop / "b.txt").write_bytes(b"2")
    go()
    (drop / "c.PNG").write_bytes(b"3")
    go()
    assert seen == ["a.pdf", "c.PNG"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        io.new_folder(Cluster)
    assert io.new_folder(spark) != io.new_folder(spark)
