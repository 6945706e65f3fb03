import pytest
from pyspark.sql import functions as F

from quillfold.config import ValidationConfig
from quillfold.functions.validate import Validator

GOLDEN = {
    "250371-01": "250371-01",
    "25O37l-0I": "250371-01",
    "25 0371 - 01": "250371-01",
    "250371–01": "250371-01",
    "250371E01": "250371-01",
    "25037101": "250371-01",
    "250371": "250371",
    "250371-1": "250371",
    "250371-011": "250371-01",
    "250371-0112": None,
    "250371 250372-02": None,
    "240298-145": "240298-14",
    "250371-01A": "250371-01",
    "JOB NO 250371-01 REV 2": "250371-01",
    "50371-01": "250371-01",
    "90371-01": None,
    "110849O": "1108490",
    "1128490": None,
    "180371-01": None,
    "251371-01": None,
    "250371\n01": "250371-01",
    "250371\n\n01": None,
    "20240319": None,
    "APPROVED 240283": "240283",
    "APPROVED240283-16": None,
    "A250371-01": "250371-01",
    "12250371-01": None,
    "03/14/25 250371-01": "250371-01",
    "": None,
}


@pytest.fixture(scope="module")
def verdicts(spark):
    df = spark.createDataFrame([(t,) for t in [*GOLDEN, None]], "t string")
    rows = df.select("t", Validator().verdict(F.col("t")).alias("v"), Validator().base(F.col("t")).alias("b")).collect()
    return {r.t: r for r in rows}


@pytest.mark.parametrize("text", GOLDEN)
def test_golden(verdicts, text):
    assert verdicts[text].v.normalized == GOLDEN[text]
    assert verdicts[text].v.is_valid == (GOLDEN[text] is not None)


def test_reasons(verdicts):
    assert verdicts[None].v.reason == verdicts[""].v.reason == "empty_input"
    assert verdicts["20240319"].v.reason == "no_content_after_normalization"
    assert verdicts["90371-01"].v.reason == "no_pattern_match"
    assert verdicts["250371-01"].b == "250371"
    assert verdicts["90371-01"].b is None


def test_year_window_spans_decades(spark):
    v = Validator(ValidationConfig(as_of_year=21))
    df = spark.createDataFrame([("160001-01",), ("200001-01",), ("220001-01",), ("230001-01",)], "t string")
    assert [r[0] for r in df.select(v.is_valid(F.col("t"))).collect()] == [True, True, True, False]
