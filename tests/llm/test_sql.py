"""Operators that SQL expresses: against DuckDB on tables and on odd rows."""

import re

import duckdb
import pytest
from fixtures import documents, prose, texts
from test_queries import DIR, TABLES, rows_of

from quillfold.llm import quality_rules as quality
from quillfold.llm import queries as Q
from quillfold.llm.decontaminate import contaminated
from quillfold.llm.license_scan import FOLDER, license_scan
from quillfold.llm.quality_rules import quality_rules


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, DIR).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def _sql(spark, docs, name, **tables):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    for k, v in tables.items():
        con.register(k, v.toPandas())
    return con.sql(Q.ORACLES[name]).df()


def test_quality_odd_rows(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts())]
    docs = documents(spark, rows)
    got = quality_rules(spark, docs).toPandas()
    want = _sql(spark, docs, "op5_quality_rules")
    columns = sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)
    assert quality_rules(spark, documents(spark)).count() == len(texts())
    assert quality_rules(spark, documents(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_frequent_lines_deplete(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "DEALT", 7)
    rows = [(i, "A line that all share, number 7!\n" + prose(i, 100), "one") for i in range(60)]
    rows += [(100 + i, ("a LINE that all share number 1\n" * 20) + prose(500 + i, 60), "one") for i in range(3)]
    rows += [(200 + i, f"of a small host\n{prose(200 + i, 60)}", "small") for i in range(5)]
    rows += [(300 + i, f"of a smaller one\n{prose(300 + i, 60)}", "smaller") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules(spark, docs, broadcast=broadcast).collect()}
    assert len(got) == len(rows)
    assert got[0].n_kept_words == 100 and got[0].kept
    assert got[100].n_kept_words == 60 and not got[100].kept
    assert (got[200].n_words, got[200].n_kept_words) == (64, 60)
    assert (got[300].n_words, got[300].n_kept_words) == (64, 64)


def test_lines_go_on_the_tables(spark):
    got = quality_rules(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got.where("n_kept_words < n_words").count() > 50


def test_license_odd_rows(spark):
    titled = (FOLDER / "MIT.txt").read_text()
    mit = titled.split("\n\n", 1)[1]
    rows = [(1, mit), (2, "MIT License\n\nCopyright 2020, 2021 A. Person\n" + mit), (3, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(", ", " , ")), (4, "x\n - Released under the MIT Licence.\ny"), (5, None), (6, "(c) 2001"), (None, mit), (8, "An own heading\n" + mit)]
    got = {r.doc_id: r for r in license_scan(spark, documents(spark, rows)).collect()}
    assert got[1].license_id == got[2].license_id == got[3].license_id == got[None].license_id == "MIT"
    assert got[8].license_id is None and got[4].license_id is None
    assert got[4].notice_ids == ["MIT"] and got[1].notice_ids == []
    assert got[5].digest is None and got[6].digest is None
    assert license_scan(spark, documents(spark)).count() == len(texts())
    assert license_scan(spark, documents(spark, [])).count() == 0


def test_every_full_text_is_found_however_it_is_wrapped(spark):
    rows, want = [], {}
    for file in sorted(FOLDER.glob("*.txt")):
        text = file.read_text()
        forms = [text.replace("\n", "\r\n"), text.upper()]
        if not re.search(r"(?im)^\W*copyright \W*[\dcy]", text):  # lines that go must stay lines
            forms += ["\n".join(text.split()), " ".join(text.split())]
        for form in forms:
            want[len(rows)] = file.stem
            rows.append((len(rows), form))
    got = {r.doc_id: r.license_id for r in license_scan(spark, documents(spark, rows)).collect()}
    assert len(want) > 40 and got == want


def test_known_texts_of_ones_own(spark):
    known = spark.createDataFrame([("own", "Use as you like."), ("other", "Versión única: 3"), ("sub", "Sub-licence freely")], "license_id string, text string")
    rows = [(1, "a\n* USE AS YOU LIKE\nb"), (2, "Use as you like!"), (3, "versión  ÚNICA 3"), (4, "z\nsublicense freely"), (5, "we use as you like")]
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in license_scan(spark, documents(spark, rows), known).collect()}
    assert got == {1: (None, ["own"]), 2: ("own", ["own"]), 3: ("other", ["other"]), 4: (None, ["sub"]), 5: (None, [])}


def test_contamination_odd_rows(spark):
    item = prose("item", 30)
    half = " ".join(item.split()[:20])
    rows = [(1, prose(1, 500) + "\n" + item + " " + prose(2, 300)), (2, half + " " + prose(3, 50)), (3, None), (4, ""), (5, "one two"), (6, "zero one two three"), (None, item.upper()), (1, prose(1, 500) + "\n" + item + " " + prose(2, 300))]
    items = spark.createDataFrame([(1, item, "z"), (2, "one two", "z"), (3, None, "z"), (4, "", "z"), (None, item, "z")], "item_id long, text string, n string")
    got = sorted(str((r.doc_id, r.item_id, r.containment)) for r in contaminated(spark, documents(spark, rows), items).collect())
    want = [(1, 1, 1.0), (1, None, 1.0), (5, 2, 1.0), (6, 2, 1.0), (None, 1, 1.0), (None, None, 1.0)]
    assert got == sorted(map(str, want))
    assert contaminated(spark, documents(spark), items.limit(0)).count() == 0
    assert contaminated(spark, documents(spark, []), items).count() == 0
