import numpy as np
from fixtures import documents, texts
from pyspark.sql import functions as F

from quillfold.llm import words as W
from quillfold.llm.language_id import LEAST_PART, LEAST_RATE, UNKNOWN, LanguageFilter, held_out, identify, language_id, learn_from


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n >= 0.98


def test_the_filter_names_every_language_of_a_gram():
    """Bit slices against plain sets; false positives as computed."""
    rng = np.random.default_rng(3)
    grams = [rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(3)]
    grams[1][:100] = grams[0][:100]
    f = LanguageFilter.build(["a", "b", "c"], grams)
    for bit, own in enumerate(grams):
        a, b, c = f.places(own, f.slots.shape[1])
        assert (((f.slots[0][a] & f.slots[0][b] & f.slots[0][c]) >> bit) & 1).all()
    other = rng.integers(0, 2**63, 100_000, dtype=np.uint64)
    a, b, c = f.places(W.mix(other), f.slots.shape[1])
    hit = f.slots[0][a] & f.slots[0][b] & f.slots[0][c]
    for bit in range(3):
        assert abs(((hit >> bit) & 1).mean() - f.false_rate[bit]) < 0.003


def test_odd_rows(spark):
    got = language_id(spark, documents(spark)).collect()
    assert len(got) == len(texts())
    for r in got:
        assert 0.0 <= r.score <= 1.0
        text = next(t for i, t in texts() if i == r.doc_id)
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == (UNKNOWN, 0.0) or r.doc_id is None


def test_no_labels_and_no_rows(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id(spark, docs).collect()} == {UNKNOWN}
    assert language_id(spark, documents(spark, [])).collect() == []


def test_held_out_rule(spark):
    import zlib

    df = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


def test_more_languages_than_bits(spark):
    """70 languages with words of their own: none is left out."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    r = np.random.default_rng(8)
    vocabulary = {f"l{k:02d}": ["".join(r.choice(list(alphabet), 7)) for _ in range(25)] for k in range(70)}
    rows = [(i, " ".join(r.choice(vocabulary[lang], 40)), lang) for i, lang in enumerate(sorted(vocabulary) * 6)]
    got = {x.doc_id: x.lang_pred for x in language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_against_plain_sets(spark):
    """Predictions by sets of n-grams in place of the filter, on the table's held-out rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = learn_from(spark, docs)
    rows = docs.where(held_out()).collect()

    def grams(text):
        out, last = [], " "
        for ch in text or "":
            ch = ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else ch if ch.isalpha() else " "
            if ch != " " or last != " " or not out:
                out.append(ch)
            last = ch
        return ["".join(out[i : i + 4]) for i in range(len(out) - 3)]

    seen = {}
    for r in docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect():
        for g in grams(r.text):
            seen.setdefault(r.lang, {}).setdefault(g, 0)
            seen[r.lang][g] += 1
    rate = {x: {g: c / sum(by.values()) for g, c in by.items()} for x, by in seen.items()}
    top = {}
    for by in rate.values():
        for g, v in by.items():
            top[g] = max(top.get(g, 0), v)
    own = {x: {g for g, v in by.items() if v >= LEAST_RATE and v >= LEAST_PART * top[g]} for x, by in rate.items()}
    got = {r.doc_id: r for r in identify(spark, docs.where(held_out()), known).collect()}
    agree = 0
    for r in rows:
        count = {x: sum(g in s for g in grams(r.text)) for x, s in own.items()}
        best = max(sorted(count), key=count.get) if any(c.isalpha() for c in r.text or "") else UNKNOWN
        agree += got[r.doc_id].lang_pred == best
    assert len(rows) > 20 and agree >= len(rows) - 1
