"""Benchmark decontamination: short test items found inside long documents.

Containment of an item is the part of its distinct 5-word shingles that a document holds;
0.8 or more contaminates the document.

Search. Items are partitioned by size (bands of a factor two). An item of n shingles is
sketched by its n - ceil(0.8 n) + 1 least shingle hashes (a bottom MinHash sketch): a
document that holds 0.8 of the shingles can't miss all of those, so the search loses
nothing. A band's largest sketch hash is its threshold; of a document only the shingles
below the thresholds of the bands whose items are small enough for it are looked up.
Verification. For the documents found, all shingles, as words, are matched with those of
the items found, and counted.

Built-in expressions only. Sketches and items are broadcast behind a check of their size,
else joined by shuffles. A passage that many documents share is a row for each of them,
never a pair of documents.

Cases: null or empty text or item: nothing to find. Items of fewer than five words are one
shingle of their own length, looked up as such. Null ids are matched like any other.
Repeated rows: one result each pair of ids and text. A tie of exactly 0.8 contaminates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.llm.scratch import BROADCAST_BYTES, Scratch

SHINGLE = 5
#: Least containment, as a fraction of whole numbers.
NUM, DEN = 80, 100
SPACE = r"[ \t-\r]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def _starts(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, sizes: Sequence[int], of: Callable[..., Column]) -> Column:
    """Distinct values of `of` over all runs of the given sizes."""

    def run(k: int) -> Column:
        return F.transform(_starts(words, k), lambda i: of(*[F.get(words, i + j) for j in range(k)]))

    runs = [run(k) for k in sizes]
    return F.array_distinct(F.concat(*runs) if len(runs) > 1 else runs[0])


def shingle_hashes(words: Column, sizes: Sequence[int]) -> Column:
    return _runs(words, sizes, F.xxhash64)


def shingle_texts(words: Column, sizes: Sequence[int]) -> Column:
    return _runs(words, sizes, lambda *run: F.concat_ws(" ", *run))


def _sent(df: DataFrame, row_bytes: int, rows: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of each contaminated document and item.

    docs: doc_id, text; items: item_id, text.
    """
    scratch = Scratch(spark)
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    tests = tests.withColumn("item", F.xxhash64("item_id", "words"))
    size = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted({SHINGLE} | {r[0] for r in tests.select(size).distinct().collect()})  # of 1 to 5
    grams = [F.when(size == k, shingle_texts(F.col("words"), [k])) for k in sizes]
    tests = tests.dropDuplicates(["item"]).select("item", "item_id", size.alias("k"), F.explode(F.coalesce(*grams)).alias("gram"))
    # the hash of a gram is that of its words, as on the documents' side
    parts = F.split("gram", " ")
    hashes = [F.when(F.col("k") == k, F.xxhash64(*[F.get(parts, F.lit(j)) for j in range(k)])) for k in sizes]
    tests = tests.select("item", "item_id", "gram", F.coalesce(*hashes).alias("h"))
    whole = Window.partitionBy("item")
    tests = tests.withColumn("n", F.count("*").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy("h")))
    tests = scratch.table(tests.withColumn("band", F.floor(F.log2("n")).cast("int")))
    n_tests = tests.count()
    sketch = tests.where(F.expr(f"rank <= n - ceil({NUM} * n / {DEN}) + 1"))
    # at most 64 bands: the least size and the largest sketch hash of each
    bands = sketch.groupBy("band").agg(F.min("n").alias("least"), F.max("h").alias("top")).orderBy("band").collect()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not bands:
        return rows.limit(0).selectExpr("doc_id", "doc_id AS item_id", "0L AS n_item_shingles", "0L AS n_shared", "0.0D AS containment")
    found = rows.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words")).select("doc_id", "th", shingle_hashes(F.col("words"), sizes).alias("hs"))
    keep = lambda x: _any_band(x, F.size("hs"), bands)
    found = found.select("doc_id", "th", F.explode(F.filter("hs", keep)).alias("h"))
    found = found.join(_sent(sketch.select("h", "item"), 64, n_tests), "h").select("doc_id", "th", "item").distinct()
    found = scratch.table(found)
    n_found = found.count()
    marked = found.select("doc_id", "th").distinct()
    texts = rows.withColumn("th", F.xxhash64("text")).alias("r").join(_sent(marked, 64, n_found).alias("m"), F.expr("r.doc_id <=> m.doc_id AND r.th = m.th"), "left_semi")
    grams = texts.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", words_of(F.col("text")).alias("words")).select("doc_id", "th", F.explode(shingle_texts(F.col("words"), sizes)).alias("gram"))
    shared = grams.join(_sent(tests.select("gram", "item", "item_id", "n"), 200, n_tests), "gram").groupBy("doc_id", "th", "item", "item_id", "n").agg(F.count("*").alias("n_shared"))
    exact = shared.where(DEN * F.col("n_shared") >= NUM * F.col("n"))
    out = exact.alias("e").join(found.alias("f"), F.expr("e.doc_id <=> f.doc_id AND e.th = f.th AND e.item = f.item"), "left_semi")
    return out.selectExpr("doc_id", "item_id", "n AS n_item_shingles", "n_shared", "n_shared / CAST(n AS DOUBLE) AS containment")


def _any_band(x: Column, many: Column, bands: list) -> Column:
    """Whether hash x of a document of many shingles can be in a sketch of some band."""
    out = F.lit(False)
    for b in bands:
        out = out | ((many >= -(-NUM * b["least"] // DEN)) & (x <= b["top"]))
    return out
