"""The corpus pipeline: documents to a mixed, clean training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.decontaminate import contaminated
from quillfold.llm.language_id import UNKNOWN, identify, language_id, learn_from
from quillfold.llm.mixing import mix_sources
from quillfold.llm.ngram_join import ngram_jaccard
from quillfold.llm.scratch import Scratch
from quillfold.llm.substring_dedup import substring_dedup

#: A document whose best language has less than this part of its n-grams is rejected.
LEAST_SCORE = 0.3


def _rows(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a key _row of each row's own, and whether that is not doc_id.

    With a null or repeated doc_id rows are numbered, in a written table so that numbers stay.
    """
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        return docs.withColumn("_row", F.col("doc_id")), False
    return Scratch(spark).table(docs.withColumn("_row", F.monotonically_increasing_id())), True


def _as_docs(rows: DataFrame) -> DataFrame:
    """Rows with their key for a doc_id, so that operators judge each row."""
    return rows.drop("doc_id").withColumnRenamed("_row", "doc_id")


def _without(rows: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows joined with a table of keys, the key dropped."""
    return rows.join(gone.select(F.col("doc_id").alias("_row")), "_row", how).drop("_row")


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an unknown language go; the rest keep their columns."""
    rows, own = _rows(spark, docs)
    if own:  # learning goes by doc_id as in language_id, judging by row
        texts = _as_docs(rows).select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
        judged = identify(spark, texts, learn_from(spark, docs))
    else:
        judged = language_id(spark, docs)
    judged = judged.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SCORE))
    return _without(rows, Scratch(spark).table(judged.select("doc_id"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, copies included, the one with the least id stays.

    Where several have that id, or none has an id, one row of them stays. Documents without
    words are linked with nothing and stay.
    """
    rows, own = _rows(spark, docs)
    judged = ngram_jaccard(spark, _as_docs(rows))
    if not own:
        kept = judged.where("doc_id = component_id")
        return _without(rows, kept, "left_semi").select(docs.columns)
    ids = rows.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("id"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("least")
    kept = judged.join(ids, "doc_id").groupBy("component_id").agg(least).select("least.doc_id")
    return _without(rows, kept, "left_semi").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document that loses words keeps the rest, joined by spaces."""
    out = substring_dedup(spark, docs, [c for c in docs.columns if c != "text"])
    cut = F.col("n_removed") > 0
    # a document of which nothing is left goes
    out = out.where(~(cut & (F.col("kept_text") == "")))
    size = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))
    own = {"text": F.col("kept_text").alias("text"), "n_chars": size.alias("n_chars")}
    return out.select(*[own.get(c, F.col(f"carried.{c}").alias(c)) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, _ = _rows(spark, docs)
    found = Scratch(spark).table(contaminated(spark, _as_docs(rows), items).select("doc_id").distinct())
    return _without(rows, found).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order: one row each time one is taken."""
    return mix_sources(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", detect_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]

#: No SQL: learning a filter (stage 1) and bisection (stage 5) are beyond it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
