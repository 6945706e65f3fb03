"""Document quality: base statistics, and line frequency across the documents of a host.

Lines are normalised (A-Z lower-cased, digits as 0, other characters than letters and
digits dropped) and hashed with their host. A line that more distinct documents of one
host hold than its limit is removed; a document that keeps less than `least_kept` of its
words is rejected. The limit is `share` of the host's documents, at least `floor` and at
most `limit`: a small host has a limit of its size, and none loosens as a host grows.

Built-in expressions only. One scan of the texts gives base columns and line hashes, which
are written; the rest reads those. Counting pre-aggregates (host, line) before its
shuffle, so a host with any part of the rows is counted in as many tasks as read it; only
frequent lines come back, broadcast behind a check of their size. Past that size they are
joined, each line's rows dealt over as many parts as its documents ask for.

Cases: null or empty text: no words, base_failed. Null host: a host of its own. Null
doc_id: judged like any other. Repeated rows: each is returned, and they count as
documents of their own in line counts. Lines of symbols alone all count as one empty line.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.scratch import BROADCAST_BYTES, Scratch

#: A line may be in this share of a host's documents, between FLOOR and LIMIT of them.
FLOOR, SHARE, LIMIT = 4, 0.05, 50
#: Part of its words that a document must keep.
LEAST_KEPT = 0.5
#: Rows of one line that one task joins, where frequent lines are too many to broadcast.
DEALT = 1_000_000

SPACE = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]")))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}", "0"), r"[^\p{L}\p{N}]+", "")


def _repeated_starts(hashes: Column) -> Column:
    """The places, in order, of values that an array holds more than once."""
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, x, i: F.coalesce(F.get(a, i)["h"] == x["h"], F.lit(False))
    twice = F.transform(F.array(by_hash), lambda a: F.transform(F.filter(a, lambda x, i: same(a, x, i - 1) | same(a, x, i + 1)), lambda x: x["i"]))[0]
    # most texts have none, which costs no sort
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<int>")).otherwise(F.sort_array(twice))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with text -> further columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", lines_of(F.col("text")))
    n = F.size("_words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    out = out.withColumn("_starts", _repeated_starts(F.col("_windows")))
    step = F.transform("_starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - s, F.lit(3))))
    out = out.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(step, F.lit(0), lambda s, x: s + x).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def quality_rules(
    spark: SparkSession, docs: DataFrame, host: str = "source", floor: int = FLOOR, share: float = SHARE, limit: int = LIMIT, least_kept: float = LEAST_KEPT, broadcast: int = BROADCAST_BYTES
) -> DataFrame:
    """A row for each of docs (doc_id, text, host): the base columns, n_kept_words, kept."""
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    line = lambda x: F.struct(F.xxhash64(F.col("host"), normalised(x)).alias("line"), F.size(words_of(x)).alias("words"))
    rows = base_rules(rows.withColumn("lines", F.transform(lines_of(F.col("text")), line))).drop("text")
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()))
    held = rows.select(F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"), "host")
    count = held.groupBy("line").agg(F.count("*").alias("docs"), F.first("host").alias("host")).where(F.col("docs") > floor)
    hosts = rows.groupBy("host").agg(F.least(F.lit(float(limit)), F.greatest(F.lit(float(floor)), share * F.count("*"))).alias("most"))
    frequent = count.alias("c").join(hosts.alias("h"), F.expr("c.host <=> h.host")).where(F.col("docs") > F.col("most"))
    frequent = scratch.table(frequent.select("line", "docs"))
    lines = rows.select("row", F.posexplode("lines").alias("pos", "x")).select("row", "pos", "x.line", "x.words")
    if frequent.count() * 64 <= broadcast:
        gone = lines.join(F.broadcast(frequent.select("line")), "line")
    else:  # a line of many rows is met by each of its parts; which of them a row goes to is its hash
        most = frequent.agg(F.max("docs")).first()[0]
        parts = lambda n: F.ceil(n / DEALT)
        dealt = frequent.select("line", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("docs")) - 1)).alias("part"), parts(F.col("docs")).alias("parts"))
        hot = F.broadcast(frequent.where(F.col("docs") > DEALT).select("line", parts(F.col("docs")).alias("parts")))  # one row for each DEALT rows at most
        lines = lines.join(hot, "line", "left") if most > DEALT else lines.withColumn("parts", F.lit(1).cast("long"))
        lines = lines.withColumn("part", F.pmod(F.xxhash64("row", "pos"), F.coalesce("parts", F.lit(1).cast("long"))))
        gone = lines.drop("parts").join(dealt.drop("parts"), ["line", "part"])
    gone = gone.groupBy("row").agg(F.sum("words").alias("gone"))
    out = rows.drop("lines").join(gone, "row", "left")
    kept = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        kept.alias("n_kept_words"),
        (~F.col("base_failed") & (kept >= least_kept * F.col("n_words"))).alias("kept"),
    )
