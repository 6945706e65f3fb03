"""URL filtering by host and path rules and by a list of blocked canonical URLs.

Rules come first: the longest rule that fits decides. Other URLs are looked up in the
list: each URL has a few lookup keys (its canonical form, its host and parent domains,
each with its path's first levels, as many as the list's deepest entry has), a blocked
Bloom filter of the list passes the keys that may be listed, and an exact hash join with
the list drops the false positives.

The filter is a table of blocks (one cache line of 512 bits for each key), built by
bitwise aggregates. Within FILTER_BYTES it goes to the tasks that read the pages, so that
nothing but possible hits is shuffled; a larger one stays a table, and keys meet their
block by a join.

Canonical form: scheme, user and default port dropped, host lower-cased without a
leading `www.` or a trailing dot, path without a trailing `/`, fragment and `utm_*`
parameters dropped. A listed host covers its subdomains, on any port; a listed path the
paths below it; a listed query only itself.

Cases: null url or no `://`: host and path are empty, no rule fits, allow. An empty list
blocks nothing. Null or repeated ids and repeated urls: each row is returned. Very long
urls: as many keys as the list is deep. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.scratch import BROADCAST_BYTES, Scratch

ALLOW, BLOCK = "allow", "block"
#: Bits of one listed key in the filter, its block in bits and in words, and bits that a key sets.
BITS_PER_KEY, BLOCK_BITS, CELLS, PROBES = 16, 512, 8, 6
#: A filter up to this size is sent to the tasks.
FILTER_BYTES = 32 << 20

# Rules of the query: fixed values (verdict, host, path).
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))

# The default list of blocked sites: fixed values, every name under every domain.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_DOMAINS = ("example.com", "example.net", "example.org")
BLOCKED_URLS = tuple(f"{name}.{domain}" for name in BLOCKED_NAMES for domain in BLOCKED_DOMAINS)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, else null; ties: the later one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """host/path?query of a URL with a scheme, in canonical form; listed URLs may omit the scheme."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.|\.$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def with_lookups(rows: DataFrame, open_: Column, levels: int) -> DataFrame:
    """Adds `entries` to rows with url: keys under which a listed URL covers this one.

    Its canonical form, with and without query, and host suffixes x path prefixes; none
    where open_ is false. Each part is a column, so that it is computed once a row.
    """
    c = F.when(open_, canonical(F.col("url")))
    out = rows.withColumn("_c", c).withColumn("_bare", F.split_part("_c", F.lit("?"), F.lit(1)))
    out = out.withColumn("_host", F.split_part("_bare", F.lit("/"), F.lit(1)))
    out = out.withColumn("_labels", F.split(F.regexp_replace("_host", r":\d*$", ""), r"\."))
    out = out.withColumn("_parts", F.split(F.substring("_bare", F.length("_host") + 2, F.length("_bare")), "/", levels + 2 if levels else 1))
    n = F.size("_labels")
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice("_labels", i, n), "."))
    join = lambda i: F.concat(F.when(i > 0, F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice("_parts", 1, i), "/"))
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size("_parts"), F.lit(levels))), join)
    out = out.withColumn("_hosts", hosts).withColumn("_paths", paths)
    spans = F.flatten(F.transform("_hosts", lambda h: F.transform("_paths", lambda p: F.concat(h, p)))) if levels else F.col("_hosts")
    entries = F.coalesce(F.array_distinct(F.concat(F.array("_c", "_bare"), spans)), F.array().cast("array<string>"))
    return out.withColumn("entries", entries).drop("_c", "_bare", "_host", "_labels", "_parts", "_hosts", "_paths")


def _bits(k: Column) -> list[tuple[Column, Column]]:
    """(word within its block, bit) of each of a key's bits."""
    spread = F.xxhash64(k)
    at = [F.shiftrightunsigned(spread, 9 * j).bitwiseAND(BLOCK_BITS - 1) for j in range(PROBES)]
    return [(F.shiftright(a, 6), F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(63).cast("int"))) for a in at]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7): the filter of keys k, its empty blocks left out."""
    bits = _bits(F.col("k"))

    def word(c: int) -> Column:
        out = F.lit(0).cast("long")
        for cell, bit in bits:
            out = out.bitwiseOR(F.when(cell == c, bit).otherwise(F.lit(0).cast("long")))
        return F.bit_or(out).alias(f"w{c}")

    return listed.groupBy(F.pmod("k", F.lit(blocks)).alias("block")).agg(*[word(c) for c in range(CELLS)])


def _fits(words: Column) -> Column:
    """Whether a block's words (array) have all bits of k."""
    out = F.lit(True)
    for cell, bit in _bits(F.col("k")):
        out = out & (F.get(words, cell.cast("int")).bitwiseAND(bit) != 0)
    return out


def _possible(held, blocks: int):
    """Scan side: the places of the keys that may be listed, by the filter sent along.

    Rows end with block array<long>, cell and bit arrays of PROBES entries a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((blocks, CELLS), np.uint64)
        at, filled = held.value
        words[at] = filled
        for batch in batches:
            keys, spread = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            first = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            block = keys.flatten().to_numpy(zero_copy_only=False)
            spread = spread.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.ones(len(block), bool)
            for j in range(PROBES):
                bit = (spread >> np.uint64(9 * j)) & np.uint64(BLOCK_BITS - 1)
                hit &= (words[block, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
            place = np.arange(len(block)) - np.repeat(first[:-1], np.diff(first))
            offsets = np.r_[0, np.cumsum(hit)][first].astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[hit].astype(np.int32)))
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*batch.schema.names[:-2], "at"])

    return run


def judge_urls(spark: SparkSession, pages: DataFrame, listed: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed_url) for each row of pages (page_id, url).

    listed: blocked URLs, a table with a column url (default BLOCKED_URLS).
    """
    scratch = Scratch(spark)
    if listed is None:
        listed = spark.createDataFrame([(u,) for u in BLOCKED_URLS], "url string")
    listed = listed.where("url IS NOT NULL").select(canonical(F.col("url")).alias("entry")).where("entry <> ''").distinct()
    listed = scratch.table(listed.withColumn("k", F.xxhash64("entry")))
    depth = F.size(F.split(F.split_part("entry", F.lit("?"), F.lit(1)), "/")) - 1
    n, levels, longest = listed.agg(F.count("*"), F.max(depth), F.max(F.octet_length("entry"))).first()
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", "fit.verdict", "url")
    if not n:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("string").alias("listed_url"))
    if n * (longest + 64) <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    open_ = F.col("rule").isNull() & (F.col("host") != "")
    rows = with_lookups(rows, open_, levels)
    if blocks * BLOCK_BITS // 8 <= FILTER_BYTES:
        got = bloom_blocks(listed, blocks).toPandas()  # at most FILTER_BYTES
        held = spark.sparkContext.broadcast((got["block"].to_numpy(np.int64), got[[f"w{c}" for c in range(CELLS)]].to_numpy(np.int64).view(np.uint64)))
        probed = rows.withColumn("k", F.transform("entries", lambda e: F.xxhash64(e))).drop("entries").select("*", F.transform("k", lambda k: F.pmod(k, F.lit(blocks))).alias("block"), F.transform("k", lambda k: F.xxhash64(k)).alias("spread")).drop("k")
        schema = "page_id long, host string, path string, rule string, verdict string, url string, at array<int>"
        seen = probed.mapInArrow(_possible(held, blocks), schema)
        seen = scratch.table(seen.withColumn("row", F.monotonically_increasing_id()))
        possible = with_lookups(seen.where(F.size("at") > 0).select("row", "url", "at"), F.lit(True), levels).select("row", F.explode("at").alias("i"), "entries").select("row", F.get("entries", F.col("i")).alias("entry"))
        free, seen = seen.where(F.size("at") == 0), seen.where(F.size("at") > 0)
    else:
        seen = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()))
        possible = seen.select("row", F.explode("entries").alias("entry")).withColumn("k", F.xxhash64("entry"))
        table = bloom_blocks(listed, blocks).select("block", F.array(*[f"w{c}" for c in range(CELLS)]).alias("words"))
        possible = possible.withColumn("block", F.pmod("k", F.lit(blocks))).join(table, "block").where(_fits(F.col("words"))).select("row", "entry")
        free = seen.limit(0)
    # exact: false positives go
    hits = possible.withColumn("k", F.xxhash64("entry")).join(listed, ["k", "entry"]).groupBy("row").agg(F.max_by("entry", F.struct(F.length("entry"), "entry")).alias("listed_url"))
    out = seen.join(hits, "row", "left").unionByName(free.withColumn("listed_url", F.lit(None).cast("string")), allowMissingColumns=True)
    verdict = F.coalesce("verdict", F.when(F.col("listed_url").isNotNull(), F.lit(BLOCK)), F.lit(ALLOW))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed_url")
