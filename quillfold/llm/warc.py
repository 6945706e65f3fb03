"""Content-addressed WARC archive.

Writing stores two tables in a folder: `payloads` holds every distinct payload once, under
its SHA-256, and `records` the exact header of each WARC/1.1 record with that digest.
The payload with the least id keeps a `response` record; equal payloads from `least`
bytes on become `revisit` records that refer to it.

Reading joins them: original records are header + payload + CRLF CRLF, and a record is
taken apart again by its own bytes alone. `sound` tells whether a stored payload still has
the digest that it is stored under; unsound records are returned, not dropped.

Both tables are bucketed by digest, so that payloads meet their headers without another
shuffle in the session that wrote them (elsewhere they are read as plain folders). Equal
payloads meet by digest alone: their least row is aggregated before the shuffle, and
digests of more than HOT rows are looked up in a broadcast table, which has at most one
row for each HOT rows of the input.

Cases: null payload: empty. Null url: no target line, read back as null. A url with CR or
LF: written with %, CR and LF as %25, %0D and %0A under a mark, and read back as it was.
Null id: a record of its own, never the one that others refer to unless no copy has an id.
Repeated ids: a record each; an exact copy of the response's row is a revisit. No rows:
empty tables. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.scratch import Scratch, partitions

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Date of records whose pages have none: a fixed value, so that archives are reproducible.
DATE = "2024-01-01T00:00:00Z"
#: Rows of one digest from which it counts as hot.
HOT = 1_000_000
# Characters that can't stand in a header line, and how they are written there: fixed values.
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
TARGET, ESCAPED = "WARC-Target-URI", "X-Target-URI-Escaped"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are 32 digits, 5 hex digits make 4."""
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.sha1(payload), i * 5 + 1, F.lit(5)), 16, 10).cast("int"))

    def digits(v: Column) -> Column:
        digit = lambda shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
        return F.concat(digit(15), digit(10), digit(5), digit(0))

    return F.array_join(F.transform(five, digits), "")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _target(url: Column) -> Column:
    """The lines of a url: none if it is null."""
    coded = url
    for plain, code in ESCAPES:
        coded = F.replace(coded, F.lit(plain), F.lit(code))
    odd = F.rlike(url, F.lit(r"[\r\n]"))
    return F.when(odd, F.concat(_line(TARGET, coded), _line(ESCAPED, F.lit("1")))).when(url.isNotNull(), _line(TARGET, url)).otherwise(F.lit(""))


def _bucketed(spark: SparkSession, df: DataFrame, path: str, buckets: int) -> None:
    table = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    writer = df.repartition(buckets, "digest").write.mode("overwrite").option("compression", "zstd")
    writer.bucketBy(buckets, "digest").sortBy("digest").option("path", path).saveAsTable(table)


def _name(path: str) -> str:
    return f"quillfold_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(_name(path)) if spark.catalog.tableExists(_name(path)) else spark.read.parquet(path)


def _by_digest(rows: DataFrame, facts: DataFrame, copies: str = "copies", hot: int | None = None) -> DataFrame:
    """rows with the facts of their digest; facts: one row a digest, with its number of rows."""
    hot = HOT if hot is None else hot
    many = F.broadcast(facts.where(F.col(copies) > hot))
    few = facts.where(F.col(copies) <= hot)
    listed = many.select("digest")
    return rows.join(many, "digest").unionByName(rows.join(F.broadcast(listed), "digest", "left_anti").join(few, "digest"))


def write_archive(spark: SparkSession, pages: DataFrame, path: str, least: int = 0) -> None:
    """Write pages (page_id, url, payload binary) to the folder path."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    scratch = Scratch(spark)
    row = scratch.table(pages.select("page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")))
    buckets = partitions(spark)  # those of the aggregate by digest, so that payloads are shuffled once
    _bucketed(spark, pages.groupBy("digest").agg(F.first("payload").alias("payload")), f"{path}/payloads", buckets)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"), "row")
    first = row.groupBy("digest").agg(F.min(order).alias("lead"), F.count("*").alias("copies")).select("digest", "copies", F.col("lead.page_id").alias("first_id"), F.col("lead.row").alias("lead"))
    row = _by_digest(row, scratch.table(first))
    revisit = (F.col("row") != F.col("lead")) & (F.col("bytes") >= least)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _target(F.col("url")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", name(F.col("first_id"))))).otherwise(F.lit("")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    records = row.select("digest", header.cast("binary").alias("header"))
    _bucketed(spark, records, f"{path}/records", buckets)


def _field(header: Column, name: str) -> Column:
    """The value of a header line, null without one."""
    return F.when(F.rlike(header, F.lit(rf"\r\n{name}: ")), F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1))


def _parsed(head: Column) -> list[Column]:
    number = lambda name: F.regexp_extract(F.coalesce(_field(head, name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    plain = _field(head, TARGET)
    for char, code in reversed(ESCAPES):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return [
        number("WARC-Record-ID").alias("page_id"),
        F.when(_field(head, ESCAPED).isNotNull(), plain).otherwise(_field(head, TARGET)).alias("url"),
        _field(head, "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
    ]


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Every stored payload once: (digest, payload_bytes, payload_digest, sound)."""
    return _stored(spark, f"{path}/payloads").select(
        "digest",
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("digest")).alias("sound"),
    )


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, header, page_id, url, record_type, refers_to, stated_digest) of each record."""
    return _stored(spark, f"{path}/records").select("digest", "header", *_parsed(F.col("header").cast("string")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(digest, record_type, record binary, sound): the original records, in no order.

    A response holds its payload, by a join of 1:1 or, of small payloads, of many responses;
    a revisit ends after its header.
    """
    heads = _stored(spark, f"{path}/records").withColumn("record_type", _field(F.col("header").cast("string"), "WARC-Type"))
    end = F.lit((CRLF * 2).encode())
    store = _stored(spark, f"{path}/payloads")
    full = heads.where("record_type = 'response'").join(store, "digest", "left")
    full = full.select("digest", "record_type", F.concat("header", F.coalesce("payload", F.lit(b"")), end).alias("record"), F.coalesce(F.sha2("payload", 256) == F.col("digest"), F.lit(False)).alias("sound"))
    return full.unionByName(heads.where("record_type = 'revisit'").select("digest", "record_type", F.concat("header", end).alias("record"), F.lit(True).alias("sound")))


def parse_records(records: DataFrame) -> DataFrame:
    """Takes records apart by their bytes: adds page_id, url, refers_to, stated_digest, payload."""
    # in Latin-1 a character is a byte
    size = F.position(F.lit(CRLF * 2), F.decode("record", "ISO-8859-1")) + 3
    out = records.withColumn("_size", size.cast("int"))
    payload = F.substring(F.col("record"), F.col("_size") + 1, F.length("record") - F.col("_size") - 4)
    out = out.withColumn("_head", F.decode(F.substring(F.col("record"), F.lit(1), F.col("_size")), "UTF-8"))
    fields = [c for c, name in zip(_parsed(F.col("_head")), ("page_id", "url", "record_type", "refers_to", "stated_digest"), strict=True) if name != "record_type"]
    return out.select(*records.columns, *fields, payload.alias("payload"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, sound.

    Bytes and digest are those of the payload in the record itself; a revisit has those of
    the response whose payload it shares.
    """
    rec = parse_records(read_records(spark, path))
    own = rec.where("record_type = 'response'").select(
        "digest",
        "page_id",
        "url",
        "record_type",
        "refers_to",
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "stated_digest",
        "sound",
    )
    own = Scratch(spark).table(own.withColumn("sound", F.col("sound") & (F.col("payload_digest") == F.col("stated_digest"))))
    again = rec.where("record_type = 'revisit'").select("digest", "page_id", "url", "record_type", "refers_to")
    facts = own.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"), F.first("sound").alias("sound"))
    counts = again.groupBy("digest").agg(F.count("*").alias("copies"))
    again = _by_digest(again, facts.join(counts, "digest"))
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "sound"]
    return own.select(*columns).unionByName(again.select(*columns))
