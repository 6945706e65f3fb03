"""Queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillfold.llm.chat_format import format_chat, read_loss, read_turns
from quillfold.llm.decontaminate import contaminated
from quillfold.llm.language_id import language_id
from quillfold.llm.license_scan import COPYRIGHT_LINE, KNOWN, SPELLINGS, license_scan
from quillfold.llm.mixing import mix_sources
from quillfold.llm.ngram_join import ngram_jaccard
from quillfold.llm.quality_rules import FLOOR, LEAST_KEPT, LIMIT, SHARE, quality_rules
from quillfold.llm.scratch import Scratch
from quillfold.llm.substring_dedup import substring_dedup
from quillfold.llm.url_filter import BLOCKED_DOMAINS, BLOCKED_NAMES, judge_urls
from quillfold.llm.warc import read_pages, write_archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark, _table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, _table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license_id", F.array_join("notice_ids", ",").alias("notices"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = format_chat(turns).select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, _table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, _table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, _table(spark, sf_dir, "documents")).drop("kept_text", "carried")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, _table(spark, sf_dir, "documents"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    path = Scratch(spark).root
    write_archive(spark, pages, path)
    return read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_chat_format": op4_chat_format,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_mix_sources": op9_mix_sources,
    "op10_warc_archive": op10_warc_archive,
    "pipeline": corpus_pipeline.run,
}

_SITES = ", ".join(f"('{n}.{d}')" for n in BLOCKED_NAMES for d in BLOCKED_DOMAINS)

OP6_SQL = f"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p),
b AS (SELECT * FROM (VALUES {_SITES}) AS t(site)),
l AS (
  SELECT r.*, CASE WHEN rule IS NULL THEN
    (SELECT max(site) FROM b WHERE regexp_replace(r.host, '(:[0-9]*)?$', '') = site OR ends_with(regexp_replace(r.host, '(:[0-9]*)?$', ''), '.' || site)) END AS listed_url
  FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed_url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed_url
FROM l
"""



def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    t = f"lower({text})"
    t = f"regexp_replace({t}, {_q(COPYRIGHT_LINE)}, '', 'g')"
    t = rf"regexp_replace({t}, '(?m)^[^\p{{L}}\n]*all rights reserved[^\n]*$', '', 'g')"
    t = rf"(' ' || regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ')"
    for old, new in SPELLINGS:
        t = f"replace({t}, ' {old} ', ' {new} ')"
    return f"nullif(trim(regexp_replace({t}, ' +', ' ', 'g'), ' '), '')"


_KNOWN_SQL = ", ".join(f"({_q(i)}, {_q(t)})" for i, t in KNOWN)

OP3_SQL = f"""
WITH known AS (
  SELECT sha256(c) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_canonical_sql("text")} AS c FROM (VALUES {_KNOWN_SQL}) AS t(license_id, text)) WHERE c IS NOT NULL GROUP BY 1),
notices AS (
  SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM (
    SELECT DISTINCT doc_id, license_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l
    JOIN known k ON sha256({_canonical_sql("line")}) = k.digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') AS notices
FROM (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents) d
LEFT JOIN known k ON d.digest = k.digest LEFT JOIN notices n ON d.doc_id = n.doc_id
"""

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t-\r]+') AS w FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
twice AS (SELECT t.doc_id, t.i FROM tri t JOIN (SELECT doc_id, g FROM tri GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS t(o) GROUP BY 1),
lines AS (
  SELECT doc_id, source, line, regexp_replace(regexp_replace(lower(line), '\p{{Nd}}', '0', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g') AS norm, len(regexp_extract_all(line, '[^ \t-\r]+')) AS words
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t-\r]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY 1),
frequent AS (
  SELECT l.source, norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > least({LIMIT}, greatest({FLOOR}, {SHARE} * max(h.docs)))),
gone AS (SELECT doc_id, sum(words) AS n FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY 1),
base AS (
  SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM d JOIN w ON d.doc_id = w.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CAST(n_words - gone AS BIGINT) AS n_kept_words,
       NOT base_failed AND n_words - gone >= {LEAST_KEPT} * n_words AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
"""

OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t-\r]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^ \t-\r]+') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM ik)),
ks AS (SELECT DISTINCT k FROM ik),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1)
SELECT doc_id, ig.item_id, max(n.n) AS n_item_shingles, count(*) AS n_shared, count(*) / CAST(max(n.n) AS DOUBLE) AS containment
FROM dg JOIN ig ON dg.g = ig.g JOIN n ON n.item_id = ig.item_id
GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * max(n.n)
"""

ORACLES: dict[str, str] = {
    "op3_license_scan": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op6_url_filter": OP6_SQL,
}
