"""Licence detection by digests of canonical texts.

A text is made canonical - lower case, copyright lines dropped, equivalent spellings
unified, punctuation and spacing folded - and its SHA-256 looked up among those of known
licences, which are made canonical by the same expression. Whole texts are joined, and
each line on its own with the known notices that fit in a line.

Built-in expressions only. The known digests are broadcast behind a check of their size;
the lookup of whole texts then adds no shuffle. Lines are looked up only if they begin as
some known text can begin, which loses none.

Cases: null text, or nothing left of it: no digest, no licence. Null doc_id and repeated
rows: each row is returned. Two known texts with one canonical form: the id that sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.scratch import BROADCAST_BYTES, Scratch

# Equivalent spellings, as whole words after folding: fixed values (from, to).
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("version", "v"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("https", "http"),
)

#: A line that says who holds the copyright, or since when. Prose on copyright and an item (c) are no such lines.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n]*(copyright[ \t]*(\(c\)|©)|((copyright|\(c\)|©)[ \t:,<\[{]*)+(\d{4}|yyyy|year))[^\n]*$"

# Full texts, one file each, under their identifiers: fixed values. A first paragraph of a
# few words is a title that copies may leave out.
FOLDER = Path(__file__).resolve().parent / "licenses"

# Usual notices: fixed values (id, text).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
)


def _full_texts() -> Iterator[tuple[str, str]]:
    for file in sorted(FOLDER.glob("*.txt")):
        text = file.read_text("utf-8")
        title, _, rest = text.partition("\n\n")
        yield file.stem, text
        if len(title.split()) <= 9:
            yield file.stem, rest


def _known() -> tuple[tuple[str, str], ...]:
    texts = (*_full_texts(), *NOTICES)
    return (*texts, *((i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, _ in texts})))


#: (id, text) of all known texts.
KNOWN = _known()
#: More first words of known texts than this aren't looked for; all lines then get a digest.
FIRST_WORDS = 500


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _if_any(text: Column, words: Sequence[str], change: Callable[[Column], Column]) -> Column:
    """change(text) where one of the words is in it: looking for a plain word costs far less than a pattern."""

    def body(t: Column) -> Column:
        some = F.lit(False)
        for w in words:
            some = some | F.contains(t, F.lit(w))
        return F.when(some, change(t)).otherwise(t)

    return _let(text, body)


def canonical(text: Column) -> Column:
    """Canonical form of a licence text or notice; null stays null."""
    t = _if_any(F.lower(text), ("copyright", "(c)", "©"), lambda t: F.regexp_replace(t, COPYRIGHT_LINE, ""))
    t = _if_any(t, ("all rights reserved",), lambda t: F.regexp_replace(t, r"(?m)^[^\p{L}\n]*all rights reserved[^\n]*$", ""))
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        t = _if_any(t, (f" {old} ",), lambda t, old=old, new=new: F.replace(t, F.lit(f" {old} "), F.lit(f" {new} ")))
    return F.trim(t)


def digest(text: Column) -> Column:
    return _let(canonical(text), lambda form: F.when(form != "", F.sha2(form, 256)))


def first_words(known: DataFrame) -> str | None:
    """A pattern that any line has whose canonical form is a known one: how it can begin."""
    first = F.split_part(canonical(F.col("text")), F.lit(" "), F.lit(1)).alias("w")
    words = {r["w"] for r in known.select(first).where("w <> ''").distinct().limit(FIRST_WORDS + 1).collect()}
    if len(words) > FIRST_WORDS:
        return None
    while more := {old.split()[0] for old, new in SPELLINGS if new.split()[0] in words} - words:
        words |= more
    return r"(?iu)^[^\p{L}\p{N}]*(?:" + "|".join(sorted(words)) + r")(?![\p{L}\p{N}])"


def license_scan(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id, notice_ids) for each row of docs (doc_id, text).

    license_id: the licence that the whole text is, else null; notice_ids: the licences
    whose notices are lines of it, sorted. known: (license_id, text), KNOWN by default.
    """
    known = spark.createDataFrame(list(KNOWN), "license_id string, text string") if known is None else known
    notice_start = first_words(known)
    known = known.select(digest(F.col("text")).alias("digest"), "license_id").where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    known = Scratch(spark).table(known)
    if known.count() * 200 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text").alias("th")
    lines = F.split("text", "\n")
    candidates = F.array_distinct(lines if notice_start is None else F.filter(lines, lambda x: F.rlike(x, F.lit(notice_start))))
    lines = rows.select("doc_id", key, F.explode(candidates).alias("line")).select("doc_id", "th", digest(F.col("line")).alias("digest"))
    notices = lines.join(known, "digest").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("license_id")).alias("notice_ids"))
    whole = rows.select("doc_id", key, digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    out = whole.alias("w").join(notices.alias("n"), F.expr("w.doc_id <=> n.doc_id AND w.th = n.th"), "left")
    return out.select("w.doc_id", "digest", "license_id", F.coalesce("notice_ids", F.array().cast("array<string>")).alias("notice_ids"))
