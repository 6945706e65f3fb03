"""Language identification by n-gram filters with a language bitmask.

A bit-sliced Bloom filter is a table of slots, each an integer with one bit per language
(as many 64-bit words as the languages need). An n-gram of four characters sets its languages' bits in three slots; the AND of those
slots names, for one n-gram, every language that contains it. Per document and language
the hits are counted (a popcount over the document's n-grams), corrected for the filter's
false positives, and the language with most decides.

Learning reads text and lang of a bounded sample of labelled rows (SAMPLE texts a
language, drawn by a hash of the id); prediction reads whole texts of all rows.

Cases: null text, or no letters: `und`, score 0. No labelled rows: `und` throughout. Null
doc_id: predicted like any other. Ties: the language that sorts first. Repeated rows:
each is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm import words as W
from quillfold.llm.scratch import Scratch

#: Labelled texts a language that learning may read.
SAMPLE = 3000
#: More distinct labels than this are no languages: an error.
MOST_LABELS = 20_000
#: An n-gram belongs to a language from this share of its n-grams: at most 1 / LEAST_RATE of them.
LEAST_RATE = 2e-5
#: ... and from this part of its greatest rate in any language.
LEAST_PART = 0.25
UNKNOWN = "und"

_BMP = 1 << 16


def _letters() -> np.ndarray:
    """Lower-cased letter of each code point up to 2**16, a space for anything else."""
    out = np.full(_BMP, 32, np.uint32)
    for c in range(_BMP):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram hashes of all texts, index of each text's first, whether it has letters)."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts])
    first = np.r_[0, np.cumsum(size + 1)[:-1]]
    low = _TABLE[0][np.minimum(points, _BMP - 1)]
    for c in np.unique(points[points >= _BMP]).tolist():  # few texts have any
        if chr(c).isalpha():
            low[points == c] = ord(chr(c).lower()[0])
    text = np.repeat(np.arange(len(texts)), size + 1)[: len(points)]
    letter = low != 32
    has = np.bincount(text[letter], minlength=len(texts)) > 0
    keep = letter | np.r_[True, letter[:-1]]  # one space for any run of others
    if len(first) > 1:
        keep[first[1:] - 1] = True
    low, text = low[keep], text[keep]
    pad = low.astype(W.U)
    if len(pad) < 4:
        return np.zeros(0, W.U), np.zeros(len(texts) + 1, np.int64), has
    key = W.mix(((pad[:-3] * W.U(0x110000) + pad[1:-2]) * W.U(0x110000) + pad[2:-1]) * W.U(0x10FFFF) + pad[3:] * W.U(0x9E3779B97F4A7C15))
    inside = text[:-3] == text[3:]
    return key[inside], np.searchsorted(text[:-3][inside], np.arange(len(texts) + 1)), has


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < W.SLICE // 2):
            size += len(texts[to] or "")
            to += 1
        yield at, to, [t or "" for t in texts[at:to]]
        at = to


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for at, to, texts in _parts(batch.column(1).to_pylist()):
            key, first, _ = _grams(texts)
            lang = langs[at:to]
            for name in sorted(set(lang.tolist())):
                own = np.repeat(lang == name, np.diff(first))
                u, c = np.unique(key[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(W.signed(u)), pa.array(c.astype(np.int64))], names=["lang", "gram", "c"])


@dataclass(frozen=True)
class LanguageFilter:
    """The bit-sliced filter: slots, languages by bit, and each one's false positive rate."""

    names: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def places(key: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = W.U(m - 1)
        return key & mask, (key >> W.U(20)) & mask, (key >> W.U(40)) & mask

    @classmethod
    def build(cls, names: list[str], grams: list[np.ndarray]) -> LanguageFilter:
        kind = next((t for t, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(names) <= b), np.uint64)
        m = 1 << 12
        while m < min(1 << 20, 10 * max([1, *map(len, grams)])):
            m *= 2
        slots = np.zeros((max(1, -(-len(names) // 64)), m), kind)
        fill = np.zeros(len(names))
        for i, key in enumerate(grams):
            word, bit = divmod(i, 64)
            for p in cls.places(key, m):
                slots[word][p] |= kind(1 << bit)
            fill[i] = ((slots[word] >> kind(bit)) & kind(1)).mean()
        return cls(tuple(names), slots, fill**3)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        key, first, has = _grams(texts)
        a, b, c = self.places(key, self.slots.shape[1])
        n = np.diff(first)
        best = np.full(len(texts), -np.inf)
        pick = np.zeros(len(texts), int)
        for word, slots in enumerate(self.slots):
            hit = slots[a] & slots[b] & slots[c]
            for i in range(64 * word, min(64 * word + 64, len(self.names))):
                bit = hit.dtype.type(i - 64 * word)
                sums = np.r_[0, np.cumsum((hit >> bit) & hit.dtype.type(1), dtype=np.int64)]
                f = self.false_rate[i]
                count = (sums[first[1:]] - sums[first[:-1]] - n * f) / max(1e-9, 1 - f)
                pick[count > best] = i
                best = np.maximum(best, count)
        share = np.clip(best / np.maximum(n, 1), 0.0, 1.0)
        ok = has & (len(self.names) > 0)
        return [self.names[p] if o else UNKNOWN for p, o in zip(pick, ok, strict=True)], np.where(ok, share, 0.0).tolist()


def learn(spark: SparkSession, labelled: DataFrame, sample: int = SAMPLE) -> LanguageFilter:
    """Learn from (doc_id, text, lang) rows; those with a null text or lang are left out.

    At most about ``sample`` texts of each language are read; what comes to the driver is
    at most 1 / LEAST_RATE n-grams a language, of MOST_LABELS languages at most.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    seen = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(seen) > MOST_LABELS:
        raise ValueError(f"lang has more than {MOST_LABELS} distinct values")
    names = sorted(r["lang"] for r in seen)
    if not names:
        return LanguageFilter.build([], [])
    share = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, sample / r["n"])) for r in seen], "lang string, share double"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(share, "lang").where(draw < F.col("share")).select("lang", "text")
    tally = chosen.mapInArrow(_tally, "lang string, gram long, c long").groupBy("gram", "lang").agg(F.sum("c").alias("c"))
    tally = Scratch(spark).table(tally)
    total = F.broadcast(tally.groupBy("lang").agg(F.sum("c").alias("total")))  # a row a language
    rated = tally.join(total, "lang").select("gram", F.struct("lang", (F.col("c") / F.col("total")).alias("rate")).alias("by"))
    # a gram has at most one entry a language
    high = rated.groupBy("gram").agg(F.collect_list("by").alias("by"), F.max("by.rate").alias("top"))
    common = F.filter("by", lambda x: (x["rate"] >= LEAST_RATE) & (x["rate"] >= LEAST_PART * F.col("top")))
    high = high.select("gram", F.transform(common, lambda x: x["lang"]).alias("langs"))
    kept = high.where(F.size("langs") > 0)
    got = kept.toPandas()
    by: dict[str, list[int]] = {x: [] for x in names}
    for gram, langs in zip(got["gram"], got["langs"], strict=True):
        for x in langs:
            by[x].append(gram)
    return LanguageFilter.build(names, [np.array(by[x], np.int64).view(W.U) for x in names])


def identify(spark: SparkSession, docs: DataFrame, known: LanguageFilter) -> DataFrame:
    """docs with a long doc_id and a string text -> (doc_id, lang_pred, score), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in _parts(batch.column(1).to_pylist()):
                name, score = known.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def learn_from(spark: SparkSession, docs: DataFrame) -> LanguageFilter:
    """Learn from the rows of docs that have an id and are not held out."""
    return learn(spark, _plain(docs).where(~held_out() & F.col("doc_id").isNotNull()))


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang)."""
    return identify(spark, _plain(docs), learn_from(spark, docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
