"""Repeated-substring removal by level-wise doubling.

A window of 35 words can repeat only where its parts of 18 and 9 words repeat. So 9-word
windows are counted first, and of those only each 35-word window's least one (its
minimizer), which equal windows share; windows whose 9 words repeat are extended to 18
words on either side, and those that still repeat to the whole length.

One level: every task hashes its candidates and settles those that repeat within a slice
group at once, so that at most one row for each distinct window leaves a slice; what is
left meets by hash, and survivors go back by document. No group is ever collected.

Windows are compared by 64-bit hashes; the last level, which decides, by two independent
ones, 128 bits in all, and so are whole texts. Rows are numbered and texts are dealt by
number once, into buckets; a text is then read once for each level, where it lies, and
survivors come to it.

Texts that are equal word for word are one class: if they have 35 words they are removed
whole, and one of them stands for the class in the levels.

Cases: null or empty text, or fewer than 35 words: nothing is removed. Null or repeated
doc_id: each row is returned. kept_text: the
text as it was where nothing is removed (null for null), else the kept words joined by one
space, whose hash is kept_sha256 in either case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm import words as W
from quillfold.llm.scratch import Scratch, partitions

#: Length of a window in words, and the levels that lead to it.
WINDOW = 35
HALF = (WINDOW + 1) // 2
QUARTER = HALF // 2

_LEVEL = "kind int, bucket int, doc long, sig long, n long, a binary, b binary, c binary, d binary"
_BACK = "bucket int, b binary, c binary"
_LIVE = "doc long, at binary"
_FIELDS = [c.split()[0] for c in _LEVEL.split(", ")]


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of QUARTER, HALF and WINDOW words, each from runs half as long."""
    q = W.sequences(h, QUARTER)
    half = W.chain(q[:-QUARTER], q[QUARTER:])
    step = WINDOW - HALF
    return q, half, W.chain(half[:-step], half[step:])


def _reach(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w consecutive values, by doubling."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = op(out[:-step], out[step:])
        done += step
    return out


def minimizers(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions that are the least QUARTER-run of some window, that of each window)."""
    span = WINDOW - QUARTER + 1
    least = _reach(q, span, np.minimum)
    pad = np.zeros(span - 1, W.U)
    picked = np.flatnonzero(_reach(np.r_[pad, least, pad], span, np.maximum) == q)
    # each window takes the first position at or after its start with the least value
    nxt = np.searchsorted(picked, np.arange(len(least)))
    of = picked[nxt]
    while True:
        wrong = q[of] != least
        if not wrong.any():
            return picked, of
        nxt[wrong] += 1
        of[wrong] = picked[nxt[wrong]]


def _row(kind: int, bucket: int = 0, doc: int = 0, sig: int = 0, n: int = 0, a: bytes = b"", b: bytes = b"", c: bytes = b"", d: bytes = b"") -> tuple:
    return kind, bucket, doc, sig, n, a, b, c, d


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=_FIELDS)


def _sorted(key: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal keys together, whether each in that order equals the one before)."""
    if second is None:
        o = np.argsort(key, kind="stable")
        return o, key[o][1:] == key[o][:-1]
    o = np.lexsort((second, key))
    k, s = key[o], second[o]
    return o, (k[1:] == k[:-1]) & (s[1:] == s[:-1])


def _settle(key: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int, second: np.ndarray | None = None) -> list[tuple]:
    """Rows of one slice: windows that repeat within it, and one of each kind to compare."""
    o, same = _sorted(key, second)
    key, doc, at = key[o], doc[o], at[o]
    twice = np.r_[False, same] | np.r_[same, False]
    rows = _owned(doc[twice], at[twice], buckets // 2)
    one = np.r_[True, ~same]
    second = None if second is None else second[o][one]
    key, doc, at = key[one], doc[one], at[one] | (twice[one].astype(np.uint32) << np.uint32(31))
    bucket = (key >> W.U(20)) % W.U(buckets)
    o = np.argsort(bucket, kind="stable")
    key, doc, at, bucket = key[o], doc[o], at[o], bucket[o]
    second = None if second is None else second[o]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for i, j in zip(cut.tolist(), np.r_[cut[1:], len(bucket)].tolist(), strict=True):
        rows.append(_row(1, int(bucket[i]), a=key[i:j].tobytes(), b=doc[i:j].tobytes(), c=at[i:j].tobytes(), d=b"" if second is None else second[i:j].tobytes()))
    return rows


def _owned(doc: np.ndarray, at: np.ndarray, owners: int) -> list[tuple]:
    """What repeats, packed by the partition that owns its document."""
    if not len(doc):
        return []
    owner = W.mix(doc.view(W.U)) % W.U(owners)
    o = np.argsort(owner, kind="stable")
    doc, at, owner = doc[o], at[o], owner[o]
    cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return [_row(2, int(owner[i]), b=doc[i:j].tobytes(), c=at[i:j].tobytes()) for i, j in zip(cut.tolist(), np.r_[cut[1:], len(owner)].tolist(), strict=True)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket in turn, without it, of batches sorted by bucket: one bucket is held at a time."""
    now, rows = None, []
    for batch in batches:
        bucket = batch.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        for i, j in zip(cut.tolist(), np.r_[cut[1:], len(bucket)].tolist(), strict=False):
            if rows and bucket[i] != now:
                yield rows
                rows = []
            now = bucket[i]
            rows += zip(*(c.slice(i, j - i).to_pylist() for c in batch.columns[1:]), strict=True)
    if rows:
        yield rows


def _columns(rows: list[tuple], types: Sequence[type]) -> list[np.ndarray]:
    """Packed rows as one array a column; the rows are let go."""
    out = [np.frombuffer(b"".join(column), t) for column, t in zip(zip(*rows, strict=True), types, strict=True)]
    rows.clear()
    return out


def _compare(buckets: int):
    """Reduce side of a level: what repeats across slices. Equal windows are in one bucket, so each is settled alone."""

    def repeats(rows: list[tuple]) -> list[tuple]:
        key, doc, at, second = _columns(rows, (W.U, np.int64, np.uint32, W.U))
        o, same = _sorted(key, second if len(second) else None)
        doc, at = doc[o], at[o]
        known = at >> np.uint32(31) == 1
        keep = (np.r_[False, same] | np.r_[same, False]) & ~known  # known ones were settled where they lie
        return _owned(doc[keep], at[keep], buckets // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            if found := repeats(rows):
                yield _rows(found).select(["bucket", "b", "c"])

    return run


def _regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that repeats in each document, bucket by bucket: a document has one."""
    for rows in _by_bucket(batches):
        doc, at = _columns(rows, (np.int64, np.uint32))
        at = at & np.uint32(0x7FFFFFFF)
        o = np.argsort(doc, kind="stable")
        doc, at = doc[o], at[o]
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        span = list(zip(cut.tolist(), np.r_[cut[1:], len(doc)].tolist(), strict=True))
        for i in range(0, len(span), 2000):
            part = span[i : i + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[[x for x, _ in part]]), pa.array([at[x:y].tobytes() for x, y in part], pa.binary())], names=["doc", "at"])
        del doc, at, o


def _first_level(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, to, w in W.slices(batch, "text", False):
                rows, key, doc, at = [], [], [], []
                for i in range(to - start):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    sig = int(W.whole(h).view(np.int64))
                    post = len(h) >= WINDOW and sig not in seen
                    rows.append(_row(0, int(post), doc=int(ids[start + i]), sig=sig, n=len(h), a=W.whole(h, 55).tobytes()))
                    if not post:
                        continue
                    seen.add(sig)
                    q = W.sequences(h, QUARTER)
                    picked, _ = minimizers(q)
                    key.append(q[picked]), at.append(picked.astype(np.uint32))
                    doc.append(np.full(len(picked), ids[start + i], np.int64))
                if key:
                    rows += _settle(np.concatenate(key), np.concatenate(doc), np.concatenate(at), buckets)
                yield _rows(rows)

    return run


def _marks(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob, np.uint32) if blob else np.zeros(0, np.uint32)


def _next_level(buckets: int, candidates: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]):
    """Map side of a later level: candidates(word hashes, survivors) gives (keys, marks[, second keys])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            old = batch.column(2).to_pylist()
            for start, to, w in W.slices(batch, "text", False):
                key, doc, at, second = [], [], [], []
                for i in range(to - start):
                    k, a, *more = candidates(w.hash[w.first[i] : w.first[i + 1]], _marks(old[start + i]))
                    if len(k):
                        key.append(k), at.append(a), doc.append(np.full(len(k), ids[start + i], np.int64))
                        second += more
                if key:
                    yield _rows(_settle(np.concatenate(key), np.concatenate(doc), np.concatenate(at), buckets, np.concatenate(second) if second else None))

    return run


def _halves(h: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The HALF-runs that end and begin with each surviving anchor; mark = 2 * anchor + side."""
    q = W.sequences(h, QUARTER)
    a = np.unique(anchors).astype(np.int64)
    left, right = a[a >= QUARTER], a[a + QUARTER < len(q)]
    key = np.r_[W.chain(q[left - QUARTER], q[left]), W.chain(q[right], q[right + QUARTER])]
    return key, np.r_[2 * left, 2 * right + 1].astype(np.uint32)


def _wholes(h: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows whose anchor, extended to HALF on the sides they hold, still repeats, under two hashes."""
    q, _, full = window_hashes(h)
    _, of = minimizers(q)
    left, right = np.zeros(len(q), bool), np.zeros(len(q), bool)
    m = marks.astype(np.int64)
    left[m[m % 2 == 0] // 2] = True
    right[m[m % 2 == 1] // 2] = True
    s = np.arange(len(full))
    inside = of - s
    ok = (left[of] | (inside < QUARTER)) & (right[of] | (inside > WINDOW - HALF))
    at = np.flatnonzero(ok)
    return full[at], at.astype(np.uint32), W.sequences(h, WINDOW)[at]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, carried) from (doc_id, text, all, at, carried)."""
    for batch in batches:
        whole, marks = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        null = batch.column(1).is_null().to_pylist()
        for start, to, w in W.slices(batch, "text", False):
            count, gone, sha, text = [], [], [], []
            plain = batch.column(1).slice(start, to - start).cast(pa.binary()).to_pylist()
            for i in range(to - start):
                n = int(w.first[i + 1] - w.first[i])
                if whole[start + i]:
                    keep = np.zeros(n, bool)
                elif marks[start + i]:
                    depth = np.zeros(n + 1, np.int32)
                    s = np.unique(_marks(marks[start + i])).astype(np.int64)
                    np.add.at(depth, s, 1), np.add.at(depth, s + WINDOW, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                else:
                    keep = None
                kept = b" ".join(w.text(i, keep))
                count.append(n)
                gone.append(0 if keep is None else int(n - keep.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                text.append(None if null[start + i] else plain[i] if keep is None else kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, to - start),
                    pa.array(count, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(sha, pa.string()),
                    pa.array(text, pa.binary()).cast(pa.string()),
                    batch.column(4).slice(start, to - start),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "carried"],
            )


def substring_dedup(spark: SparkSession, docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256, kept_text, carried), a row each.

    carried is a struct of the columns of docs named in carry, as they were.
    """
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in carry]).alias("carried"))
    length = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(partitions(spark), length // 24_000_000 + 1)
    buckets = 2 * parts
    texts = scratch.bucketed(texts.withColumn("doc", F.monotonically_increasing_id()), "doc", parts)
    read = texts.select("doc", "text")

    def survivors(level: DataFrame) -> tuple[DataFrame, str]:
        posted = level.where("kind = 1").select("bucket", "a", "b", "c", "d")
        # several buckets meet in a partition; sorted (Spark spills), they are taken one at a time
        back = posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(buckets), _BACK)
        settled = level.where("kind = 2").select("bucket", "b", "c")
        return scratch.write(back.unionByName(settled).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_regroup, _LIVE))

    first, path = scratch.write(read.mapInArrow(_first_level(buckets), _LEVEL), "kind")
    facts = first.where("kind = 0").select("doc", "sig", F.col("a").alias("sig2"), "n", (F.col("bucket") == 1).alias("posted"))
    facts = scratch.table(facts)
    least = F.min(F.when(F.col("posted"), F.col("doc")))  # only copies that were posted have survivors
    text = ["sig", "sig2", "n"]
    classes = facts.where(f"n >= {WINDOW}").groupBy(*text).agg(least.alias("doc"), F.count("*").alias("copies"))
    # all copies of a text go whole; the other windows of the corpus still meet one of them
    classes = scratch.table(classes)
    live, old = survivors(first)
    scratch.drop(path)
    for candidates in (_halves, _wholes):
        joined = read.join(live.join(classes.select("doc"), "doc"), "doc").select("doc", "text", "at")
        level, path = scratch.write(joined.mapInArrow(_next_level(buckets, candidates), _LEVEL), "kind")
        scratch.drop(old)
        live, old = survivors(level)
        scratch.drop(path)
    copied = facts.join(classes.where("copies > 1").select(*text), text).select("doc", F.lit(True).alias("copied"))
    state = copied.join(live, "doc", "full").select("doc", F.coalesce("copied", F.lit(False)).alias("copied"), "at")
    state = state.withColumn("at", F.when(~F.col("copied"), F.col("at")))
    state = scratch.table(state)
    out = texts.join(state, "doc", "left").select("doc_id", "text", "copied", "at", "carried")
    kind = out.schema["carried"].dataType.simpleString()
    return out.mapInArrow(_cut, f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, carried {kind}")
