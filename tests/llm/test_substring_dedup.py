import hashlib
from collections import Counter

import numpy as np
import pytest
from fixtures import documents, prose, texts

from quillfold.llm import substring_dedup as dedup
from quillfold.llm.substring_dedup import substring_dedup


def brute(rows, size=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append(str((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def got(df):
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in df.collect())


def test_odd_rows(spark):
    assert got(substring_dedup(spark, documents(spark))) == brute(texts())


def test_unique_ids(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts())]
    df = substring_dedup(spark, documents(spark, rows))
    assert got(df) == brute(rows)
    assert {r.doc_id for r in df.where("kept_text IS NULL").collect()} == {i for i, t in rows if t is None}


def test_empty(spark):
    assert substring_dedup(spark, documents(spark, [])).collect() == []


def test_passages_of_every_length(spark):
    """Shared runs of 30 to 80 words at odd places, within and across texts."""
    shared = prose("shared", 80).split()
    rows = []
    for i, n in enumerate(range(30, 81, 5)):
        rows.append((i, prose(i, 37 + i) + " " + " ".join(shared[:n]) + " " + prose(-i - 1, 50)))
        rows.append((100 + i, " ".join(shared[80 - n :]) + " " + prose(1000 + i, 20)))
    rows.append((500, " ".join(["same"] * 90)))
    rows.append((501, " ".join(["a", "b"] * 40)))
    assert got(substring_dedup(spark, documents(spark, rows))) == brute(rows)


@pytest.mark.parametrize("ids", [range(20, 0, -1), [7, 3, 12, 1, 9, 4, 15, 2]])
@pytest.mark.parametrize("parts", [1, 3])
def test_copies_in_any_order_still_meet_others(spark, ids, parts):
    """A passage shared with a group of copies only, whose least id is not read first."""
    copy = prose("copy", 120)
    rows = [(i, copy) for i in ids]
    rows += [(100, prose(100, 40) + " " + " ".join(copy.split()[30:75]) + " " + prose(101, 30)), (0, prose(102, 60))]
    docs = documents(spark, rows).coalesce(1)
    assert got(substring_dedup(spark, docs.repartition(parts) if parts > 1 else docs)) == brute(rows)


def test_equal_first_hashes_are_not_enough():
    """Windows under one key that differ in the second one stay apart, in a slice and across slices."""
    key = np.array([5, 5, 5, 7, 7], np.uint64) << np.uint64(20)
    second = np.array([1, 2, 1, 3, 4], np.uint64)
    doc, at = np.array([10, 11, 12, 13, 14]), np.arange(5, dtype=np.uint32)
    rows = dedup._settle(key, doc, at, 4, second)
    assert sorted(np.concatenate([np.frombuffer(r[6], np.int64) for r in rows if r[0] == 2]).tolist()) == [10, 12]
    apart = [r for i in range(5) for r in dedup._settle(key[i : i + 1], doc[i : i + 1], at[i : i + 1], 4, second[i : i + 1])]
    batch = dedup._rows(apart).select(["bucket", "a", "b", "c", "d"])
    back = [np.frombuffer(b, np.int64).tolist() for out in dedup._compare(4)(iter([batch])) for b in out.column(1).to_pylist()]
    assert sorted(x for b in back for x in b) == [10, 12]


def _read_ahead(reducer, batches):
    """(outputs, batches read when the first of them came)."""
    read = []
    out = reducer(read.append(b) or b for b in batches)
    first = next(out)
    at = len(read)
    return [first, *out], at


def test_reduce_side_holds_one_bucket():
    """A partition's buckets are settled one after another, also where one spans batches or shares one."""
    post = lambda bucket, key, doc: dedup._row(1, bucket, a=np.array([key], np.uint64).tobytes(), b=np.array([doc], np.int64).tobytes(), c=np.array([doc], np.uint32).tobytes())
    rows = [[post(0, 8, 10)], [post(0, 8, 11), post(1, 9, 12)], [post(1, 9, 13)], [post(2, 7, 14)], [post(3, 6, 15), post(3, 6, 16)]]
    out, at = _read_ahead(dedup._compare(8), [dedup._rows(r).select(["bucket", "a", "b", "c", "d"]) for r in rows])
    assert at == 2
    assert sorted(x for o in out for b in o.column(1).to_pylist() for x in np.frombuffer(b, np.int64).tolist()) == [10, 11, 12, 13, 15, 16]


def test_regrouping_holds_one_bucket():
    live = lambda bucket, doc, at: dedup._row(2, bucket, b=np.array([doc], np.int64).tobytes(), c=np.array([at], np.uint32).tobytes())
    rows = [[live(0, 5, 1)], [live(0, 5, 2), live(0, 6, 3), live(3, 7, 4)], [live(3, 7, 5)], [live(3, 8, 1 << 31 | 6)]]
    out, at = _read_ahead(dedup._regroup, [dedup._rows(r).select(["bucket", "b", "c"]) for r in rows])
    assert at == 2
    assert {d: np.frombuffer(a, np.uint32).tolist() for o in out for d, a in zip(o.column(0).to_pylist(), o.column(1).to_pylist(), strict=True)} == {5: [1, 2], 6: [3], 7: [4, 5], 8: [6]}


def test_every_passage_in_one_other_text(spark):
    """Nothing but the odd word stays; many buckets meet in each partition."""
    rows = [(i, f"left{i} {prose(i, 300)}") for i in range(60)] + [(100 + i, f"{prose(i, 300)} right{i}") for i in range(60)]
    df = substring_dedup(spark, documents(spark, rows).repartition(8))
    assert got(df) == brute(rows)


def test_texts_are_dealt_once(spark):
    """Joins with survivors use the buckets: the plan of the result shuffles no text."""
    out = substring_dedup(spark, documents(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("text#" not in line for line in plan.splitlines() if "Exchange" in line)
