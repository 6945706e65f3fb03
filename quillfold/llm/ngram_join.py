"""Exact n-gram Jaccard self-join by T-occurrence search with DivideSkip.

Documents link when the Jaccard similarity of their sets of 5-word shingles is at least
0.8. Texts with the same set form one class and take part once.

1. Shingles are ordered: those of long inverted lists last, the rest by hash. A document
   of n shingles needs T = ceil(0.8 n) in common with any partner, so partners share at
   least l of the first n - T + l shingles of either (its short lists). Which lists count
   as long only changes the order, never the result; the table of long lists is capped
   (LONG_LISTS) and so has a proven size.
2. Short lists are merged where they lie, in buckets of the shingle hash, and give edges of
   a candidate graph: pairs with at least l common short lists, and, for lists too long to
   pair up, a star over the members of similar size. Lists are reduced before the shuffle:
   of a long list a slice posts one member for each size, tied to the others; a pair with
   such a member is an edge whatever its count.
3. Each component of that graph is a block. A block's documents meet once, with whole sets
   (a block over the memory bound as pairs of chunks of similar size), and DivideSkip
   decides exactly: merge the short lists, binary-probe the long ones for the survivors.

Cases: null or empty text: 0 shingles, no links, its own component. Fewer than five words:
the sequence is the one shingle. Null doc_id: the row takes part and reports null only if
all of its component's ids are null. Repeated rows: each is returned. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm import words as W
from quillfold.llm.components import connected_components
from quillfold.llm.scratch import BROADCAST_BYTES, Scratch, partitions

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
NUM, DEN = 80, 100
#: Shingles whose lists may count as long (the most frequent ones): a bound of the broadcast.
LONG_LISTS = 1 << 17
#: A list counts as long from this many documents, as far as they repeat within one slice group.
LONG_FROM = 48
#: Members of one short list that are still paired with each other.
PAIRED = 256
#: Shingles in a block chunk: what one task holds at a time.
CHUNK = 1_000_000
#: Shingles counted together before a map task reports repeated ones.
GROUP = 4_000_000

_FACTS = "kind int, a long, b long, n long, th long"
_POSTED = "bucket int, kind int, a binary, b binary, n binary"
_EDGES = "a long, b long, common int, need int"
_FOUND = "node long, parent long, links long"


def shingle_sets(w: W.Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    all5 = W.sequences(w.hash, SHINGLE)
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= SHINGLE:
            yield np.unique(all5[a : b - SHINGLE + 1])
        elif b > a:
            yield np.array([W.whole(w.hash[a:b])], W.U)
        else:
            yield np.zeros(0, W.U)


def _signature(s: np.ndarray) -> int:
    return int(np.int64(W.whole(s).view(np.int64))) if len(s) else 0


def need_of(n: int | np.ndarray) -> int | np.ndarray:
    """Least overlap of a set of n with a partner that is no larger."""
    return -(-NUM * n // DEN)


def _more(n: int | np.ndarray) -> int | np.ndarray:
    """l: short lists that partners must share; a longer prefix buys a stronger filter."""
    return n // 20 + 1


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    pool: list[np.ndarray] = []

    def repeated() -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(pool), return_counts=True)
        pool.clear()
        u, c = u[c > 1], c[c > 1]
        return _batch(_FACTS, np.full(len(u), 1, np.int32), W.signed(u), np.zeros(len(u), np.int64), c.astype(np.int64), np.zeros(len(u), np.int64))

    for batch in batches:
        ids = batch.column(0)
        for at, to, w in W.slices(batch, "text", True):
            sig, size = [], []
            for s in shingle_sets(w):
                sig.append(_signature(s))
                size.append(len(s))
                if sig[-1] not in seen:
                    seen.add(sig[-1])
                    pool.append(s)
            part = ids.slice(at, to - at).cast(pa.int64())
            k = len(sig)
            text_hash = batch.column(2).slice(at, to - at)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), part, pa.array(sig, pa.int64()), pa.array(size, pa.int64()), text_hash], names=["kind", "a", "b", "n", "th"])
            if sum(map(len, pool)) > GROUP:
                yield repeated()
    if pool:
        yield repeated()


def _batch(schema: str, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[c.split()[0] for c in schema.split(", ")])


def _post(long_keys: np.ndarray, long_rank: np.ndarray, buckets: int):
    """Map side: each new set's short lists, and of long lists one member for each size."""

    def blobs(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = (key >> W.U(20)) % W.U(buckets)
        o = np.argsort(bucket, kind="stable")
        a, b, n, bucket = a[o], b[o], n[o], bucket[o]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(o) else np.zeros(0, int)
        ends = np.r_[cut[1:], len(o)]
        span = list(zip(cut.tolist(), ends.tolist(), strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[cut].astype(np.int32)),
                pa.array(np.full(len(cut), kind, np.int32)),
                *(pa.array([x[i:j].tobytes() for i, j in span], pa.binary()) for x in (a, b, n)),
            ],
            names=["bucket", "kind", "a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, w in W.slices(batch, "text", True):
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for s in shingle_sets(w):
                    n, sig = len(s), _signature(s)
                    if not n or sig in seen:
                        continue
                    seen.add(sig)
                    p = n - need_of(n) + _more(n)
                    at = np.minimum(np.searchsorted(long_keys, s), max(len(long_keys) - 1, 0))
                    is_long = long_keys[at] == s if len(long_keys) else np.zeros(n, bool)
                    short = s[~is_long][:p]
                    out.append((short, np.full(len(short), sig, np.int64), np.full(len(short), n, np.int32)))
                    if len(short) < p:
                        rest = s[is_long]
                        rest = rest[np.argsort(long_rank[at[is_long]], kind="stable")][: p - len(short)]
                        hot.append((rest, np.full(len(rest), sig, np.int64), np.full(len(rest), n, np.int32)))
                if out:
                    key, sig_, n_ = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield blobs(0, key, key, sig_, n_)
                if hot:
                    key, sig_, n_ = (np.concatenate(x) for x in zip(*hot, strict=True))
                    o = np.lexsort((sig_, n_, key))
                    key, sig_, n_ = key[o], sig_[o], n_[o]
                    new = np.r_[True, (key[1:] != key[:-1]) | (n_[1:] != n_[:-1])]
                    lead = sig_[np.flatnonzero(new)[np.cumsum(new) - 1]]
                    e = np.unique(np.stack([lead[~new], sig_[~new]], 1), axis=0) if (~new).any() else np.zeros((0, 2), np.int64)
                    # a lead that others were left out for has its size negated
                    alone = np.diff(np.r_[np.flatnonzero(new), len(new)]) == 1
                    yield blobs(0, key[new], key[new], sig_[new], np.where(alone, n_[new], -n_[new]))
                    if len(e):
                        a, b = np.ascontiguousarray(e[:, 0]), np.ascontiguousarray(e[:, 1])
                        yield blobs(1, b.view(W.U), a.view(W.U), b, np.zeros(len(e), np.int32))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the lists of one partition's buckets give candidate edges."""
    keys, sigs, sizes, stars = [], [], [], []
    for batch in batches:
        for kind, a, b, n in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            if kind:
                stars.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
            else:
                keys.append(np.frombuffer(a, W.U))
                sigs.append(np.frombuffer(b, np.int64))
                sizes.append(np.frombuffer(n, np.int32))
    sure = [(a, b) for a, b in stars]
    if keys:
        key, sig, n = np.concatenate(keys), np.concatenate(sigs), np.concatenate(sizes)
        keys.clear(), sigs.clear(), sizes.clear()
        o = np.argsort(key, kind="stable")
        key, sig, n = key[o], sig[o], n[o]
        same = key[1:] == key[:-1]
        many = np.r_[False, same] | np.r_[same, False]
        key, sig, n = key[many], sig[many], n[many]
        o = np.lexsort((n, sig, np.abs(n), key))
        key, sig, n = key[o], sig[o], n[o]
        one = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])] if len(key) else np.zeros(0, bool)
        key, sig, n = key[one], sig[one], n[one]
        stands, n = n < 0, np.abs(n)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        count = np.diff(np.r_[first, len(key)])
        small = np.repeat(count, count) <= PAIRED
        # lists too long to pair: a star over each run of neighbours of similar size
        k, s, m = key[~small], sig[~small], n[~small].astype(np.int64)
        if len(k):
            cut = np.r_[True, (k[1:] != k[:-1]) | (DEN * m[:-1] < NUM * m[1:])]
            sure.append((s[np.flatnonzero(cut)[np.cumsum(cut) - 1]], s))
        k, s, m, f = key[small], sig[small], n[small].astype(np.int64), stands[small]
        left, right, need = [], [], []
        for d in range(1, PAIRED):
            if len(k) <= d:
                break
            ok = (k[d:] == k[:-d]) & (DEN * m[:-d] >= NUM * m[d:])
            if not (k[d:] == k[:-d]).any():
                break
            i = np.flatnonzero(ok)
            a, b = s[i], s[i + d]
            left.append(np.minimum(a, b)), right.append(np.maximum(a, b))
            # those left out lose this list in their counts: meeting their lead is enough
            need.append(np.where(f[i] | f[i + d], 0, np.minimum(_more(m[i]), _more(m[i + d]))))
        if left:
            a, b, need_ = np.concatenate(left), np.concatenate(right), np.concatenate(need)
            o = np.lexsort((need_, b, a))
            a, b, need_ = a[o], b[o], need_[o]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, int)
            yield _batch(_EDGES, a[new], b[new], np.diff(np.r_[new, len(a)]).astype(np.int32), need_[new].astype(np.int32))
    if sure:
        a, b = np.concatenate([x for x, _ in sure]), np.concatenate([x for _, x in sure])
        a, b = np.minimum(a, b), np.maximum(a, b)
        e = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        if len(e):
            yield _batch(_EDGES, np.ascontiguousarray(e[:, 0]), np.ascontiguousarray(e[:, 1]), np.ones(len(e), np.int32), np.zeros(len(e), np.int32))


def divide_skip(sets: list[np.ndarray], side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Links among sets sorted by size: (i, the j before i with Jaccard >= 0.8).

    For query i: T = need_of(n_i). The L < T longest of its inverted lists are set aside; the
    others are merged, counting; only documents found T - L times are probed in the
    long lists by binary search. With side, only sets of different sides are compared.
    """
    n = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), n)
    tok = np.concatenate(sets)
    o = np.argsort(tok, kind="stable")  # each list is in the order of documents
    tok, post = tok[o], doc[o]
    new = np.r_[True, tok[1:] != tok[:-1]]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(tok)]
    of = np.empty(len(tok), np.int64)
    of[o] = np.cumsum(new) - 1
    base = np.r_[0, np.cumsum(n)]
    counts = np.zeros(len(sets), np.int64)
    for i in range(1, len(sets)):
        ni, t = int(n[i]), int(need_of(n[i]))
        lists = of[base[i] : base[i + 1]]
        length = end[lists] - start[lists]
        busy = lists[length > 1]
        if len(busy) < t:
            continue
        length = end[busy] - start[busy]
        by = np.argsort(length, kind="stable")
        busy, length = busy[by], length[by]
        low = int(np.searchsorted(n, need_of(ni)))
        # a long list costs one probe for each survivor, a merged one all of its entries
        longest = min(t - 1, int((length > 16 * max(1, np.log2(len(sets)))).sum()))
        short = busy[: len(busy) - longest]
        found = np.concatenate([post[start[x] : end[x]] for x in short.tolist()])
        found = found[(found < i) & (found >= low)]
        if side is not None:
            found = found[side[found] != side[i]]
        if not len(found):
            continue
        np.add.at(counts, found, 1) if len(found) < 64 else np.copyto(counts, np.bincount(found, minlength=len(sets)))
        cand = np.unique(found)
        cand = cand[counts[cand] >= t - longest]
        overlap = counts[cand].copy()
        counts[:] = 0
        for x in busy[len(busy) - longest :].tolist():
            if not len(cand):
                break
            entries = post[start[x] : end[x]]
            pos = np.searchsorted(entries, cand)
            overlap += entries[np.minimum(pos, len(entries) - 1)] == cand
        ok = DEN * overlap >= NUM * (n[cand] + ni - overlap)
        if ok.any():
            yield i, cand[ok]


def _solve(rows: list[tuple[int, int, int, bytes]]) -> tuple[list[int], list[int], list[int]]:
    """Of one block (pair of chunks): node, its parent and the number of documents it links to."""
    uniq: dict[int, tuple[int, int, np.ndarray]] = {}
    for chunk, sig, copies, blob in rows:
        uniq[sig] = (chunk, copies, np.frombuffer(blob, W.U))
    sigs = sorted(uniq, key=lambda s: (len(uniq[s][2]), s))
    chunk = np.array([uniq[s][0] for s in sigs])
    copies = np.array([uniq[s][1] for s in sigs])
    sets = [uniq[s][2] for s in sigs]
    links = np.zeros(len(sigs), np.int64)
    up = list(range(len(sigs)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    two = len(set(chunk.tolist())) > 1
    for i, js in divide_skip(sets, chunk if two else None) if len(sets) > 1 else ():
        links[i] += copies[js].sum()
        links[js] += copies[i]
        for j in js.tolist():
            a, b = top(i), top(j)
            if a != b:
                up[max(a, b)] = min(a, b)
    at = np.flatnonzero(links)
    return [sigs[i] for i in at], [sigs[top(int(i))] for i in at], links[at].tolist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; one block (pair of chunks) is in memory at a time."""
    key, rows = None, []
    found: tuple[list[int], list[int], list[int]] = ([], [], [])

    def flush() -> None:
        for into, got in zip(found, _solve(rows), strict=True):
            into.extend(got)
        rows.clear()

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in range(7)]
        for block, lo, hi, chunk, sig, copies, blob in zip(*cols, strict=True):
            if (block, lo, hi) != key:
                if rows:
                    flush()
                key = (block, lo, hi)
            rows.append((chunk, sig, copies, blob))
        if len(found[0]) > 50_000:
            yield _batch(_FOUND, *(np.array(x, np.int64) for x in found))
            found = ([], [], [])
    if rows:
        flush()
    if found[0]:
        yield _batch(_FOUND, *(np.array(x, np.int64) for x in found))


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of blocked documents: (text, sig, copies, block, chunk, meets)."""
    for batch in batches:
        want = batch.column(1).to_pylist()
        for at, to, w in W.slices(batch, "text", True):
            keep, blob = [], []
            for i, s in enumerate(shingle_sets(w), at):
                if _signature(s) == want[i]:  # hashes of texts may collide
                    keep.append(i)
                    blob.append(s.tobytes())
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(1, 6)), pa.array(blob, pa.binary())], names=["sig", "copies", "block", "chunk", "meets", "tokens"])


def ngram_jaccard(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs (doc_id, text)."""
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    facts = scratch.table(docs.mapInArrow(_facts, _FACTS), "kind")
    rows = facts.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sig"), "n", "th")
    # one row stands for a class: that of the least id, if any has one
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("lead")
    classes = rows.where("n > 0").groupBy("sig").agg(lead, F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = scratch.table(classes.select("sig", "lead.doc_id", "lead.th", "copies", "n"))
    frequent = facts.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("c")).where(F.col("c") >= LONG_FROM)
    top = frequent.orderBy(F.desc("c"), "token").limit(LONG_LISTS).toPandas()  # at most LONG_LISTS rows
    long_keys = top["token"].to_numpy(np.int64).view(W.U)
    order = np.argsort(long_keys)
    rank = top["c"].to_numpy(np.int64)  # the rarest first
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(spark), total // 8_000_000 + 1)
    # few partitions, as memory allows: a pair that shares many lists is a row in each of them
    merging = max(8, total // 16_000_000 + 1)
    posted = docs.select("text").mapInArrow(_post(long_keys[order], rank[order], 8 * merging), _POSTED)
    edges = posted.repartition(merging, "bucket").mapInArrow(_merge, _EDGES)
    edges = edges.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("need").alias("need")).where("common >= need")
    node = connected_components(edges.select("a", "b"), "a", "b", scratch)
    member = scratch.table(node.select(F.col("node").alias("sig"), F.col("root").alias("block")).join(classes, "sig"))

    # chunks of a block: by size, and by hash where one size has more than a chunk
    sizes = member.groupBy("block", "n").agg((F.sum("n")).alias("t"))
    run = "sum(t) OVER (PARTITION BY block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sizes = sizes.selectExpr("block", "n", f"CAST(floor(coalesce({run}, 0) / {CHUNK}) AS INT) AS c0", f"CAST(ceil(t / {CHUNK}) AS INT) AS salts")
    member = member.join(sizes, ["block", "n"]).withColumn("chunk", F.expr("c0 + CAST(pmod(xxhash64(sig), salts) AS INT)"))
    member = scratch.table(member.select("sig", "doc_id", "th", "copies", "n", "block", "chunk"))
    chunks = member.groupBy("block", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m"))
    many = chunks.groupBy("block").agg(F.count("*").alias("k"), F.sum("m").alias("docs"))
    split = chunks.join(many.where("k > 1").select("block"), "block")
    x, y = split.alias("x"), split.alias("y")
    meet = x.join(y, F.expr(f"x.block = y.block AND x.chunk <= y.chunk AND {DEN} * x.hi >= {NUM} * y.lo"))
    meet = meet.selectExpr("x.block AS block", "x.chunk AS i", "y.chunk AS j")
    meets = meet.selectExpr("block", "i AS chunk", "struct(i, j) AS p").union(meet.where("i < j").selectExpr("block", "j AS chunk", "struct(i, j) AS p"))
    meets = meets.groupBy("block", "chunk").agg(F.collect_list("p").alias("meets"))
    blocked = member.join(meets, ["block", "chunk"], "left").selectExpr(
        "doc_id", "th", "sig", "copies", "block", "chunk", "coalesce(meets, array(struct(chunk AS i, chunk AS j))) AS meets"
    )
    blocked = scratch.table(blocked)
    # 64 bytes a row and 8 a meeting: a list that is proven small goes to the texts, else texts are dealt by hash
    held = blocked.agg(64 * F.count("*") + 8 * F.sum(F.size("meets"))).first()[0] or 0
    blocked = F.broadcast(blocked) if held <= BROADCAST_BYTES else blocked
    texts = docs.alias("d").join(blocked.alias("b"), F.expr("d.doc_id <=> b.doc_id AND d.th = b.th"))
    texts = texts.select("text", "sig", "copies", "block", "chunk", "meets")
    sets = texts.mapInArrow(_sets_of, "sig long, copies long, block long, chunk int, meets array<struct<i:int,j:int>>, tokens binary")
    sets = sets.select("block", F.explode("meets").alias("p"), "chunk", "sig", "copies", "tokens").selectExpr("block", "p.i AS i", "p.j AS j", "chunk", "sig", "copies", "tokens")
    found = sets.repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_blocks, _FOUND)
    found = scratch.table(found)
    links = found.groupBy(F.col("node").alias("sig")).agg(F.sum("links").alias("links"))
    linked = connected_components(found.select("node", "parent"), "node", "parent", scratch)
    group = linked.select(F.col("node").alias("sig"), "root")
    least = group.join(classes.select("sig", "doc_id"), "sig").groupBy("root").agg(F.min("doc_id").alias("least"))
    state = classes.join(group.join(least, "root").select("sig", "least"), "sig", "left").join(links, "sig", "left")
    state = state.select("sig", F.coalesce("least", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    state = scratch.table(state)
    full = rows.where("n > 0").join(state, "sig").selectExpr("doc_id", "n AS n_shingles", "component_id", "n_links")
    return full.unionByName(rows.where("n = 0").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id", "0L AS n_links"))
