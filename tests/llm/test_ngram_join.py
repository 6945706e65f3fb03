import numpy as np
import pytest
from fixtures import documents, prose, texts

from quillfold.llm import ngram_join
from quillfold.llm.ngram_join import divide_skip, ngram_jaccard


def brute(rows):
    """(doc_id, n_shingles, component_id, n_links) by comparing all pairs."""
    low = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()) for i, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for _, w in low]
    top = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    ids = {}
    for x in range(len(rows)):
        ids.setdefault(find(x), []).append(rows[x][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(map(str, [(rows[x][0], len(sets[x]), least[find(x)], links[x]) for x in range(len(rows))]))


def got(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.n_links)) for r in df.collect())


def test_odd_rows(spark):
    assert got(ngram_jaccard(spark, documents(spark))) == brute(texts())


def test_rows_without_ids_link(spark):
    base = prose("null", 120)
    rows = [(None, base), (None, base + " more"), (None, base), (7, prose(7, 50)), (None, prose(8, 50))]
    assert got(ngram_jaccard(spark, documents(spark, rows))) == brute(rows)


def test_empty(spark):
    assert ngram_jaccard(spark, documents(spark, [])).collect() == []


def _cluster(n, words=150, edits=3, seed=0):
    """Near copies of one text: pairs on both sides of the threshold."""
    r = np.random.default_rng(seed)
    base = prose("cluster", words).split()
    rows = []
    for i in range(n):
        w = list(base)
        for at in r.integers(0, words, int(r.integers(0, edits + 1))):
            w[at] = f"e{r.integers(1000)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("chunk", [1_000_000, 4000])
def test_many_near_copies(spark, monkeypatch, chunk):
    """Also with lists too long to pair, and blocks split into pairs of chunks."""
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rows = _cluster(300) + [(1000 + i, prose(i, 40 + i)) for i in range(100)]
    assert got(ngram_jaccard(spark, documents(spark, rows))) == brute(rows)


def test_long_lists_change_nothing(spark, monkeypatch):
    rows = _cluster(120, seed=5)
    monkeypatch.setattr(ngram_join, "LONG_FROM", 10**9)
    assert got(ngram_jaccard(spark, documents(spark, rows))) == brute(rows)


def test_partners_that_share_only_hot_lists(spark):
    """y needs two hot lists in common with x; of one of them another text of its size is posted."""
    base = prose("hot", 28).split()
    rows = [(i, prose(i, 150) + " " + " ".join(base)) for i in range(60)]
    rows += [(100 + i, prose(100 + i, 150) + " " + " ".join(base[-5:])) for i in range(20)]
    rows += [(200 + i, prose(200 + i, 150) + " " + " ".join(base[:5])) for i in range(10)]
    rows += [(300 + i, " ".join([f"first{i}", *base[1:], *[f"z{i}_{k}" for k in range(6)]])) for i in range(20)]
    rows += [(400, " ".join(base)), (401, " ".join(base + [f"y{k}" for k in range(6)]))]
    want = brute(rows)
    assert str((401, 30, 400, 1)) in want
    assert got(ngram_jaccard(spark, documents(spark, rows).coalesce(1))) == want


def test_the_threshold_is_inclusive():
    a, b = np.arange(100, dtype=np.uint64), np.arange(0, 80, dtype=np.uint64)
    c = np.arange(0, 79, dtype=np.uint64)
    assert [(i, j.tolist()) for i, j in divide_skip([c, b, a])] == [(1, [0]), (2, [1])]


def test_folded_lists_lose_no_link(spark):
    """Each list that x and y share is long, and in either slice another text of its size stands for them."""
    base = [f"c{k}" for k in range(44)]
    near = [*base[:-1], "other"]
    halves = []
    for side, text in ((0, base), (1, near)):
        rows = [(100_000 * side, " ".join(text))]
        for at in range(40):
            shared = [f"s{side}_{at}_{k}" for k in range(30)]
            for member in range(50):
                own = [f"m{side}_{at}_{member}_{k}" for k in range(5)]
                rows.append((100_000 * side + 1 + 50 * at + member, " ".join([*own, *shared, *base[at : at + 5]])))
        halves.append(rows)
    docs = documents(spark, [*halves[0], *halves[1]]).repartitionByRange(2, "doc_id")
    found = {r.doc_id: r for r in ngram_jaccard(spark, docs).where("doc_id IN (0, 100000)").collect()}
    assert [(found[i].n_shingles, found[i].component_id, found[i].n_links) for i in (0, 100_000)] == [(40, 0, 1), (40, 0, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_that_cross_small_slices(spark, monkeypatch, seed):
    """Random clusters with shared passages, hot and cold lists, dealt over slices of a few texts."""
    monkeypatch.setattr(ngram_join, "LONG_FROM", 6)
    monkeypatch.setattr(ngram_join, "PAIRED", 12)
    monkeypatch.setattr(ngram_join, "GROUP", 4000)
    r = np.random.default_rng(seed)
    passages = [prose(f"{seed}p{k}", int(r.integers(5, 40))).split() for k in range(6)]
    rows = []
    for c in range(8):
        base = prose(f"{seed}c{c}", int(r.integers(6, 90))).split()
        for _ in range(int(r.integers(1, 40))):
            w = list(base)
            for at in r.integers(0, len(w), int(r.integers(0, 3))):
                w[at] = f"e{r.integers(40)}"
            if r.random() < 0.5:
                w += passages[r.integers(len(passages))]
            rows.append((len(rows), " ".join(w)))
    order = r.permutation(len(rows))
    docs = documents(spark, [rows[i] for i in order]).repartition(7)
    assert got(ngram_jaccard(spark, docs)) == brute(rows)


def test_forests_keep_components(spark):
    from quillfold.llm.components import connected_components
    from quillfold.llm.scratch import Scratch

    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (330, 2))]
    top = list(range(400))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {x.node: x.root for x in connected_components(df, "a", "b", Scratch(spark)).collect()} == want
