import math
from collections import Counter, defaultdict

import pytest
from fixtures import documents, texts

from quillfold.llm import mixing
from quillfold.llm.mixing import exponent, mix_sources


def _docs(spark):
    rows = []
    for s, n in (("big", 600), ("mid", 120), ("small", 30), (None, 10)):
        rows += [(len(rows) + i, " ".join(["w"] * (3 + i % 7)), s) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_weights_budgets_and_epochs(spark):
    docs = _docs(spark)
    got = mix_sources(spark, docs, entropy=0.9, repeats=8.0, block=50).collect()
    tokens = defaultdict(int)
    for r in docs.collect():
        tokens[r.source] += len(r.text.split())
    taken, weight = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.n_tokens
        weight[r.source] = r.weight
    total = sum(tokens.values())
    assert abs(sum(weight.values()) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w in weight.values()) / math.log(4)
    most = max(taken[s] / tokens[s] for s in tokens)
    assert entropy >= 0.9 - 1e-6 or most >= 7.5  # the limit stopped it
    a = math.log(weight["big"] / weight["mid"]) / math.log(tokens["big"] / tokens["mid"])
    assert all(abs(weight[s] / weight["big"] - (tokens[s] / tokens["big"]) ** a) < 1e-9 for s in tokens)
    budget = tokens["big"] / weight["big"]  # one pass over the least repeated source
    for s in tokens:
        assert budget * weight[s] - 10 <= taken[s] <= budget * weight[s] + 1
    per = Counter((r.doc_id, r.epoch) for r in got)
    assert max(per.values()) == 1
    assert {r.doc_id for r in got} == set(range(760))
    assert all(0 <= r.position < 1 for r in got)
    assert total


def test_each_epoch_has_an_order_of_its_own(spark):
    got = mix_sources(spark, _docs(spark), entropy=1.0, repeats=100.0, block=20).where("source = 'mid'").orderBy("position").collect()
    orders = defaultdict(list)
    for r in got:
        orders[r.epoch].append(r.doc_id)
    assert len(orders) > 2 and orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])


def test_exponent_limits(spark):
    sources = spark.createDataFrame([(900,), (90,), (10,)], "tokens long")
    assert exponent(sources, 1000, 0.0, 100.0, None) == 1.0
    assert exponent(sources, 1000, 1.0, 1e9, None) < 1e-6
    limited = exponent(sources, 1000, 1.0, 3.0, None)
    assert abs((900 / 10) ** (1 - limited) - 3.0) < 1e-3


def test_budget_cuts_the_last_block(spark):
    got = mix_sources(spark, _docs(spark), entropy=0.0, repeats=100.0, budget=1000, block=50).collect()
    assert 940 <= sum(r.n_tokens for r in got) <= 1000


def test_odd_rows(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts())]
    got = mix_sources(spark, documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert all(r.weight is None for r in got if not r.n_tokens)
    assert mix_sources(spark, documents(spark, [])).count() == 0
    assert mix_sources(spark, documents(spark, [(1, None), (2, "")])).count() == 2


def _plain_exponent(tokens, entropy, repeats):
    """The largest exponent that reaches the entropy, raised until no source repeats too often: bisection in plain floats."""
    total = sum(tokens)
    share = [t / total for t in tokens]

    def state(a):
        w = [p**a for p in share]
        z = sum(w)
        h = -sum(x / z * math.log(x / z) for x in w) / math.log(len(w)) if len(w) > 1 else 1.0
        passes = [x / p for x, p in zip(w, share)]
        return h, max(passes) / min(passes)

    def largest(ok):
        low, high = 0.0, 1.0
        if ok(1.0):
            return 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    wanted = largest(lambda a: state(a)[0] >= entropy)
    return wanted if state(wanted)[1] <= repeats else largest(lambda a: state(a)[1] > repeats)


@pytest.mark.parametrize(("entropy", "repeats", "block"), [(0.97, 4.0, 40), (0.9, 100.0, 1_000_000), (1.0, 2.5, 25)])
def test_against_plain_loops(spark, entropy, repeats, block):
    """Which documents come how often, by a loop over sources."""
    docs = _docs(spark)
    got = mix_sources(spark, docs, entropy=entropy, repeats=repeats, block=block).collect()
    own = defaultdict(dict)
    for r in docs.collect():
        own[r.source][r.doc_id] = len(r.text.split())
    tokens = {s: sum(d.values()) for s, d in own.items()}
    a = _plain_exponent(list(tokens.values()), entropy, repeats)
    plain = {s: t**a / sum(x**a for x in tokens.values()) for s, t in tokens.items()}
    weight = {r.source: r.weight for r in got}
    assert all(abs(weight[s] - plain[s]) < 1e-4 for s in tokens)
    whole = max(t / weight[s] for s, t in tokens.items())  # one pass over the least repeated source
    times = Counter(r.doc_id for r in got)
    for s, d in own.items():
        budget = int(weight[s] * whole * (1 + 1e-12) + 1e-6)  # whole tokens
        passes = budget // tokens[s]
        assert {times[i] for i in d} <= {passes, passes + 1}
        over = sum(n for i, n in d.items() if times[i] > passes)
        assert budget - passes * tokens[s] - 10 <= over + 1 and over <= budget - passes * tokens[s] + 0.01 * budget + 1
    for epoch in {(r.source, r.epoch) for r in got}:
        rows = [r.doc_id for r in got if (r.source, r.epoch) == epoch]
        assert len(rows) == len(set(rows))


def test_few_blocks(spark, monkeypatch):
    """A source of more tokens than its blocks hold: blocks grow, nothing is lost."""
    monkeypatch.setattr(mixing, "BLOCKS", 3)
    got = mix_sources(spark, _docs(spark), entropy=0.9, repeats=8.0, block=5).collect()
    assert {r.doc_id for r in got} == set(range(760)) and max(Counter((r.doc_id, r.epoch) for r in got).values()) == 1
