"""Mixing of sources to target weights.

A source with share p of the tokens gets the weight p**a, normalised. The exponent a
falls from 1 (proportional) towards 0 (uniform) as far as needed for the target entropy,
but no further than the repetition limit allows; both are found by bisection (in 32 parts
a round, each round one aggregate over the sources, which never leave the cluster).

Weights become token budgets. A source's documents are dealt to blocks by a hash; each
epoch takes the blocks in a permutation of its own, the last one as far as the budget
goes, its last block document by document. So only blocks are ordered within a source, a
bounded number of them, and a source that holds any part of the rows is spread over them.

Without a budget, the total is what gives the least repeated source exactly one pass: no
document is left out.

Cases: null source: a source of its own. Null or empty text: no tokens; such documents
come once, with the first epoch. Null doc_id: dealt like any other. Repeated rows: each
counts. No rows or no tokens: weights are null and every row comes once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.llm.scratch import Scratch

#: Target entropy as a part of that of equal weights; most passes over a source.
ENTROPY, REPEATS = 0.97, 4.0
#: Tokens in a block at least, and blocks of a source at most: what is ordered in one task.
BLOCK, BLOCKS = 1_000_000, 1 << 16
#: Parts of a bisection round, and rounds.
PARTS, ROUNDS = 32, 5
SPACE = r"[ \t-\r]+"


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def exponent(sources: DataFrame, total: int, entropy: float, repeats: float, budget: int | None) -> float:
    """The largest exponent that reaches the entropy, raised until the repetition limit holds.

    sources: (tokens) of each source with tokens.
    """
    share = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def state(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy as a part of the greatest, most repeats) for each exponent."""
        a = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("a")
        w = F.pow("p", F.col("a"))
        row = share.select("p", a).groupBy("a").agg(
            F.sum(w).alias("z"), F.sum(w * F.ln("p")).alias("l"), F.max(w / F.col("p")).alias("hi"), F.min(w / F.col("p")).alias("lo"), F.count("*").alias("k")
        )
        out = {}
        for r in row.collect():  # PARTS + 1 rows
            h = math.log(r["z"]) - r["a"] * r["l"] / r["z"]
            most = r["hi"] / r["lo"] if budget is None else budget / total * r["hi"] / r["z"]
            out[r["a"]] = (h / math.log(r["k"]) if r["k"] > 1 else 1.0, most)
        return [out[x] for x in exponents]

    def bisect(ok) -> float:
        """Largest exponent with ok (which holds towards 0), 0 if none."""
        low, high = 0.0, 1.0
        if ok(*state([high])[0]):
            return high
        for _ in range(ROUNDS):
            at = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
            fits = [ok(*s) for s in state(at)]
            last = max((i for i, f in enumerate(fits) if f), default=0)
            low, high = at[last], at[min(last + 1, PARTS)]
        return low

    wanted = bisect(lambda h, _: h >= entropy)
    limited = bisect(lambda _, most: most > repeats)  # at this exponent or below, the limit breaks
    return wanted if limited == 0.0 and state([0.0])[0][1] <= repeats else max(wanted, min(1.0, limited + PARTS**-ROUNDS))


def mix_sources(spark: SparkSession, docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, position), a row each time a document is taken.

    position in [0, 1): sorting by it interleaves the sources at their weights.
    """
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text").cast("string")).alias("n_tokens"))
    rows = scratch.table(rows)
    sources = scratch.table(rows.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    empty = rows.where("n_tokens = 0").selectExpr("doc_id", "source", "n_tokens", "CAST(NULL AS DOUBLE) AS weight", "0L AS epoch", "0.0D AS position")
    if not total:
        return empty
    a = exponent(sources, total, entropy, repeats, budget)
    raw = sources.select("source", "tokens", F.pow(F.col("tokens") / float(total), F.lit(a)).alias("w"))
    z, least = raw.agg(F.sum("w"), F.min(F.col("w") / F.col("tokens"))).first()
    whole = float(budget) if budget is not None else z / least
    plan = raw.select("source", "tokens", (F.col("w") / z).alias("weight"), F.floor(F.col("w") / z * whole * (1 + 1e-12) + 1e-6).alias("budget"))
    plan = plan.withColumn("blocks", F.least(F.ceil(F.col("tokens") / block), F.lit(BLOCKS)))
    salt = lambda *cols: F.xxhash64(*cols, F.lit(seed))
    dealt = rows.where("n_tokens > 0").alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source"))
    dealt = dealt.select("doc_id", "r.source", "n_tokens", F.pmod(salt(F.coalesce("doc_id", F.lit(-1))), F.col("blocks")).alias("block"))
    dealt = scratch.table(dealt)
    size = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    turn = size.alias("s").join(plan.alias("p"), F.expr("s.source <=> p.source")).select("s.*", "weight", "tokens", "budget")
    turn = turn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("budget") / F.col("tokens")))).alias("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(salt("block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("epoch") * F.col("tokens"))
    turn = turn.where("start < budget").withColumn("cut", F.col("start") + F.col("size") > F.col("budget"))
    taken = dealt.alias("d").join(turn.alias("t"), F.expr("d.source <=> t.source AND d.block = t.block"))
    taken = taken.select("doc_id", "d.source", "n_tokens", "weight", "epoch", "t.block", "start", "cut", "budget")
    # the block where a budget ends: its documents as far as they fit
    inner = Window.partitionBy("source", "epoch", "block").orderBy(salt("doc_id", "epoch"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = taken.where("cut").withColumn("end", F.col("start") + F.sum("n_tokens").over(inner)).where("end <= budget").drop("end")
    full = taken.where("NOT cut").unionByName(last)
    jitter = F.pmod(salt("doc_id", "epoch"), F.lit(1 << 20)) / float(1 << 20)
    position = (F.col("start") + jitter) / F.col("budget")
    return full.select("doc_id", "source", "n_tokens", "weight", "epoch", position.alias("position")).unionByName(empty)
