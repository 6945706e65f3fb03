import hashlib
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillfold.llm.chat_format import format_chat, read_loss, read_turns, running_sums

SCHEMA = "conv_id long, turn long, role string, text string, n string"
PIECES = ["&", "&a", "<s>", "</s>", "[ROLE user]", "[AND]", "]", "<", "[", "\n", "x", "é😀", "&lt;", "assistant", " "]
TEXT = st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=6).map("".join))


def back(spark, rows):
    df = format_chat(spark.createDataFrame([(*r, "z") for r in rows], SCHEMA))
    out = df.select("conv_id", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.t], r.l) for r in out}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "a]b<", ""])), TEXT), min_size=1, max_size=8), min_size=1, max_size=60))
def test_round_trip(spark, convs):
    rows = [(c, i, role, text) for c, turns in enumerate(convs) for i, (role, text) in enumerate(turns)]
    got = back(spark, rows)
    for c, turns in enumerate(convs):
        plain = [(r or "", t or "") for r, t in turns]
        assert got[c] == (plain, "".join(t for r, t in plain if r == "assistant"))


def test_ties_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 0, "assistant", "x")]
    got = back(spark, rows)
    assert got[1] == ([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")], "")
    assert got[None] == ([("assistant", "x")], "x")


def test_no_rows(spark):
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_adjacent_turns_share_a_header(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", "")], SCHEMA)
    assert format_chat(df).first().formatted == "<s>[ROLE user]a[AND]b</s>[ROLE assistant]c</s>"


def test_query_digests(spark):
    from quillfold.llm.queries import op4_chat_format

    row = op4_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_long_conversations(spark):
    """Thousands of turns, and a long text, against plain sums."""
    turns = [(1, i, "assistant" if i % 3 else "user", f"text [{i}] " * (1 + i % 4)) for i in range(6000)]
    turns += [(2, 0, "user", "q"), (2, 1, "assistant", "<é>" * 200_000)]
    got = {r.conv_id: r for r in format_chat(spark.createDataFrame([(*r, "z") for r in turns], SCHEMA)).collect()}
    for conv in (1, 2):
        mask = [(m.start, m.length) for m in got[conv].loss_mask]
        said = [t for c, _, role, t in turns if c == conv and role == "assistant"]
        code = {"&": "&a", "<": "&l", "[": "&b", "]": "&c"}
        escaped = ["".join(code.get(ch, ch) for ch in t) for t in said]
        assert [got[conv].formatted[a : a + n] for a, n in mask] == escaped
    assert back(spark, turns)[1][0] == [(role, t) for c, _, role, t in turns if c == 1]


def test_running_sums(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7],), ([],), ([5],), (list(range(1000)),)], "x array<bigint>")
    for r in df.select("x", running_sums(F.col("x")).alias("s")).collect():
        assert r.s == list(itertools.accumulate(r.x))
