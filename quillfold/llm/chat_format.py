"""Conversations as training text with a loss mask, by Spark expressions only.

A conversation's turn structs are collected and sorted; adjacent turns of one role share
one header and one end mark; the pieces are joined to one string:

    <s> [ROLE role] text [AND] text </s> [ROLE role] text </s>   (without the spaces)

Texts and roles can't forge a mark: `&`, `<`, `[` and `]` are written `&a`, `&l`, `&b`
and `&c`, and every mark begins with `<` or `[`. The loss mask is a list of runs over the code
points of the string, in order, that cover exactly the assistants' texts.

Reading back takes the string apart at its marks alone.

Cases: null text: empty. Null role: an empty role. Null turn: sorts first. Equal turns
sort by role, then text. Null conv_id: one conversation of its own. Repeated rows: a turn
each. No rows: no conversations. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the template: fixed values.
BEGIN = "<s>"
ROLE, ROLE_END = "[ROLE ", "]"
AND = "[AND]"
END = "</s>"
LOSS_ROLE = "assistant"
#: Rounds of running sums: enough for any array, whose entries of eight bytes are fewer than 8**10.
ROUNDS = 10
#: In this order; undone from last to first.
ESCAPES = (("&", "&a"), ("<", "&l"), ("[", "&b"), ("]", "&c"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chat(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, formatted, loss_mask).

    loss_mask: array<struct<start, length>> of code points of formatted, from 0.
    """
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    conv = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def pieces(turns: Column) -> Column:
        role = lambda i: F.get(turns, i)["role"]  # noqa: E731  null outside the array

        def piece(t: Column, i: Column) -> Column:
            # the merge: a turn opens a message unless the one before has its role
            opens = ~F.coalesce(role(i - 1) == t["role"], F.lit(False))
            ends = ~F.coalesce(role(i + 1) == t["role"], F.lit(False))
            return F.struct(
                F.when(opens, F.concat(F.lit(ROLE), escape(t["role"]), F.lit(ROLE_END))).otherwise(F.lit(AND)).alias("head"),
                escape(t["text"]).alias("body"),
                F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("tail"),
                (t["role"] == F.lit(loss_role)).alias("loss"),
            )

        return F.transform(turns, piece)

    def runs(parts: Column) -> Column:
        """The mask, by the places where parts end."""
        size = lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long")

        def of(ends: Column) -> Column:
            at = lambda p, i: F.lit(len(BEGIN)) + F.get(ends, i) - size(p) + F.length(p["head"])
            every = F.transform(parts, lambda p, i: F.struct(at(p, i).alias("start"), F.length(p["body"]).cast("long").alias("length"), p["loss"].alias("loss")))
            return F.transform(F.filter(every, lambda r: r["loss"] & (r["length"] > 0)), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))

        return _let(running_sums(F.transform(parts, size)), of)

    text = lambda parts: F.concat(F.lit(BEGIN), F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], p["tail"])), ""))
    both = _let(F.col("turns"), lambda t: _let(pieces(t), lambda parts: F.struct(text(parts).alias("formatted"), runs(parts).alias("loss_mask"))))
    return conv.select("conv_id", both.alias("_")).select("conv_id", "_.formatted", "_.loss_mask")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: a column named in a lambda can be computed for each entry."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column) -> Column:
    """Sums up to each entry of an array<bigint>: a round adds the seven entries 1, 8, 64, ... apart before it."""

    def adding(step: int) -> Callable[[Column], Column]:
        def add(sums: Column) -> Column:
            def more(v: Column, i: Column) -> Column:
                for j in range(1, 8):
                    v = v + F.coalesce(F.get(sums, i - j * step), F.lit(0).cast("long"))
                return v

            return F.when(F.size(sums) > step, F.transform(sums, more)).otherwise(sums)

        return add

    for k in range(ROUNDS):
        values = _let(values, adding(8**k))
    return values


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, in order: array<struct<role, text>>."""
    whole = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    messages = F.filter(F.split(whole, END), lambda m: m != "")

    def turns(m: Column) -> Column:
        role = unescape(F.substring(F.split_part(m, F.lit(ROLE_END), F.lit(1)), len(ROLE) + 1, 2**31 - 1))
        texts = F.split(F.substring(m, F.position(F.lit(ROLE_END), m) + 1, F.length(m)), r"\[AND\]")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    cut = lambda r: F.substring(formatted, (r["start"] + 1).cast("int"), r["length"].cast("int"))
    return unescape(F.array_join(F.transform(loss_mask, cut), ""))
