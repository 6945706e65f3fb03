"""Small odd inputs for every operator: nulls, empties, repeats, ties, long texts, clashing columns."""

import random

#: Names that operators use inside.
CLASHING = ["n", "sig", "host", "th", "line", "block", "bucket", "kind", "words", "doc", "at", "size", "tokens", "item", "gram", "h", "k", "digest", "entry"]

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def texts():
    passage = prose("passage", 60)
    base = prose("base", 200)
    near = base.split()
    near[100] = "changed"
    return [
        (1, base),
        (2, " ".join(near)),
        (3, base.upper()),
        (4, base),
        (4, base),  # a repeated row
        (5, None),
        (6, ""),
        (7, " \t\n "),
        (8, "one two three"),
        (9, "One  two\tthree"),
        (10, prose(10, 80) + "\n" + passage + "\n" + prose(11, 30)),
        (11, passage + " " + prose(12, 500)),
        (12, prose(13, 20_000)),
        (13, "é ß\u00a0x ñ 漢字 😀 " * 30),
        (None, "a row without an id " * 5),
        (None, None),
        (14, "x" * 30_000),
        (15, prose(15, 34)),
        (16, prose(15, 34)),
        (17, (prose("rep", 40) + "\n") * 3),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    langs, sources = ["en", "fr", None], ["a", "b", None]
    data = [(i, t, langs[j % 3], sources[j % 3], None if t is None else len(t), *["z"] * len(CLASHING)) for j, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema)
