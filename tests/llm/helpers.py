"""Small tables with every awkward case, and brute-force references."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi pi rho sigma tau ypsilon phi chi psi omega".split()

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls, blanks, a very long text, ties, repeated rows, odd characters."""
    rows = [(i, prose(i, 80 + i), "en", f"s{i % 3}") for i in range(24)]
    rows += [
        (100, None, "en", "s0"),
        (101, "", None, None),
        (102, " \n\t ", "de", None),
        (103, prose(3, 90_000), "en", "s1"),
        (104, prose(4, 84), "en", "s1"),
        (105, prose(4, 84), "en", "s2"),
        (105, prose(4, 84), "en", "s2"),
        (None, prose(51, 70), None, "s1"),
        (None, prose(61, 70), "fr", "s1"),
        (106, "é̀ Ünïcode İSTANBUL ſ K 🎉🎉 日本語 " * 20, "xx", "s2"),
        (107, "word", "en", "s2"),
        (108, "a\x00b\x1cc d\x85e", "en", "s2"),
    ]
    return [(*r, len(r[1] or "")) for r in rows]


def table(spark, rows=None, clash=()):
    """The rows as ``documents``, with further columns of the given names."""
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    for name in clash:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
