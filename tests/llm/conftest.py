import pytest

WORDS = "the of and in to harbour lantern copper meadow signal quiet river amber cobalt winter marble orchard".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % 2**32 or 1
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 97 if x % 3 else ""))
    return " ".join(out)


CLASHING = {name: "x" for name in ("fp", "same", "copy", "part", "label", "kind", "length", "n", "block", "gram", "value", "shard", "hits", "piece", "_text", "_row", "score", "held_out", "row_key", "n_chars", "_list", "_clean", "_kept", "kept_row", "spans", "n_hex", "n_assign", "n_access", "base_sha256", "doc", "list", "key", "size", "buckets", "component", "word", "w", "i", "h")}


def make(spark, rows):
    """Documents from (id, text) with more columns, some named like inner ones."""
    full = [(i, t, "en", None, *CLASHING.values()) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, ties, repeated rows and ids, a very long text, other letters."""
    a, b = sentence(1, 80), sentence(2, 60)
    return [
        (1, a), (2, None), (3, ""), (4, " \n\t "), (5, a), (5, a), (6, b), (6, a), (None, b), (None, None), (7, "one"), (8, "Ünïcode ſtraße 😀 " * 30),
        (9, sentence(3, 20_000)), (10, a + " tail"), (11, "x" * 50_000), (12, a.upper()),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
