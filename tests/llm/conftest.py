import random

import pytest

SCHEMA = "doc_id long, text string, chunk int, bucket string, words string, score double, tokens string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, shared ids, near copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(160)]
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "one two three"), (5, "One TWO three"), (6, " ".join(base)), (7, " ".join(base)), (8, " ".join(base).upper())]
    for i in range(12):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((20 + i, " ".join(w)))
    rows += [(40, "x" * 50_000), (41, "word " * 6_000), (42, " ".join(rng.choice(vocabulary) for _ in range(20_000)))]
    rows += [(50, " ".join(base[:90])), (51, "start " + " ".join(base[30:120]) + " end"), (60, "a b c d e f"), (60, "a b c d e f"), (None, " ".join(base)), (None, None), (70, "<|endoftext|> It's ÀÉ\x00\x1c ΑΣ 中文😀")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "b", "w", 0.5, None) for i, t in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folded(df, *cols):
    """Rows as a sorted list, nulls first."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="session")
def listed():
    return folded
