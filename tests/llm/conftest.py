import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, class long, size long, _row string, shard int"


def table(spark, rows, source="src0"):
    """Documents with columns whose names the operators use themselves."""
    full = [(d, t, "en", source if len(r) < 3 else r[2], 0 if t is None else len(t), 1, 2, 3, "x", 4) for r in rows for d, t in [r[:2]]]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Null, empty and blank texts, null and repeated ids, repeated rows, a very long text, near copies."""
    rng = random.Random(3)
    base = prose(rng, 120)
    w = base.split()
    near = " ".join(w[:50] + ["changed"] + w[51:])
    far = " ".join(w[:60] + prose(rng, 60).split())
    long = prose(rng, 30_000)
    rows = [(1, base), (2, near), (3, far), (4, base.upper()), (5, None), (6, ""), (7, " \t\n"), (None, base), (None, "only words without an id"), (8, "one two"), (9, "ONE  two"), (10, long), (11, long + " end"), (12, "é ü  x"), (12, "é ü  x")]
    return rows + [(20 + k, " ".join(["same"] * k)) for k in (3, 25, 60)]
