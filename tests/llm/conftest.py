"""Small tables with every odd case: nulls, empty, long and repeated texts, clashing columns."""

import pytest

WORDS = "the of and in to a is that for it was on are as with his they at be this from have or by one had not but what all".split()


def prose(seed: int, n: int) -> str:
    out = []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(seed >> 33) % len(WORDS)] + ("x" * ((seed >> 50) % 3)) + str((seed >> 40) % 97))
    return " ".join(out)


LONG = " ".join(prose(i, 500) for i in range(40))

DOCS = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),  # an exact copy
    (3, prose(1, 120).replace(prose(1, 120).split()[60], "changed", 1)),  # a near copy
    (4, None),
    (5, ""),
    (6, "  \t\n "),
    (7, "one"),
    (8, prose(2, 19)),
    (9, prose(3, 20) + " " + prose(3, 20)),  # repeats itself
    (10, LONG),
    (11, "Ünïcode Straße 日本語 текст " * 8),
    (12, prose(4, 30) + " " + prose(1, 120)[:400]),
    (12, prose(4, 30) + " " + prose(1, 120)[:400]),  # a repeated row
    (13, prose(5, 60)),
    (-3, prose(6, 40)),
    (None, prose(7, 25)),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t) if t else None, "x", 1, 2, 3) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, part int, fp int, row int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tokenizers_dir():
    return pytest.importorskip("public_tokenizers")
