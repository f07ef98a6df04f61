from __future__ import annotations

import pytest

PASSAGE = (
    "Anna went to the market and bought a lot. Then she came back home with all of it in her bag. She cooked and ate with all her friends. "
    "They had a great time and laughed until late in the night. All of them slept well after this day was over."
)
#: Nulls, blanks, one character, odd scripts, special strings, repeated rows, copies, a long text, a text of one long word.
ODD = [
    (0, "The quick brown fox jumps over the lazy dog and runs far away from here."),
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here."),
    (2, None), (3, ""), (4, "   \n\t "), (5, "x"), (6, "naïve — 漢字 🙂🙃 <|endoftext|> it's  we'll\n\nend"), (7, "a\x1cb\x85c\xa0d"),
    (8, "mail joe.doe@example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.0.0.255."),
    (9, "start " + PASSAGE + " tail words"), (10, "other beginning " + PASSAGE + " and more of it"), (10, "other beginning " + PASSAGE + " and more of it"),
    (None, "row without an id " + PASSAGE), (11, "word " * 6000), (12, "z" * 30_000), (13, "<s> ▁▁ double  space ▁"), (14, "\0 zero"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, `group` string, ids string, doc long, version long, cut string, tk string, cuts string, line int, fp long, score double, label int, start long"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use inside."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, "src0", len(t) if t is not None else None, "k", 1, "g", "z", 1, 2, "c", "t", "u", 3, 4, 0.5, 1, 9) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
