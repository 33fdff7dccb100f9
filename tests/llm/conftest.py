from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, keys array<long>, class_id long, __drop_keys string, Stratum string"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls in every column, an empty, a blank and a long text, repeated rows, and columns that clash with inner names."""
    long = " ".join(f"word{k % 977} and{k % 31}" for k in range(20_000)) + "\nshared line of text here"
    prose = "\n".join(f"this is line {k} of the first text, as plain as can be" for k in range(12))
    rows = [
        (1, prose, "en", "src0", len(prose)),
        (1, prose, "en", "src0", len(prose)),
        (2, None, "en", "src1", None),
        (3, "", None, None, 0),
        (4, " \t\n ", "de", "src1", 4),
        (5, long, "en", "src2", len(long)),
        (None, prose, "en", "src0", len(prose)),
        (6, "Shared line of text here\npassword = hunter2hunter", "fr", "src3", 48),
        (7, prose.replace("line 7", "row 7"), None, "src0", None),
        (8, "é" * 5000 + "\x00 🙂 <|endoftext|> é", "fr", "src3", 5019),
    ]
    return spark.createDataFrame([(*r, [1], 7, "x", "y") for r in rows], DOCUMENT)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, None, 0), (None, 1, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
