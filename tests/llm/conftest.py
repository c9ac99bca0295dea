import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_helpers import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep string, rep int, token_ids string, slot string, _toxic int, word string, `a.b` string, TEXT string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and
    columns whose names clash with those of results."""
    extra = ("x", "y", 7, "z", "w", 1, "v", "dotted", "capital")
    rows = [
        (1, prose(1, 80), "en", "a", 500),
        (2, prose(1, 80), "en", "a", 500),
        (2, prose(1, 80), "en", "a", 500),
        (3, None, "en", "a", 0),
        (4, "", None, None, None),
        (5, " \n\t ", "de", "b", 3),
        (None, prose(5, 60), None, "b", 300),
        (None, None, None, None, None),
        (6, prose(6, 30_000), "fr", "c", 200_000),
        (7, "ß" * 70_000, "de", "c", 70_000),
        (8, "a", "en", None, 1),
        (9, "!!! ??? ...", "en", "c", 11),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
