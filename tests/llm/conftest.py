from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
#: A documents-like table with awkward rows: nulls, empty text, repeats, clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, row string, value string, score double"


@pytest.fixture(scope="session")
def awkward(spark):
    long = "one two three four five six seven " * 4000
    rows = [
        (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "   \n\t ", None, "s", 6),
        (4, long, "en", "s", len(long)), (None, "the quick brown fox jumps over", "en", "s", 1), (None, "the quick brown fox jumps over", "en", "s", 1),
        (5, "the quick brown fox jumps over", "en", "s", 1), (5, "the quick brown fox jumps over", "en", "s", 1), (6, "1234 !!! ###", "en", "s", 2),
        (7, "über größe straße　中文 \U0001f600", "de", "s", 3),
    ]
    return spark.createDataFrame([(*r, 9, "r", "v", 0.5) for r in rows], SCHEMA)
