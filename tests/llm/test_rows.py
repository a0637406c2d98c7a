"""Rows with null or repeated ids: exactly one row of each component stays."""

import random

from chipmeter.llm import simhash
from chipmeter.llm.common import materialise

SCHEMA = "doc_id long, text string, source string"


def repeated_ids(spark):
    rng = random.Random(9)
    text = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    rows = [(1, text[0], "a"), (None, text[0], "b"), (None, text[1], "c"), (7, text[0], "d"), (7, text[2], "e"), (None, text[3], "f"), (None, text[3].upper(), "g")]
    rows += [(8, text[4], "h"), (8, text[4].upper(), "i"), (8, text[4], "j"), (8, text[4], "j")]
    return materialise(spark.createDataFrame(rows, SCHEMA))


def check_rows(left):
    left = sorted((r.doc_id or 0, r.source) for r in left.collect())
    assert [x for x in left if x[1] not in "fghij"] == [(0, "c"), (1, "a"), (7, "e")]
    assert sorted(x[0] for x in left if x[1] in "fghij") == [0, 8]


def test_simhash_with_null_and_repeated_ids(spark):
    check_rows(simhash.deduplicate(repeated_ids(spark)))
