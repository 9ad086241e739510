"""Shingles that a text repeats more often than 16 bits tell."""

import pytest

from tallyweave.llm import weighted_minhash
from tests.llm.test_operators import table


@pytest.mark.parametrize("chunk", [1000, 2])
def test_very_repetitive_texts(spark, chunk):
    # Similar by a half, so most pairs share a band; none may be linked. The last pair is similar by more than 0.8.
    rows = [f"{w} " * n for w in "abcdefgh" for n in (100_000, 200_000)] + ["z " * 100_000, "z " * 100_500]
    found = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(table(spark, rows), chunk=chunk).collect()}
    assert found == {k: k for k in range(17)} | {17: 16}


def test_rows_of_a_kept_id_stay(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, "one two three"), (2, "one two three"), (None, "one two three"), (3, "four")]
    kept = weighted_minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 3]
