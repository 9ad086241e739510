"""Queries that answer for all rows, where older ones answer for some; their rows are held against their SQL in test_registry."""

import os

import pytest

from tallyweave.functions import text as X
from tallyweave.plans import projections as P
from tallyweave.plans import registry
from tests.test_registry import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def asked(spark, name, column):
    return {r[0] for r in registry.queries()[name](spark, SF).select(column).distinct().collect()}


def test_every_twentieth_vector(spark):
    ids = {r[0] for r in P.table(spark, SF, "embeddings").select("vec_id").collect()}
    assert asked(spark, "nearest_each", "query_id") == {k for k in ids if k % 20 == 0}


def test_every_turn_has_a_window(spark):
    turns = {tuple(r) for r in P.table(spark, SF, "conversations").select("conv_id", "turn").collect()}
    assert {(r.conv_id, r.of_turn) for r in registry.queries()["neighbours"](spark, SF).collect()} == turns


def test_language_of_whole_texts(rows):
    df = rows("text string", ("the of and to " * 800 + "che per con una " * 4000,), ("che per con " * 10,), (None,))
    found = df.select(X.language(df.text), X.file_language(df.text), X.file_language(df.text, 40_000)).collect()
    assert [tuple(r) for r in found] == [("it", "en", "it"), ("it", "it", "it"), ("en", "en", "en")]


def test_all_years_and_positions(spark):
    ledger = P.ledger(spark, SF)
    ids, years = {r[0] for r in ledger.select("id").collect()}, {r[0] for r in ledger.select("tax_year").distinct().collect()}
    assert asked(spark, "duplicate_probe", "name") == ids == asked(spark, "drill_down", "id")
    assert asked(spark, "promotion", "tax_year") == years and len(years) > 2
