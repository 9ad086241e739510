"""Nested votes: fields are dealt out by document once, and levels are taken apart several at a time."""

import json

import pytest

from tallyweave.operators import nested_votes

from .test_nested_votes import VOTES, some


def deep(levels):
    return json.dumps({"a": deep_value(levels), "b": 1})


def deep_value(levels):
    return {"n": deep_value(levels - 1)} if levels else [1, None]


def test_fields_are_dealt_out_once(spark):
    rows = [(f"d{d}", v, json.dumps({"who": {"k": d, "t": "x"}, "large": v == 3})) for d in range(20) for v in (1, 2, 3)]
    found = nested_votes.fields(spark.createDataFrame(rows, VOTES))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.document, *r.path, r.value) for r in found.collect()} == {x for d in range(20) for x in ((f"d{d}", "who", "k", str(d)), (f"d{d}", "who", "t", '"x"'), (f"d{d}", "large", "false"))}


@pytest.mark.parametrize("levels", [1, 3])
def test_levels_at_a_time(spark, monkeypatch, levels):
    rows = some(3) + [("deep", v, deep(9)) for v in (1, 2)] + [("split", 1, deep(9)), ("split", 2, deep(8)), ("split", 3, deep(9)), (None, 1, "{}")]
    votes = spark.createDataFrame(rows, VOTES)
    want = sorted(map(str, nested_votes.reconciled(votes).collect()))
    monkeypatch.setattr(nested_votes, "LEVELS", levels)
    monkeypatch.setattr(nested_votes, "EACH", 20)
    assert sorted(map(str, nested_votes.reconciled(votes).collect())) == want
    told = {r.document: r for r in nested_votes.reconciled(votes).collect()}
    assert json.loads(told["deep"].payload) == json.loads(deep(9)) and told["split"].payload is None and told["split"].disagreed == 2
