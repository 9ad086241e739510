"""Votes on nested JSON against a plain recursion."""

import json
import random

from tallyweave.operators import nested_votes

VOTES = "document string, voter int, payload string"


def settle(values):
    """(agreed, value) of what the voters give for one field."""
    if any(isinstance(v, dict) and v for v in values):
        if not all(isinstance(v, dict) and v for v in values):
            return False, None
        return merge(values)
    texts = [json.dumps(v, sort_keys=True) for v in values]
    if len(values) == 1:
        return True, values[0]
    for t, v in zip(texts, values, strict=True):
        if texts.count(t) >= 2:
            return True, v
    return False, None


def merge(objects):
    out, good = {}, True
    for name in {k for o in objects for k in o}:
        own, value = settle([o.get(name) for o in objects])
        good, out[name] = good and own, value
    return good, out


def some(seed):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            return {rng.choice("ab\"é"): value(depth - 1) for _ in range(rng.randint(1, 3))}
        return rng.choice([1, 2.5, "x", "ü\"", None, True, [1, {"b": 2, "a": [3]}], []])

    rows = []
    for d in range(60):
        base = {k: value(3) for k in "pqr"}
        for v in range(1, rng.choice([2, 4, 4])):
            own = json.loads(json.dumps(base))
            if rng.random() < 0.4:
                own[rng.choice("pqrs")] = value(2)
            rows.append((f"d{d}", v, json.dumps(own)))
    return rows


def test_against_a_plain_recursion(spark):
    rows = some(1) + [("bad", 1, "{"), ("bad", 2, "[1]"), ("bad", 3, None), ("one", 1, '{"a": {"b": 1}}'), ("one", 2, "nothing"), ("none", 1, "{}"), ("none", 2, "{}"), ("void", 1, '{"a": {}}'), ("void", 2, '{"a": {}}')]
    found = {r.document: r for r in nested_votes.reconciled(spark.createDataFrame(rows, VOTES)).collect()}
    by = {}
    for d, _, payload in rows:
        try:
            told = json.loads(payload or "")
        except ValueError:
            told = None
        by.setdefault(d, []).append(told)
    for d, told in by.items():
        good = [t for t in told if isinstance(t, dict)]
        assert found[d].bad == len(told) - len(good)
        if not good:
            assert (found[d].status, found[d].payload) == ("failed", None)
            continue
        agreed, want = merge(good)
        assert (found[d].payload is not None) == agreed, (d, good, found[d])
        if agreed:
            same = lambda x: {k: y for k, v in x.items() if (y := same(v)) is not None} if isinstance(x, dict) and x else x
            assert same(json.loads(found[d].payload)) == same(want)
            alike = len({json.dumps(same(g), sort_keys=True) for g in good}) == 1
            assert found[d].status == ("auto_approved" if alike else "majority_agreed")
        else:
            assert found[d].status == "escalated_to_user" and found[d].disagreed > 0


def test_no_votes(spark):
    assert nested_votes.reconciled(spark.createDataFrame([], VOTES)).count() == 0
