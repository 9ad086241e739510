"""Operator 13 against all entries of each codebook, in Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tallyweave.llm import vector_codes as vc

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=vc.ROUNDS):
    """(id, code, error, label error, hash) of each usable row."""
    kept = [(i, [math.floor(Fraction(x) * vc.SCALE) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    cut = [[(v + [0] * (size - len(v)))[p * size // 8 : (p + 1) * size // 8] for p in range(8)] for _, v, _ in kept]
    first = {}
    for (i, _, _), own in sorted(zip(kept, cut, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, sum(x[1], []))):
        if i is not None:
            first.setdefault(i, own)
    books = [[own[p] for own in list(first.values())[:16]] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    if not books[0]:
        return sorted(((i, "", 0, 0, hashlib.sha256(b"").hexdigest()) for i, _, _ in kept), key=repr)
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for own in cut:
                members.setdefault(nearest(own[p], book)[1], []).append(own[p])
            books[p] = [[sum(x) // len(x) for x in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(book)]
    told = [[nearest(own[p], books[p]) for p in range(8)] for own in cut]
    errors = [sum(d for d, _ in t) for t in told]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in t), e, by_label[label], digest) for (i, _, label), t, e in zip(kept, told, errors, strict=True)), key=repr)


def found(spark, rows, schema=ROWS, **columns):
    df = spark.createDataFrame(rows, schema).repartition(3)
    for k, v in columns.items():
        df = df.selectExpr("*", f"{v} AS {k}")
    out = vc.compressed(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(((r.vec_id, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in out.collect()), key=repr)


def some(n, size=16, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, size)) * scale).astype(np.float32)
    v[n // 2 :] = v[0]  # a group of copies
    return [(k, v[k].tolist(), None if k % 7 == 0 else k % 3) for k in range(n)]


@pytest.mark.parametrize("size", [8, 16, 64])
def test_against_all_entries(spark, size):
    rows = some(200, size)
    assert found(spark, rows) == brute(rows)


def test_the_annulus_spares_most_distances():
    rng = np.random.default_rng(2)
    parts = rng.integers(-900, 900, (3000, 8))
    parts = parts * rng.integers(1, 60, (3000, 1))  # norms of many sizes
    book = vc.Codebook(parts[:16].copy())
    code, error, evaluated = book.nearest(parts)
    apart = ((parts[:, None] - book.entries[None]) ** 2).sum(2)
    assert (code == apart.argmin(1)).all() and (error == apart.min(1)).all() and evaluated < 0.8 * apart.size


def test_ties_go_to_the_lower_index():
    book = vc.Codebook(np.array([[5, 0], [0, 5], [3, 4], [0, 5], [5, 0]]))
    code, error, _ = book.nearest(np.array([[0, 0], [0, 5], [5, 0], [0, -1], [4, 4]]))
    assert code.tolist() == [0, 1, 0, 0, 2] and error.tolist() == [25, 0, 0, 26, 1]


def test_odd_rows(spark):
    rows = some(30) + [(None, [1.0] * 16, 1), (3, [0.5] * 16, None), (3, [0.5] * 16, None), (40, None, 1), (41, [1.0, None], 1), (42, [float("nan")], 2), (43, [float("-inf")] * 16, 2)]
    rows += [(44, [], 9), (45, [0.25], 9), (-5, [-0.00001] * 3, 9)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, id="1", vector="'v'", code="2", error="'e'", label_error="0", _key="1") == want


def test_few_or_no_vectors(spark):
    assert found(spark, [(2, [1.0] * 8, 1), (1, [3.0] * 8, 1)]) == brute([(2, [1.0] * 8, 1), (1, [3.0] * 8, 1)])
    assert found(spark, [(None, [1.0] * 8, 1)]) == brute([(None, [1.0] * 8, 1)])
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_very_large_components(spark):
    rows = some(60, 8, 5, 3e7)
    assert found(spark, rows) == brute(rows)
    wide = [(k, [x * 1e300 for x in v], label) for k, v, label in some(40, 8)]
    out = vc.compressed(spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int")).collect()
    want = brute(wide)
    assert sorted(r.code for r in out) == sorted(w[1] for w in want) and {r.codebooks_sha256 for r in out} == {want[0][4]}


def test_hot_labels(spark):
    rows = [(k, 1 if k % 3 == 0 else k, 10) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, label int, error long")
    told = {r.id: r.total for r in vc.with_totals(df, "label", "error", "total").collect()}
    assert len(told) == 3000 and told[3] == 10 * sum(1 for r in rows if r[1] == 1) and told[4] == 10
