"""Recall of the spherical caps against all pairs, and vectors of extreme lengths."""

import math

import numpy as np
import pytest

from tallyweave.llm import embedding_links


def all_pairs(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= embedding_links.COSINE
    np.fill_diagonal(close, False)
    return close


@pytest.mark.parametrize("dimension", [16, 64])
def test_recall(spark, dimension):
    rng = np.random.default_rng(dimension)
    centres = rng.standard_normal((1500, dimension))
    # Groups of 1 to 8 whose members lie about the least cosine that counts.
    x = np.concatenate([c + rng.standard_normal((rng.integers(1, 9), dimension)) * rng.uniform(0.05, 0.24) for c in centres])[:6000]
    close = all_pairs(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_links.linked(df).toPandas().sort_values("vec_id")
    links, want = found.n_links.to_numpy(), close.sum(1)
    assert len(x) >= 5000 and want.sum() > 5000
    assert (links <= want).all() and links.sum() >= 0.98 * want.sum()


def test_codes_grow_without_listing_filters():
    sizes = []
    for rows in (10_000, 10_000_000, 10_000_000_000):
        books, threshold = embedding_links.code(64, rows)
        sizes.append(len(books[0]))
        v = np.random.default_rng(rows).standard_normal((20, 64))
        passed = [len(embedding_links.decode((x / np.linalg.norm(x)).astype(np.float32), books, threshold)) for x in v]
        assert 12 <= np.mean(passed) < 120
    assert [round(math.log(n)) for n in sizes] == [round(math.log((3 * r) ** 0.25)) for r in (10_000, 10_000_000, 10_000_000_000)]


def test_extreme_lengths(spark):
    rows = [(0, [1e200, 2e200, 3e200]), (1, [1e-200, 2e-200, 3e-200]), (2, [1.0, 2.0, 3.0]), (3, [3.0, -2.0, 1.0]), (4, [0.0, 0.0, 0.0]), (5, [float("inf"), 1.0, 1.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
