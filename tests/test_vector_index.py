"""Answers of the index are those of a full scan, whatever the vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import vector_index as vi
from tallyweave.operators.materialize import new_folder

ROWS = "id long, embedding array<float>, kind string"


def some(n, size=12, seed=0, groups=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size)) * 5
    v = (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, size))).astype(np.float32)
    v[n // 2 : n // 2 + n // 3] = v[0]  # a third of all rows are alike
    return [(k, v[k].tolist(), "even" if k % 2 == 0 else "odd") for k in range(n)]


def scan(rows, queries, limit):
    x = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v is not None and len(v) == 12 and all(c is not None and np.isfinite(c) for c in v)}
    out = {}
    for q, v in queries:
        if v is not None and len(v) == 12 and np.isfinite(v).all():
            near = sorted((float(np.sqrt(((x[i] - np.array(v, np.float32).astype(float)) ** 2).sum())), i) for i in x)
            out[q] = [i for _, i in near[:limit]]
    return out


def told(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture
def index(spark):
    rows = some(900) + [(2000, None, "odd"), (2001, [1.0], "odd"), (2002, [float("nan")] * 12, "odd"), (2003, [None] * 12, "odd")]
    return rows, vi.build(spark.createDataFrame(rows, ROWS), new_folder(spark, "test"))


def test_every_answer(spark, index, monkeypatch):
    rows, made = index
    queries = [(i, v) for i, v, _ in rows[:900:20]] + [(5000, [0.0] * 12), (5001, None), (5002, [1.0])]
    df = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    want = scan(rows, queries, 7)
    found = vi.search(made, df, 7)
    assert told(found) == want
    assert found.agg(F.avg("cells_read")).first()[0] < 0.7 and len(made.cells) > 8
    monkeypatch.setattr(vi, "TILE", 16)  # hot cells are cut
    assert told(vi.search(made, df, 7)) == want


def test_filters_come_before_the_limit(spark, index):
    rows, made = index
    queries = [(i, v) for i, v, _ in rows[:900:60]]
    df = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    assert told(vi.search(made, df, 5, where=F.col("kind") == "odd")) == scan([r for r in rows if r[2] == "odd"], queries, 5)
    assert told(vi.search(made, df, 5, where=F.col("id") < 3)) == scan(rows[:3], queries, 5)


def test_only_folders_of_needed_cells_are_read(spark, index):
    rows, made = index
    one = spark.createDataFrame([(0, rows[3][1])], "query_id long, embedding array<float>")
    found = vi.search(made, one, 2)
    assert len(told(found)[0]) == 2 and 0 < found.first().cells_read < 0.5
    assert made.rows(spark).count() == 904 and made.rows(spark).where("_cell = -1").count() == 4


def test_no_rows_or_no_queries(spark):
    made = vi.build(spark.createDataFrame([], ROWS), new_folder(spark, "test"))
    one = spark.createDataFrame([(0, [1.0] * 12)], "query_id long, embedding array<float>")
    assert vi.search(made, one, 2).count() == 0
    made = vi.build(spark.createDataFrame(some(30), ROWS), new_folder(spark, "test"))
    assert vi.search(made, one.limit(0), 2).count() == 0
