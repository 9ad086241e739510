"""Rows that repeat, id and text alike, and tasks that are run again."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyweave.llm import packing, shards
from tests.llm.test_operators import texts

DOCS = "doc_id long, text string"


def test_boundaries_of_pairs():
    rng = np.random.default_rng(3)
    bounds = np.unique(rng.integers(0, 5, (12, 2)), axis=0)
    k2, k3 = rng.integers(-1, 6, 300), rng.integers(-1, 6, 300)
    want = [sum((b[0], b[1]) <= (x, y) for b in bounds.tolist()) for x, y in zip(k2.tolist(), k3.tolist(), strict=True)]
    assert shards.after(bounds, k2, k3).tolist() == want


def test_repeated_rows_are_subdivided(spark):
    rows = [(7, "the same")] * 4000 + [(k, t) for k, t in enumerate(texts(3, 200))]
    found = shards.sharded(spark.createDataFrame(rows, DOCS), per_range=40, fewest=40).toPandas()
    own = found[found.doc_id == 7]
    assert own.range.nunique() > 5 and len(found) == 4200
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 4 * found["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))


def test_repeated_rows_are_packed_everywhere(spark):
    df = spark.createDataFrame([(None, "the same text")] * 3000 + [(k, t) for k, t in enumerate(texts(5, 100))], DOCS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        found = packing.packed(df).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = (found[found.doc_id.isna()].sequence_id.to_numpy() >> 40)
    assert len(set(tasks.tolist())) > 1 and len(found) == 3100
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 2048


def test_blocks_are_the_same_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    df = spark.createDataFrame(list(enumerate(texts(6, 400))) + [(500, "long " * 9000)], DOCS).repartition(3).orderBy("doc_id")
    once, again = (packing.packed(df).toPandas().sort_values(["doc_id", "start"]).reset_index(drop=True) for _ in range(2))
    pd.testing.assert_frame_equal(once, again)
    assert (once[once.length == 2048].sequence_id >= packing.WHOLE).all() and (once.length == 2048).sum() >= 4
    assert once.groupby("sequence_id").length.sum().max() <= 2048


def test_an_empty_table_has_no_shards(spark):
    assert shards.sharded(spark.createDataFrame([], DOCS)).select(F.count("*")).first()[0] == 0


def test_both_expressions_cut_alike():
    rng = random.Random(1)
    characters = "".join(chr(c) for c in range(0x250) if not packing.FAST.search(chr(c))) + " ''''tsdmrevl_09  \n" * 9
    for _ in range(5000):
        text = "".join(rng.choice(characters) for _ in range(30))
        assert packing.FAST_PIECES.findall(text) == packing.PIECES.findall(text)
