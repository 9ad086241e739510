"""The registered queries and the pipeline over the driver's tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tallyweave.llm import decontamination, personal_data, registry, secret_scan, toxicity, words
from tallyweave.llm.common import table

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    want = found.fetchdf()[names].astype(str).sort_values(names).reset_index(drop=True)
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    pd.testing.assert_frame_equal(df.toPandas()[names].astype(str).sort_values(names).reset_index(drop=True), want)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_a_row_a_document(spark, name, documents):
    rows = registry.queries()[name](spark, SF).toPandas()
    if name.startswith(("op3_", "op13_")):
        assert rows.vec_id.is_unique and len(rows) == 500
    elif name.startswith("op7_"):
        assert set(rows.doc_id) == set(documents.index)
    else:
        assert rows.doc_id.is_unique and set(rows.doc_id) == set(documents.index)


def test_secrets_query(spark, documents):
    for r in registry.queries()["op10_secret_scan"](spark, SF).collect():
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256, r.spans) == secret_scan.brute(documents.text[r.doc_id])


def test_held_out_accuracy(spark):
    docs = table(spark, BIG, "documents")
    found = registry.queries()["op1_toxicity"](spark, BIG).toPandas()
    labels = pd.read_parquet(f"{BIG}/labels.parquet")
    both = found[found.held_out].merge(labels, on="doc_id")
    hit, said, true = ((both.predicted == 1) & (both.toxic == 1)).sum(), (both.predicted == 1).sum(), (both.toxic == 1).sum()
    assert len(found) == docs.count() and hit / said > 0.85 and hit / true > 0.85


def test_pipeline(spark, documents):
    """Each stage against what a plain version keeps of its own input."""
    docs, labels, benchmark = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        if name == "packing":
            assert set(r.doc_id for r in out.select("doc_id").collect()) == set(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
            assert set(after) == {k for k in before if scores[k] < 0.5}
        elif name == "near_duplicates":
            from tests.llm.test_operators import brute_classes

            ids = sorted(before)
            roots = brute_classes([before[k] for k in ids])
            assert set(after) == {ids[r] for r in roots}
        elif name == "decontamination":
            told = {d: (n, hit) for d, n, hit, *_ in decontamination.brute(list(before.items()), items)}
            assert set(after) == set(before)
            assert all(len(words.of_text(after[k].text)) == n - hit if hit else after[k].text == before[k] for k, (n, hit) in told.items())
        elif name == "personal_data":
            spans = {r.doc_id: len(r.spans) for r in personal_data.personal_spans(docs).collect()}
            assert set(after) == set(before) and all((after[k].text == before[k]) == (spans[k] == 0) for k in before)
        assert all(r.n_chars == len(r.text) for r in after.values())
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_whole_run(spark, documents):
    found = corpus_pipeline.run(spark, SF).toPandas()
    assert 0.5 < found.doc_id.nunique() / len(documents) < 1
    assert np.all(found.groupby("sequence_id").length.sum() <= 2048)
