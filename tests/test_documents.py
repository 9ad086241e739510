from datetime import datetime
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.api import Engine
from tallyweave.operators import chunking, consensus, masking, reads, retrieval, sessions
from tallyweave.schemas import CHUNKS


def chunk(k, text, jurisdiction="ireland", source="regulation", page=1, embedding=None):
    return (k, "Doc", "sha", jurisdiction, source, "high", page, text, k, None, None, None, embedding)


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([chunk(0, "capital gains tax rate is fixed", embedding=[1.0, 0.0]), chunk(1, "research on capital gains tax", None, "research", 2, [0.0, 1.0]), chunk(2, "exit tax", "IE", "regulation", 3, [0.6, 0.8])], CHUNKS)


def test_keyword(chunks):
    assert retrieval.keyword_search(chunks, "the capital gains").count() == 2
    assert retrieval.keyword_search(chunks, "capital gains", source_type="research").count() == 1
    assert retrieval.keyword_search(chunks, "capital gains", jurisdiction="eire").count() == 1
    assert retrieval.keyword_search(chunks, "exit").count() == 1 and retrieval.keyword_search(chunks, "exit", compat=True).count() == 3
    assert retrieval.keyword_search(chunks, "").count() == 0
    assert retrieval.keyword_search(chunks, "100% tax").count() == 0


def test_knn(spark, chunks):
    assert [r.id for r in retrieval.knn(chunks, [1.0, 0.0], 2).collect()] == [0, 2]
    assert [r.id for r in retrieval.knn(chunks, [1.0, 0.0], 1, source_type="research").collect()] == [1]
    assert [r.id for r in retrieval.knn(chunks, [2.0, 0.0], 2, metric="cosine").collect()] == [0, 2]
    queries = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, embedding array<float>")
    found = retrieval.knn_join(chunks, queries, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in found] == [(8, 1), (8, 2), (9, 0), (9, 2)]
    assert retrieval.knn_join(chunks, queries.limit(0), 2).count() == 0


def test_hybrid(chunks):
    assert retrieval.hybrid(chunks, "capital gains tax", [1.0, 0.0], 2).first().rerank_score == 1.0
    with pytest.raises(ValueError):
        retrieval.hybrid(chunks, "capital gains", [1.0, 0.0], 2)


def test_pages(chunks):
    row = retrieval.page(chunks, "doc", 2).first()
    assert (row.text, row.has_previous, row.has_next) == ("research on capital gains tax", True, True)
    row = retrieval.document_statistics(chunks, "sha").first()
    assert (row.total_pages, row.chunks) == (3, 3)


def test_engine(chunks):
    engine = Engine({"chunks": chunks}, embed=lambda q: [1.0, 0.0])
    assert engine.call("get_surrounding_context", chunk_id=1).count() == 3
    assert engine.query_tax_knowledge("capital gains tax", 1).count() == 1
    assert engine.calculate("0.1 + 0.2") == "0.3"
    with pytest.raises(LookupError):
        engine.get_chunk_content(99)


def test_pooled(spark):
    v = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]],)], "t array<array<float>>").select(retrieval.pooled(F.col("t"))).first()[0]
    assert np.allclose(v, [2**-0.5] * 2)


def test_chunking(spark):
    text = "One two. Three four! Five six? Seven."
    spans = chunking.sentences(text)
    assert [text[a:b] for a, b in spans] == ["One two.", "Three four!", "Five six?", "Seven."]
    assert chunking.packed([5, 5, 20, 1], 10) == [(0, 2), (2, 3), (3, 4)] and chunking.packed([], 3) == []
    rows = chunking.chunked_text(text, child=20, parent=25)
    assert [text[a:b] for (a, b), *_ in rows] == ["One two. Three four!", "Five six? Seven."]
    docs = spark.createDataFrame([("s", text), ("e", ""), ("n", None)], "document_sha string, text string")
    found = chunking.late_chunks(docs, encode=lambda t, spans: np.array([[b - a] for a, b in spans])).collect()
    assert [(r.text_content, r.embedding) for r in found] == [(text, [float(len(text))])]
    pages = spark.createDataFrame([("d", k, "p" * k) for k in range(1, 8)], "document_sha string, page_number int, text string")
    batches = chunking.page_batches(pages).orderBy("batch").collect()
    assert [len(b.ranges) for b in batches] == [5, 2]
    df = spark.createDataFrame([batches[0]]).select(chunking.page_of(F.col("ranges"), F.lit(4)).alias("p"))
    assert df.first().p == 2
    with pytest.raises(Exception, match="no page holds"):
        spark.createDataFrame([batches[0]]).select(chunking.page_of(F.col("ranges"), F.lit(999))).collect()


def test_compaction(spark):
    df = spark.createDataFrame([(1, k, "user", "x" * 40) for k in range(6)] + [(2, 0, "user", "y" * 4000), (3, 0, "user", None)], "conv_id long, turn long, role string, text string")
    found = sessions.compacted(df, most_tokens=25, most_turns=30).collect()
    assert sorted((r.conv_id, r.turn) for r in found) == [(1, 4), (1, 5), (2, 0), (3, 0)]
    assert sessions.compacted(df, most_turns=3).where("conv_id = 1").count() == 3


def test_masking(spark):
    text = "CF ROSMRI87A04H501K e 1234567FA, Conto FE765 U***12123 ROSMRI87A04H501K 01/02/2024"
    out, names = masking.masked_text(text)
    assert out.count("[ANONYMIZED_PRESIDIO_ITALIAN_FISCAL_CODE_1]") == 2 and "1234567FA" not in out and "12123" not in out and "01/02/2024" in out
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    back = masking.masked(df).select("text", masking.unmasked(F.col("masked.text"), F.col("masked.placeholders")).alias("back"), masking.leftovers(F.col("masked.text")).alias("n")).collect()
    assert back[0].back == text and back[0].n == 5 and back[1].back is None and back[2].back == ""
    assert "MILANO" not in masking.masked_text("VIA SEGRETA ITALIANA 10, 40003 MILANO")[0]
    assert masking.masked_text("conto totale")[0] == "conto totale"


def vote(document, voter, k, quantity=1, total=10, at=None):
    return (document, voter, at or datetime(2024, 1, 1 + k, 10), "stock", f"S{k}", None, "buy", D(quantity), D(10), "eur" if voter == 2 else "EUR", D(0), D(total), D(1), None, "Acme Inc" if voter == 1 else "ACME")


VOTES = (
    "document string, voter int, event_date timestamp, asset_type string, symbol string, isin string, action string, quantity decimal(20,6), unit_price decimal(20,6), currency string, fees decimal(20,6), total_amount decimal(20,6), "
    "fx_rate decimal(20,6), asset_name string, provider string"
)


def test_consensus(spark):
    votes = [vote("same", v, k) for v in (1, 2, 3) for k in range(2)] + [vote("field", v, 0, quantity="10.5" if v == 3 else 10) for v in (1, 2, 3)] + [vote("count", v, k) for v in (1, 2, 3) for k in range(2 if v == 2 else 1)]
    df = spark.createDataFrame(votes, VOTES)
    found = {r.document: (r.status, r.error) for r in consensus.verified(df).collect()}
    assert found == {"same": ("approved", None), "field": ("escalated_to_user", "Field value mismatch"), "count": ("escalated_to_user", "Mismatch in transaction counts")}
    assert [(r.document, r.voters, r.similarity) for r in consensus.count_mismatches(df.where("document = 'count'")).orderBy("candidate").collect()][0] == ("count", 3, 1.0)
    assert consensus.distinct_candidates(df.where("document = 'field'")).count() == 2
    rows = consensus.staged_rows(consensus.distinct_candidates(df.where("document = 'same'")), consensus.verified(df)).collect()
    assert {r.local_total_amount for r in rows} == {D(10)} and {r.verification_status for r in rows} == {"approved"}


def test_majority(spark):
    df = spark.createDataFrame([("d", "gross", v, x) for v, x in ((1, "60000"), (2, "60000"), (3, "65000"))] + [("d", "name", v, "n") for v in (1, 2, 3)], "document string, field string, voter int, value string")
    out = consensus.majority(df)
    assert {r.field: (r.value, r.agreed, r.unanimous) for r in out.collect()} == {"gross": ("60000", True, False), "name": ("n", True, True)}
    assert consensus.income_status(out).first().status == "majority_agreed"
    split = spark.createDataFrame([("d", "x", v, str(v)) for v in (1, 2, 3)], df.schema)
    assert consensus.income_status(consensus.majority(split)).first().status == "escalated_to_user"


def test_manifest(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_sha string")
    manifest = spark.createDataFrame([("a", "SUCCESS"), ("b", "FAILED")], "file_sha string, status string")
    assert sorted(r.file_sha for r in reads.fresh(files, manifest).collect()) == ["b", "c"]


def test_candidates_of_a_large_document(spark):
    n = 100_000
    votes = spark.range(n).selectExpr(
        "'d' AS document", "CAST(id % 3 + 1 AS INT) AS voter", "timestamp_seconds(1700000000 + (id div 3) * 7) AS event_date", "'stock' AS asset_type", "concat('S', id div 6) AS symbol", "CAST(null AS STRING) AS isin",
        "IF(id % 50 = 0, CAST(null AS STRING), 'buy') AS action", "CAST(1 AS DECIMAL(20,6)) AS quantity", "CAST(null AS DECIMAL(20,6)) AS unit_price", "'EUR' AS currency", "CAST(0 AS DECIMAL(20,6)) AS fees", "CAST(id div 3 AS DECIMAL(20,6)) AS total_amount",
        "CAST(1 AS DECIMAL(20,6)) AS fx_rate", "CAST(null AS STRING) AS asset_name", "'b' AS provider")
    found = consensus.distinct_candidates(votes)
    # Three readings of each row are one candidate; those without an action are each their own.
    alone = sum(1 for k in range(n) if k % 50 == 0)
    whole = len({k // 3 for k in range(n) if k % 50})
    assert found.count() == whole + alone and found.agg(F.max("candidate")).first()[0] == whole + alone - 1
