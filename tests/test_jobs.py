"""Pages, sessions, settings, mergers, ISINs and nested placeholders."""

import os
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import ingestion, masking, mergers, store
from tallyweave.sources import files, sinks

CHUNKS = (
    "id long, document_name string, document_sha string, jurisdiction string, source_type string, confidence_level string, page_number int, text_content string, chunk_index int, parent_chunk_id long, "
    "parent_text_content string, created_at timestamp, embedding array<float>"
)


def test_chunks_know_their_pages(spark):
    pages = spark.createDataFrame([("s", "Act", "ie", n, f"Page {n} begins. " + f"Word{n} goes on. " * 150) for n in range(1, 8)], "document_sha string, document_name string, jurisdiction string, page_number int, text string")
    found = ingestion.documents(spark.createDataFrame([], CHUNKS), pages).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in found] == list(range(len(found))) and {r.page_number for r in found} == set(range(1, 8))
    assert [r.page_number for r in found] == sorted(r.page_number for r in found)
    for r in found:
        assert f"Word{r.page_number} " in r.text_content or f"Page {r.page_number} " in r.text_content
    again = ingestion.documents(spark.createDataFrame(found, CHUNKS), pages)
    assert again.count() == len(found) and ingestion.documents(spark.createDataFrame(found, CHUNKS), pages, replace=True).count() == len(found)


def test_page_files(spark, tmp_path):
    pages = spark.createDataFrame([("ie", "My Act", 3, "text"), (None, "b", 1, None)], "jurisdiction string, document string, page_number int, text string")
    assert sinks.export_page_files(pages, str(tmp_path)) == 2 == sinks.export_page_files(pages, str(tmp_path))
    assert (tmp_path / "ie" / "My_Act" / "page_3.md").read_text() == "# My Act, page 3\n\ntext" and (tmp_path / "none" / "b" / "page_1.md").read_text() == "# b, page 1\n\n"


def test_sessions_are_replaced(spark, tmp_path):
    kind = "id string, title string, created_at string, updated_at string"
    sinks.save_sessions(spark.createDataFrame([("a", "one", "1", "1"), ("b", "two", "1", "1")], kind).withColumn("_corrupt_record", F.lit(None).cast("string")), str(tmp_path))
    sinks.save_sessions(spark.createDataFrame([("a", "three", "1", "2")], kind).withColumn("_corrupt_record", F.lit(None).cast("string")), str(tmp_path))
    held = spark.read.schema(kind).json(str(tmp_path)).select("id", "title")
    assert sorted(map(tuple, held.collect())) == [("a", "three"), ("b", "two")] and sinks.delete_sessions(held, ["a"]).count() == 1


def test_settings(tmp_path):
    path, defaults = str(tmp_path / "s.json"), {"limit": 3, "name": "x"}
    assert sinks.saved_settings(path) == {} and sinks.save_settings(path, defaults, limit=5) == {"limit": 5}
    assert sinks.config(defaults, sinks.saved_settings(path), {})["limit"] == 5 and sinks.save_settings(path, defaults, limit=None, name="y") == {"name": "y"}
    with pytest.raises(KeyError):
        sinks.save_settings(path, defaults, other=1)
    sinks.reset_settings(path)
    assert not os.path.exists(path)


def test_log_text(spark):
    df = spark.createDataFrame([("t", "r", "chat", "m", "ask", None, 1.0)], "timestamp string, request_id string, kind string, model string, prompt string, response string, duration_ms double")
    assert sinks.log_text(df).first()[0] == "[t] chat m r\n> ask\n< \n"


def test_mergers_are_added(spark):
    held = spark.createDataFrame([(4, "A", "B", "S", datetime(2020, 1, 1), D(2))], "id long, old_isin string, new_isin string, new_symbol string, effective_date timestamp, exchange_ratio decimal(18,6)")
    row = mergers.added(held, " ie1 ", "ie2", "2021-01-01 00:00:00", "sym").where("id = 5").first()
    assert (row.old_isin, row.new_isin, row.new_symbol, row.exchange_ratio) == ("IE1", "IE2", "SYM", D(1))
    with pytest.raises(ValueError):
        mergers.added(held, "a", "A", "2021-01-01")


def test_rejection_is_a_status(spark):
    staged = spark.createDataFrame([(1, None, "pending_approval"), (2, None, "pending_approval"), (3, 9, "approved")], "id long, approved_financial_record_id long, verification_status string")
    assert [tuple(r)[::2] for r in store.rejected(staged, spark.createDataFrame([(1,), (3,), (3,)], "id long")).orderBy("id").collect()] == [(1, "rejected"), (2, "pending_approval"), (3, "approved")]


def test_ids_do_not_clash(spark):
    old, new = spark.range(5).toDF("id"), spark.range(400).withColumn("k", F.col("id") % 7).repartition(5, "k").groupBy("k").agg(F.count("*").alias("n"))
    found = [r.id for r in store.appended(old, new).collect()]
    assert sorted(found) == list(range(12))


def test_isins_to_ask(spark):
    rows = spark.createDataFrame([("IE0000000001",), ("ie0000000001 ",), ("short",), ("IE0000000002",), ("IE0000000003",), (None,)], "isin string")
    mapping = spark.createDataFrame([("ie0000000002", "T", "N"), ("IE0000000003", None, None)], "isin string, ticker string, name string")
    assert [r.isin for r in files.isins_to_ask(rows, mapping).collect()] == ["IE0000000001"]


def test_placeholders_in_nested_values(spark):
    names = {"[ANONYMIZED_PRESIDIO_LOCATION_1]": "Via Roma 1", "[ANONYMIZED_PRESIDIO_LOCATION_10]": "Via Po 2"}
    value = ([("at [ANONYMIZED_PRESIDIO_LOCATION_10]", 3)], {"k": "[ANONYMIZED_PRESIDIO_LOCATION_1]"}, None)
    df = spark.createDataFrame([(value, names)], "v struct<a:array<struct<t:string,n:int>>,m:map<string,string>,s:struct<x:string>>, names map<string,string>")
    got = df.select(masking.unmasked_within(F.col("v"), df.schema["v"].dataType, F.col("names")).alias("v")).first().v
    assert got.a[0].t == "at Via Po 2" and got.a[0].n == 3 and got.m == {"k": "Via Roma 1"} and got.s is None
