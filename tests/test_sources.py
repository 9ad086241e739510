import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import sessions
from tallyweave.sources import files, sinks
from tallyweave.streaming.ingest import ingest

HEADER = "Data operazione;Data valuta;Tipo operazione;Ticker;Isin;Protocollo;Descrizione;Quantità;Importo euro;Importo Divisa;Divisa;Riferimento ordine"
STATEMENT = "\n".join(["Conto di prova", "", "righe", "x;y", HEADER, "03-02-2024;03-02-2024;Incasso dividendi;aaa;it0000000001;1;Nome;0;5,75;0;EUR;", "04/02/2024;04-02-2024;Ritenuta dividendi;aaa;it0000000001;2;Nome;0;-1,5;0;EUR;", ""])


def test_statement(spark, tmp_path):
    (tmp_path / "italy" / "broker").mkdir(parents=True)
    (tmp_path / "italy" / "broker" / "a.csv").write_text(STATEMENT, encoding="utf-8")
    (tmp_path / "b.csv").write_bytes(STATEMENT.replace("Nome", "Società").encode("latin-1"))
    found = files.broker_statement(files.binary(spark, str(tmp_path), (".csv",)))
    rows = found.orderBy("source_file_name", "event_timestamp").collect()
    assert [(r.action, r.total_amount, r.quantity, r.unit_price, r.symbol) for r in rows[:2]] == [("dividend", D("5.75"), None, None, "AAA"), ("tax_payment", D("1.5"), None, None, "AAA")]
    assert rows[2].asset_name == "Società" and rows[0].local_total_amount == D("5.75") and rows[0].tax_year == 2024
    parts = files.binary(spark, str(tmp_path), (".csv",)).select("file_name", files.path_parts(F.col("path"), str(tmp_path)).alias("p")).orderBy("file_name").collect()
    assert (parts[0].p.country, parts[0].p.provider) == ("italy", "broker") and parts[1].p is None


@pytest.mark.parametrize(("change", "message"), [(("Incasso dividendi", "Altro"), "unknown kind"), (("Data operazione", "Data"), "no header"), (("03-02-2024;03", "99-99;03"), "no such date"), (("5,75", "x"), "no such amount"), ((";EUR;\n04", "\n04"), "too few")])
def test_bad_statement(spark, tmp_path, change, message):
    (tmp_path / "a.csv").write_text(STATEMENT.replace(*change), encoding="utf-8")
    df = files.binary(spark, str(tmp_path), (".csv",))
    with pytest.raises(Exception, match=message):
        files.broker_statement(df).collect()
    assert message in [r.error for r in files.broker_statement(df, strict=False).collect() if r.error][0]


def test_markdown_and_export(spark, tmp_path):
    (tmp_path / "a.md").write_text("<p>Hello</p>\n\nworld ")
    (tmp_path / "b.md").write_text("<br>")
    rows = files.markdown(spark, str(tmp_path)).collect()
    assert [(r.page_number, r.text) for r in rows] == [(0, "Hello\n\nworld")]
    pages = spark.createDataFrame([("ireland", "Doc 1", 3, "text")], "jurisdiction string, document string, page_number int, text string")
    sinks.export_pages(pages, str(tmp_path / "out"))
    assert list((tmp_path / "out" / "jurisdiction=ireland" / "document=Doc_1" / "page=3").glob("*.txt"))[0].read_text() == "# Doc 1, page 3\n\ntext\n"


def test_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"")
    found = files.parsed_pages(files.binary(spark, str(tmp_path), (".pdf",)), lambda b: b.decode().split("|") if b else [])
    assert [(r.page_number, r.text) for r in found.collect()] == [(1, "one"), (2, "two")]


def test_sessions(spark, tmp_path):
    for k, at in (("a", "2024-01-01"), ("b", "2024-02-01")):
        (tmp_path / f"{k}.json").write_text(json.dumps({"id": k, "title": k, "created_at": at, "updated_at": at, "messages": [{"role": "user", "content": "x"}]}, indent=1))
    (tmp_path / "c.json").write_text("{broken")
    assert [(r.id, r.messages) for r in sessions.listed(files.sessions(spark, str(tmp_path)).cache()).collect()] == [("b", 1), ("a", 1)]


def test_config():
    out = sinks.config({"a": 1, "b": "x", "c": False, "d": 2.5}, user={"a": 2, "b": "u"}, environment={"TALLYWEAVE_A": "3", "TALLYWEAVE_C": "yes"}, given={"b": "g"})
    assert out == {"a": 3, "b": "g", "c": True, "d": 2.5}


def test_cache(spark):
    wanted, cache = spark.createDataFrame([("a",), ("b",)], "sha string"), spark.createDataFrame([("a", 1)], "sha string, x int")
    hit, miss = files.cached(wanted, cache, ["sha"])
    assert hit.first().x == 1 and miss.first().sha == "b"


def test_stream_takes_a_file_once(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    run = lambda: ingest(spark, str(box), str(tmp_path / "ledger"), str(tmp_path / "manifest"), str(tmp_path / "state"), files.broker_statement).awaitTermination()
    (box / "a.csv").write_text(STATEMENT, encoding="utf-8")
    run()
    (box / "again.csv").write_text(STATEMENT, encoding="utf-8")
    (box / "b.csv").write_text(STATEMENT + "\n", encoding="utf-8")
    run()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 2


def test_failed_files_are_noted(spark, tmp_path):
    from tallyweave.operators import ingestion

    (tmp_path / "good.csv").write_text(STATEMENT, encoding="utf-8")
    (tmp_path / "bad.csv").write_text(STATEMENT.replace("5,75", "x"), encoding="utf-8")
    (tmp_path / "done.csv").write_text(STATEMENT.replace("5,75", "6,75"), encoding="utf-8")
    found = files.binary(spark, str(tmp_path), (".csv",))
    manifest = found.where("file_name = 'done.csv'").select("file_sha", F.lit("SUCCESS").alias("status"))
    rows, noted = ingestion.statements(found, manifest, files.broker_statement)
    assert {r.file_name: (r.status, r.transaction_count, r.error_message) for r in noted.collect()} == {"good.csv": ("SUCCESS", 2, None), "bad.csv": ("FAILED", 0, "no such amount")}
    assert {r.source_file_name for r in rows.collect()} == {"good.csv"} and rows.count() == 2


def test_documents_are_skipped_or_replaced(spark):
    from tallyweave.operators import ingestion
    from tallyweave.schemas import CHUNKS

    docs = spark.createDataFrame([("s1", "A", "ireland", "One. Two."), ("s2", "B", None, "Three.")], "document_sha string, document_name string, jurisdiction string, text string")
    chunks = ingestion.documents(spark.createDataFrame([], CHUNKS), docs)
    assert chunks.count() == 2 and chunks.columns == CHUNKS.fieldNames()
    changed = docs.where("document_sha = 's1'").withColumn("text", F.lit("Other."))
    assert {r.text_content for r in ingestion.documents(chunks, changed).collect()} == {"One. Two.", "Three."}
    assert {r.text_content for r in ingestion.documents(chunks, changed, replace=True).collect()} == {"Other.", "Three."}
