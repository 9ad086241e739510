"""The formats against the functions that read the same files, pushed-down filters, bad rows, streams."""

import json

import pytest

from tallyweave.sources import files, formats
from tests.test_sources import STATEMENT


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    for place, text in {"italy/broker/a.csv": STATEMENT, "italy/other/b.csv": STATEMENT.replace("5,75", "1.091,50").replace("aaa", "b"), "ireland/broker/c.csv": STATEMENT.replace(";EUR;", ";USD;"), "ireland/broker/d.txt": "no statement"}.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(text, encoding="utf-8")
    (tmp_path / "ireland/broker/e.csv").write_bytes(STATEMENT.replace("Nome", "Società").encode("latin-1"))
    return tmp_path


def test_statements_as_the_function_reads_them(spark, folder):
    want = files.broker_statement(files.binary(spark, str(folder), (".csv",)))
    found = spark.read.format("broker_statement").load(str(folder))
    assert set(want.columns) <= set(found.columns)
    assert sorted(map(repr, found.select(want.columns).collect())) == sorted(map(repr, want.collect())) and found.count() == 8
    assert found.where("error IS NOT NULL").count() == 0


def test_other_files_are_never_opened(spark, folder):
    (folder / "italy/broker/bad.csv").write_text("no header", encoding="utf-8")
    found = spark.read.format("broker_statement").load(str(folder))
    with pytest.raises(Exception, match="no header"):
        found.collect()
    assert found.where("path_country = 'ireland'").count() == 4
    assert found.where("path_country IN ('ireland', 'france') AND path_provider = 'broker' AND symbol = 'AAA'").count() == 4
    assert found.where("path_country = 'nowhere'").count() == 0


@pytest.mark.parametrize(("change", "message"), [(("Incasso dividendi", "Altro"), "unknown kind"), (("Data operazione", "Data"), "no header"), (("03-02-2024;03", "99-99;03"), "no such date"), (("5,75", "x"), "no such amount"), ((";EUR;\n04", "\n04"), "too few")])
def test_bad_rows_fail_or_are_told(spark, tmp_path, change, message):
    formats.register(spark)
    (tmp_path / "a.csv").write_text(STATEMENT.replace(*change), encoding="utf-8")
    with pytest.raises(Exception, match=message):
        spark.read.format("broker_statement").load(str(tmp_path)).collect()
    found = spark.read.format("broker_statement").option("mode", "PERMISSIVE").load(str(tmp_path))
    assert message in found.where("error IS NOT NULL").first().error and found.where("error IS NULL").count() == (0 if message == "no header" else 1)


def test_files_share_partitions_by_size(spark, folder):
    read = spark.read.format("broker_statement")
    assert read.load(str(folder)).rdd.getNumPartitions() == 1
    assert read.option("partitionBytes", 10).load(str(folder)).rdd.getNumPartitions() == 4


def test_ocr_text_and_sessions(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.txt").write_text("one\fTwo\f\f")
    (tmp_path / "b.txt").write_text("{1}----------\nx\n{2}----------\ny")
    (tmp_path / "empty.txt").write_text("")
    found = spark.read.format("ocr_text").load(f"file://{tmp_path}")
    assert sorted((r.path[-5:], r.page_number, r.text) for r in found.collect()) == [("a.txt", 1, "one"), ("a.txt", 2, "Two"), ("b.txt", 1, "x"), ("b.txt", 2, "y")]
    (tmp_path / "s.json").write_text(json.dumps({"id": "s", "title": "t", "messages": [{"role": "user", "content": "x", "usage": {"n": 1}}]}))
    (tmp_path / "bad.json").write_text("{")
    found = {r.path[-6:]: r for r in spark.read.format("chat_session").option("mode", "PERMISSIVE").load(str(tmp_path)).collect()}
    good = next(r for r in found.values() if r.error is None)
    assert (good.id, good.messages[0].role, good.messages[0].usage) == ("s", "user", '{"n": 1}') and sum(r.error is not None for r in found.values()) == 1


def test_a_stream_reads_a_file_once(spark, tmp_path):
    formats.register(spark)
    box = tmp_path / "box"
    box.mkdir()

    def run():
        rows = spark.readStream.format("broker_statement").load(str(box)).select("isin", "total_amount", "path")
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    (box / "a.csv").write_text(STATEMENT, encoding="utf-8")
    assert run() == 2
    (box / "b.csv").write_text(STATEMENT, encoding="utf-8")
    assert run() == 4
    assert run() == 4
