"""Requests and answers of a table and of a stream that comes in parts."""

import datetime

from pyspark.sql import functions as F

from tallyweave.operators.interactions import paired
from tallyweave.operators.reads import tree

LOG = "request_id string, kind string, at timestamp, text string"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


ROWS = [
    ("a", "request", at(0), "what?"), ("a", "response_completed", at(2), "that"), ("b", "request", at(3), "and?"), ("c", "request", at(4), "slow"), ("c", "response_failed", at(70), "too late"),
    ("d", "response_completed", at(5), "nobody asked"), ("e", "request", at(6), "twice"), ("e", "response_completed", at(7), "1"), ("e", "response_failed", at(8), "2"), (None, "request", at(9), "x"), ("f", "request", None, "x"),
    ("g", "request", at(60), "end of the window"), ("g", "response_cancelled", at(120), ""),
]
WANT = [("a", "COMPLETED", 120.0), ("b", "UNANSWERED", None), ("c", "UNANSWERED", None), ("e", "COMPLETED", 60.0), ("e", "FAILED", 120.0), ("g", "CANCELLED", 3600.0)]


def told(df):
    return sorted(((r.request_id, r.status, r.seconds) for r in df.where("request_id <> 'clock'").collect()), key=repr)


def test_table_and_stream(spark, tmp_path):
    assert told(paired(spark.createDataFrame(ROWS, LOG))) == sorted(WANT, key=repr)
    (tmp_path / "in").mkdir()

    def run():
        log = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        paired(log).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    clock = [("clock", kind, at(1000), "") for kind in ("request", "response_completed")]
    parts = (ROWS[:5], ROWS[5:], clock, [(f"clock", kind, at(2000), "") for kind in ("request", "response_completed")])
    for n, part in enumerate(parts):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        if n == 1:  # nothing is called unanswered before its time is over
            assert ("b", "UNANSWERED", None) not in told(spark.read.parquet(str(tmp_path / "out")))
    assert told(spark.read.parquet(str(tmp_path / "out"))) == sorted(WANT, key=repr)


def test_tree(spark):
    paths = ["b/x.txt", "a/Z.txt", "a/b/c.md", "a/.hidden/c.md", "top.md", "top.md", "a/b/.dot", "", None, "A/y", "/a//y.txt"]
    found = tree(spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("place", "path").collect()
    assert [(r.path, r.kind, r.files) for r in found] == [("A", "dir", 1), ("a", "dir", 3), ("a/b", "dir", 1), ("a/b/c.md", "file", None), ("A/y", "file", None), ("a/y.txt", "file", None), ("a/Z.txt", "file", None), ("b", "dir", 1), ("b/x.txt", "file", None), ("top.md", "file", None)]
    hits = tree(spark.createDataFrame([(p,) for p in paths], "path string"), " B ").orderBy("place").select("path", "kind")
    assert [tuple(r) for r in hits.collect()] == [("a", "dir"), ("a/b", "dir"), ("b", "dir")]
    hits = tree(spark.createDataFrame([(p,) for p in paths], "path string"), "md")
    assert sorted(r.path for r in hits.collect()) == ["a", "a/b", "a/b/c.md", "top.md"] and hits.where(F.col("depth") > 3).count() == 0
