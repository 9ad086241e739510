"""Large benchmarks, block by block, and words that only seem to be a phrase's."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tallyweave.llm import decontamination, words
from tests.llm.test_operators import ODD, table, texts


def hashes(told):
    data = np.frombuffer(" ".join(told).encode(), np.uint8)
    folded, begins, ends, _ = words.spans(data, np.array([0, len(data)]))
    return words.hashes(folded, begins, ends)


def test_items_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 7)
    source = texts(21, 12, 60)
    items = [(f"i{k}", t) for k, t in enumerate(source[:4])] + [("short", "the of"), ("i0", source[0])]
    rows = source + [s.upper() for s in source] + ODD
    want = decontamination.brute(list(enumerate(rows)), items)
    found = decontamination.removal_spans(table(spark, rows), spark.createDataFrame(items, "item_id string, text string"))
    told = found.select("doc_id", "n_words", decontamination.words_in("spans", "text"), F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.size("spans") > 0)
    assert sorted(map(tuple, told.collect())) == want


def test_words_of_one_hash_are_compared():
    told = "a b c d e f g h i j".split()
    text = pa.array(["x " + " ".join(told) + " y", None, ""])
    right = decontamination.Phrases([("item", hashes(told), b"\0".join(w.encode() for w in told))], 10)
    wrong = decontamination.Phrases([("item", hashes(told), b"\0".join([b"other", *(w.encode() for w in told[1:])]))], 10)
    assert decontamination.Hits(text, right).items == [["item"], [], []] and decontamination.Hits(text, wrong).items == [[], [], []]
    assert decontamination.Hits(text, right).spans == [[[2, 21]], [], []]


def test_very_many_spans_are_cut(spark):
    told = " ".join(f"w{k}" for k in range(10))
    text = " ".join(f"{told} keep{k}" for k in range(20_000))
    docs, benchmark = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("a", told)], "item_id string, text string")
    assert decontamination.decontaminated(docs, benchmark).first().text.split() == [f"keep{k}" for k in range(20_000)]


def test_texts_of_one_id_are_one_item(spark, monkeypatch):
    told = [" ".join(f"{c}{k}" for k in range(12)) for c in "ab"]
    docs = spark.createDataFrame([(1, " | ".join(told)), (2, told[1]), (3, "neither")], "doc_id long, text string")
    benchmark = spark.createDataFrame([("x", told[0]), ("x", told[1]), ("y", told[1])], "item_id string, text string")
    for most in (decontamination.BLOCK_WORDS, 15):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", most)
        found = {r.doc_id: r["items"] for r in decontamination.removal_spans(docs, benchmark).collect()}
        assert found == {1: ["x", "y"], 2: ["x", "y"], 3: []}


def test_a_full_block_is_small():
    import pickle

    n = decontamination.BLOCK_WORDS
    rng = np.random.default_rng(1)
    items = [(f"item {k}", rng.integers(0, 1 << 63, 1000).astype(np.uint64), b"\0".join([b"sixsix"] * 1000)) for k in range(n // 1000)]
    phrases = decontamination.Phrases(items, decontamination.WINDOW)
    assert len(phrases.starts) == n - 9 * (n // 1000) and len(pickle.dumps(phrases)) < 45 * n
