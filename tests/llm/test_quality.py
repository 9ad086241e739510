"""Operator 11 against a plain discriminant in numpy, on odd rows and on held-out labels."""

import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from tallyweave.llm import quality
from tests.llm.test_operators import CLASHING, ODD, texts

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"
BIG = "/root/testdata/sf0.1"


def plain(text):
    t = text or ""
    words = [w for w in re.split("[ \t\n\r\f]+", t) if w]
    pairs = list(zip(words, words[1:]))
    n = {"n_words": len(words), "n_inside": sum(map(len, words)), "n_upper": sum(c.isupper() for c in t), "n_odd": sum(not (c.isalnum() or c in " \t\n\r\f.,") for c in t)}
    n |= {"n_again": sum(a == b for a, b in pairs), "n_kinds": len(set(words)), "n_pairs": len(set(pairs)), "n_lines": t.count("\n") + 1}
    return [eval(e, {"ln": np.log, "sqrt": np.sqrt, **n}) for e in quality.STATISTICS.values()]


def brute(docs, labels, x):
    good = {}
    for d, q in labels:
        if d is not None and q is not None and zlib.crc32(str(d).encode()) % 5:
            good[d] = max(good.get(d, 0), q)
    y = np.array([good.get(d, -1) for d, _ in docs])
    own = {k: x[y == k] for k in (0, 1)}
    n = {k: len(v) for k, v in own.items()}
    spread = np.maximum(sum(n[k] * own[k].var(0) for k in own) / sum(n.values()), quality.LEAST)

    def log(k):
        cov = (n[k] * np.cov(own[k].T, bias=True) + quality.PRIOR_ROWS * np.diag(spread)) / (n[k] + quality.PRIOR_ROWS)
        far = x - own[k].mean(0)
        return np.log(n[k]) - np.linalg.slogdet(cov)[1] / 2 - (far * np.linalg.solve(cov, far.T).T).sum(1) / 2

    return 1 / (1 + np.exp(np.clip(log(0) - log(1), -700, 700)))


def test_against_numpy(spark):
    docs = list(enumerate(texts(4, 80))) + [(k, "word " * k) for k in range(100, 160)] + [(7, "a second text of this id"), (None, "no id")]
    labels = [(k, 1) for k in range(80)] + [(k, 0) for k in range(100, 160)] + [(100, 1), (3, None), (None, 1), (999, 0)]
    rows = quality.measured(spark.createDataFrame(docs, DOCS))
    told = rows.toPandas()
    x = np.array([plain(t) for _, t in docs])
    np.testing.assert_allclose(told[list(quality.NAMES)].to_numpy(), x, atol=1e-12)
    found = quality.scored(rows, quality.fitted(rows, spark.createDataFrame(labels, LABELS))).toPandas()
    np.testing.assert_allclose(found.score, brute(docs, labels, x), atol=1e-9)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, "i", "s", 1, None, "z", None, "q") for k, t in enumerate(ODD)] * 2, CLASHING)
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(ODD))], LABELS)
    rows = quality.measured(docs)
    found = quality.scored(rows, quality.fitted(rows, labels)).toPandas()
    assert len(found) == 2 * len(ODD) and found.score.between(0, 1).all()
    assert found[found.doc_id == 0].score.iloc[0] == found[found.doc_id == 1].score.iloc[0]  # empty and null
    kept = quality.good_only(docs.withColumnRenamed("score", "n_words"), labels)
    assert kept.columns == [c.replace("score", "n_words") for c in docs.columns] and kept.count() == (found.score >= quality.GOOD).sum()


def test_without_labels(spark):
    rows = quality.measured(spark.createDataFrame([(1, "a"), (2, None)], DOCS))
    none = quality.fitted(rows, spark.createDataFrame([], LABELS))
    assert [r.score for r in quality.scored(rows, none).collect()] == [0.5, 0.5]
    one = quality.fitted(rows, spark.createDataFrame([(1, 1), (2, 1)], LABELS))
    learned = sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in (1, 2))
    assert quality.scored(rows, one).first().score == (learned + 1) / (learned + 2)
    empty = quality.measured(spark.createDataFrame([], DOCS))
    assert quality.scored(empty, quality.fitted(empty, spark.createDataFrame([(1, 1)], LABELS))).count() == 0


@pytest.mark.skipif(not os.path.isdir(BIG), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    found = quality.op11_quality(spark, BIG).toPandas().merge(pd.read_parquet(f"{BIG}/labels.parquet"), on="doc_id")
    own = found[found.held_out]
    lost = ((own.predicted == 0) & (own.quality == 1)).sum() / (own.quality == 1).sum()
    kept = ((own.predicted == 1) & (own.quality == 0)).sum() / (own.quality == 0).sum()
    assert len(own) > 500 and lost < 0.01 and kept < 0.01
