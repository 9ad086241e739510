"""Scores by counts that leave the scored document out, against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import lm_scores, words
from tests.llm.test_operators import ODD, none, odd, table, texts  # noqa: F401


def micro(n):
    return int(np.rint(math.log(n) * 1e6))


def brute(rows, order):
    told = [words.of_text(t) for t in rows]
    counts = [Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1)) for d in told]
    whole, total = sum(counts, Counter()), sum(map(len, told))
    out = []
    for d, own in zip(told, counts, strict=True):
        value = 0
        for i in range(len(d)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - n + 1 : i + 1])
                others = whole[gram] - own[gram]
                if n == 1:
                    value += micro(others or 0.5) - micro(max(total - len(d), 1))
                elif others:
                    value += micro(others) - micro(whole[gram[:-1]] - own[gram[:-1]])
                    break
                else:
                    value += micro(0.4)
        out.append(value if d else None)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("size", [lm_scores.SLICE, 100])
def test_left_out(spark, order, size, monkeypatch):
    monkeypatch.setattr(lm_scores, "SLICE", size)
    rows = texts(12, 50) + ODD
    found = {r.doc_id: r.micro_log for r in lm_scores.left_out_scores(table(spark, rows), order).collect()}
    assert found == dict(enumerate(brute(rows, order)))


def test_gibberish_scores_low(spark):
    rows = ["the cat sat on the mat", "the cat sat on the mat today", "qx zv wk jj pq ww"]
    found = {r.doc_id: r.score for r in lm_scores.left_out_scores(table(spark, rows)).collect()}
    assert found[2] < -3 < -1 < found[0]


def test_odd(spark, odd, none):  # noqa: F811
    assert lm_scores.left_out_scores(odd).count() == odd.count() and lm_scores.left_out_scores(none).count() == 0


def test_many_parts(spark, monkeypatch):
    """N-grams of several slices in many parts of the hash space, some of them many times in one slice."""
    monkeypatch.setattr(lm_scores, "SLICE", 4000)
    monkeypatch.setattr(lm_scores, "PART", 50)
    rows = [*texts(12, 50), "a " * 300, "a b " * 200, "a " * 5000, *ODD]
    found = {r.doc_id: r.micro_log for r in lm_scores.left_out_scores(table(spark, rows)).collect()}
    assert found == dict(enumerate(brute(rows, 3)))


def test_what_travels(spark, monkeypatch):
    """N-grams travel as arrays by part, answers by slice; neither rows of n-grams nor texts do."""
    monkeypatch.setattr(lm_scores, "PART", 50)
    plan = lm_scores.left_out_scores(table(spark, texts(12, 50)))._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange (\w+\(\w+)", plan)
    assert sorted(exchanges) == ["hashpartitioning(slice", *["shufflepartitionidpassthrough(direct_shuffle_partition_id"] * 2]


def test_bytes_a_gram(spark):
    """What is dealt out takes less than seven bytes a distinct n-gram, once compressed as exchanges are."""
    rng = np.random.default_rng(5)
    rows = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 20_000)) for _ in range(10)]
    cuts = lm_scores.slices_of(table(spark, rows).coalesce(1).selectExpr("doc_id AS id", "text"))
    runs, total = lm_scores.dealt(cuts, 3, 2).collect(), 0
    for name, kind in (("top", np.int16), ("mid", np.int16), ("low", np.int32), ("few", np.int8), ("many", np.int32)):
        total += sum(len(pa.Codec("lz4").compress(np.array(r[name], kind).tobytes())) for r in runs)
    assert total < 7 * sum(len(r.low) for r in runs)
