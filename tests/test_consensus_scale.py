"""Consensus where the votes of a document lie: tasks follow the number of votes, and pairs are not sorted."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import consensus
from tallyweave.plans import document_queries

SF = "/root/testdata/sf0.001"
VOTES = "document string, voter int, event_date timestamp, asset_type string, symbol string, isin string, action string, quantity decimal(20,6), unit_price decimal(20,6), currency string, fees decimal(20,6), total_amount decimal(20,6), fx_rate decimal(20,6), asset_name string, provider string"


@pytest.mark.parametrize("name", ["consensus_status", "consensus_candidates", "voter_differences"])
def test_tasks_follow_votes(spark, monkeypatch, name):
    want = sorted(map(str, document_queries.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(consensus, "EACH", 100)
    found = document_queries.QUERIES[name](spark, SF)
    # 1000 events, three readings each but for two that one misses.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(document") == plan.count(", 30), REPARTITION_BY_NUM") > 0
    assert sorted(map(str, found.collect())) == want and want


def test_matches_and_differences_against_a_plain_version(spark):
    rng, rows = random.Random(5), []
    for d in range(6):
        for v in (1, 2, 3, None):
            for _ in range(rng.randint(0, 5)):
                at = datetime(2024, 1, 1) + timedelta(hours=rng.choice([0, 1, 30, 200]))
                amount = rng.choice([None, Decimal(100), Decimal(103), Decimal(-5)])
                rows.append((f"d{d}", v, at, rng.choice(["stock", "etf", None]), rng.choice(["A", "AB", "", None]), rng.choice(["I", None]), rng.choice(["buy", "sell"]), rng.choice([None, Decimal(1)]), None, "EUR", None, amount, None, None, "p"))
    votes = consensus.dealt(spark.createDataFrame(rows, VOTES))
    candidates = consensus.distinct_candidates(votes)
    scored = candidates.join(consensus.numbered(votes).withColumnRenamed("r", "v"), "document").withColumn("score", consensus.similarity(F.col("v"), F.col("r"))).collect()
    best = defaultdict(list)
    for r in scored:
        best[r.document, r.candidate, r.voter].append((-r.score, r.position, r))
    want = {k: min(x, key=lambda y: y[:2])[2] for k, x in best.items()}
    want = {k: (r.score, r.position, r.v, r.r) for k, r in want.items() if r.score >= consensus.MATCH}
    found = consensus.best_matches(candidates, votes)
    assert found.columns == ["document", "candidate", "r", "voter", "position", "v", "score"]
    assert {(r.document, r.candidate, r.voter): (r.score, r.position, r.v, r.r) for r in found.collect()} == want and want
    sides = defaultdict(dict)
    for r in consensus.numbered(votes).collect():
        sides[r.document, r.position][r.voter] = r.r
    text = consensus.numbered(votes).select("document", "voter", "position", *(F.col(f"r.{c}").cast("string").alias(c) for c in consensus.FIELDS)).collect()
    told = {(r.document, r.position, r.voter): r for r in text}
    found = consensus.differences(votes).collect()
    assert len(found) == len(sides) * len(consensus.FIELDS)
    for r in found:
        assert (r.voter1, r.voter2, r.voter3) == tuple(told[r.document, r.position, v][r.field] if v in sides[r.document, r.position] else None for v in (1, 2, 3))
