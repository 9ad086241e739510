"""Queries that moved or kept more than their tables need."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import fifo, portfolio, store
from tallyweave.plans import ledger_queries
from tests.test_dealt_once import SF, exchanges


def test_promotion_deals_rows_out_once(spark):
    # Once by day, and the sums of years.
    assert exchanges(ledger_queries.QUERIES["promotion"](spark, SF)) <= 2


def test_promotion_of_one_table(spark):
    """As promoted() has it, with rows that repeat, that lack something, and an approved one that is staged no more."""
    names = "id long, event_timestamp timestamp, isin string, symbol string, asset_type string, action string, quantity decimal(18,6), unit_price decimal(18,2), currency string, total_amount decimal(24,6), account_country string, provider string, approved_financial_record_id long, held boolean"
    told = [
        (n, datetime(2020, 1, 1 + n % 3), f"I{n % 4}" if n % 7 else None, f"S{n % 2}" if n % 5 else " ", "etf", "buy" if n % 2 else "sell", Decimal(n % 3), Decimal(1), "EUR", Decimal(9) if n % 11 else None, "c", "p", None if n % 13 else 5, n % 6 == 0 if n % 17 else None)
        for n in range(1, 200)
    ]
    rows = spark.createDataFrame(told, names).withColumn("verification_status", F.lit("new"))
    staged, columns = rows.drop("held"), [c for c in rows.columns if c not in ("held", "approved_financial_record_id")]
    out, linked, refused = store.promoted(staged, rows.where("held").select(columns))
    want = sorted(map(str, out.collect()))
    assert sorted(map(str, store.promoted_together(rows, F.col("held")).select(columns).collect())) == want
    moved = {r.id: r._staged for r in linked.where("verification_status = 'approved'").selectExpr("id AS _staged", "approved_financial_record_id AS id").collect()}
    assert len(want) == len([x for x in told if x[-1]]) + len(moved) and len(moved) > 10
    ids = {r.id for r in refused.collect()} | set(moved.values())
    assert ids == {x[0] for x in told if x[-2] is None} and not {r.id for r in refused.collect()} & set(moved.values())


@pytest.mark.parametrize("name", ["position_costs", "portfolio_positions"])
def test_positions_deal_rows_out_once(spark, name):
    df = ledger_queries.QUERIES[name](spark, SF)
    # Rows by key, and mergers by their ISIN.
    assert exchanges(df) <= 2 and df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 6


def test_positions_that_go_short_and_share_moments(spark, monkeypatch):
    """The sales that take place are those of a walk through the rows; ids decide where several share a moment."""
    rng = random.Random(4)
    told = [(f"{rng.randrange(10**6)}-{k}", datetime(2020, 1, 1 + rng.randrange(9)), f"I{rng.randrange(12)}", rng.choice(["buy", "sell", "sell", "dividend"]), Decimal(rng.choice([0, 1, 2, 5])), Decimal(rng.randrange(1, 9)), Decimal(1), Decimal(3)) for k in range(400)]
    told += [(f"z{k}", datetime(2020, 2, 1 + k), "J", "buy" if k < 4 else "sell", Decimal(2), Decimal(1), Decimal(0), Decimal(3)) for k in range(9)]
    rows = spark.createDataFrame(told, "id string, event_timestamp timestamp, isin string, action string, quantity decimal(18,6), unit_price decimal(18,2), fees decimal(18,2), local_total_amount decimal(24,6)")
    rows = rows.selectExpr("*", "'S' AS symbol", "concat('n', id) AS asset_name", "'etf' AS asset_type", "'p' AS provider", "'c' AS account_country", "'EUR' AS currency")
    held, first = {}, {}
    for id_, at, isin, action, quantity, *_ in sorted(told, key=lambda x: (x[1], x[0])):
        first.setdefault(isin, f"n{id_}")
        held.setdefault(isin, 0)
        if action == "buy" or action == "sell" and quantity <= held[isin]:
            held[isin] += quantity if action == "buy" else -quantity
    kept = portfolio._ids_where_shared(rows.select(portfolio.position_key().alias("key"), "id", "event_timestamp"))
    assert {r.n > 1 for r in kept.groupBy("key", "event_timestamp").agg(F.count("*").alias("n"), F.count("id").alias("ids")).where("ids = n").collect()} == {True}
    assert kept.where("id IS NULL").count() > 5
    found = {r.isin: r for r in portfolio.positions(rows).collect()}
    assert {k: r.current_quantity for k, r in found.items()} == held and {k: r.asset_name for k, r in found.items()} == first
    monkeypatch.setattr(portfolio, "SHARED", -1)
    assert {r.isin: r for r in portfolio.positions(rows).collect()} == found
    monkeypatch.setattr(fifo, "FEW", 10)
    assert {r.isin: r for r in portfolio.positions(rows).collect()} == found
