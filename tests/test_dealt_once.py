"""Lots, sales and positions of keys that fit a task are dealt out once; those of crowded keys over months and blocks, with the same rows."""

import random

import pytest

from tallyweave.operators import fifo, tax
from tallyweave.plans import ledger_queries

from .test_lot_matches import LOTS, SOLD, made

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    """Hash exchanges in the plan before it runs."""
    return df._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("fifo_matches", 1), ("lot_matches", 1), ("disposal_gains", 2), ("position_costs", None)])
def test_exchanges_and_both_ways(spark, monkeypatch, name, most):
    query = ledger_queries.QUERIES[name]
    once = query(spark, SF)
    assert most is None or exchanges(once) <= most
    want = sorted(map(str, once.collect()))
    monkeypatch.setattr(fifo, "FEW", 10)
    assert sorted(map(str, query(spark, SF).collect())) == want and want


def test_losses_that_are_bought_back_in_part(spark, monkeypatch):
    """Gains are those of matches split by quarantined(), in either way."""
    lots, sold = made(random.Random(11), 600, 12, 300)
    b, d = spark.createDataFrame(lots, LOTS), spark.createDataFrame(sold, SOLD)
    classes = spark.createDataFrame([(f"I{k}", "exit_tax" if k % 4 == 0 else "cgt_standard", "LU") for k in range(12)], "isin string, tax_regime string, domicile_country string")
    profiles = spark.createDataFrame([(2020, "resident_domiciled", None)], "tax_year int, residency_type string, marginal_tax_rate decimal(5,4)")
    split = tax.quarantined(tax.stored(tax.lot_matches(d, b)), tax.repurchases(d, b)).join(classes, "isin")
    held = {}
    for r in split.collect():
        if r.restricted and r.tax_regime == "cgt_standard":
            held[r.disposal_id] = held.get(r.disposal_id, 0) - r.gain
    assert len(held) > 50
    for few in (fifo.FEW, 60):
        monkeypatch.setattr(fifo, "FEW", few)
        found = tax.disposal_gains(d, b, classes, profiles).collect()
        assert len(found) == len(sold) and {r.disposal_id: r.quarantined_loss for r in found if r.quarantined_loss} == {k: v for k, v in held.items() if v}
