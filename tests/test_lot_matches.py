"""Disposals against the purchase history: a plain version, one hot ISIN, and sums that stay with their disposals."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyweave.operators import tax

LOTS = "lot_id long, isin string, bought_at timestamp, quantity decimal(18,6), price decimal(20,6), fees decimal(20,6)"
SOLD = "disposal_id long, isin string, sold_at timestamp, quantity decimal(18,6), price decimal(20,6), fees decimal(20,6)"
START = datetime(2020, 1, 1)


def made(rng, n, isins, days):
    lots = [(k, f"I{rng.randrange(isins)}", START + timedelta(days=rng.randrange(days), hours=rng.choice([0, 0, 9])), D(rng.randint(1, 9000)) / rng.choice([1, 8]), D(rng.randint(1, 99)), D(rng.randint(0, 9))) for k in range(n)]
    sold = [(k, f"I{rng.randrange(isins)}", START + timedelta(days=rng.randrange(days), hours=rng.choice([0, 9])), D(rng.randint(1, 20_000)) / rng.choice([1, 8]), D(rng.randint(1, 99)), D(rng.randint(0, 9))) for k in range(n)]
    return lots, sold


def plain(lots, sold):
    out = set()
    for d, isin, sold_at, q, *_ in sold:
        mine = [x for x in lots if x[1] == isin and x[2] <= sold_at]
        recent = [x for x in mine if (sold_at.date() - x[2].date()).days <= 28]
        order = sorted(recent, key=lambda x: (x[2], x[0])) + sorted((x for x in mine if x not in recent), key=lambda x: (x[2], x[0]))
        for position, x in enumerate(order, 1):
            if q > 0:
                out.add((d, x[0], position, min(q, x[3])))
                q -= min(q, x[3])
    return out


def test_against_a_plain_version(spark):
    lots, sold = made(random.Random(5), 250, 4, 120)
    found = tax.lot_matches(spark.createDataFrame(sold, SOLD), spark.createDataFrame(lots, LOTS)).select("disposal_id", "lot_id", "position", "matched").collect()
    assert {tuple(r) for r in found} == plain(lots, sold) and len(found) == len(plain(lots, sold))


def test_nothing_to_match(spark):
    lots, sold = spark.createDataFrame([], LOTS), spark.createDataFrame([(1, "I", START, D(1), D(1), D(0))], SOLD)
    assert tax.lot_matches(sold, lots).count() == 0 and tax.lot_matches(sold.limit(0), lots).count() == 0


def test_one_hot_isin(spark):
    n = 30_000
    at = (F.lit(START).cast("timestamp") + F.expr("make_interval(0, 0, 0, CAST(id % 2000 AS INT))")).alias
    money = [F.lit(v).cast(k).alias(c) for c, k, v in (("quantity", "decimal(18,6)", 10), ("price", "decimal(20,6)", 3), ("fees", "decimal(20,6)", 0))]
    lots = spark.range(n).select(F.col("id").alias("lot_id"), F.lit("HOT").alias("isin"), at("bought_at"), *money)
    sold = spark.range(n).select(F.col("id").alias("disposal_id"), F.lit("HOT").alias("isin"), at("sold_at"), *money)
    row = tax.lot_matches(sold, lots).agg(F.count("*").alias("n"), F.sum("matched").alias("q")).first()
    assert (row.n, row.q) == (n, D(10 * n))


def test_sums_stay_with_their_disposals(spark):
    lots, sold = made(random.Random(8), 3000, 40, 400)
    d = spark.createDataFrame(sold, SOLD)
    matches = tax.stored(tax.lot_matches(d, spark.createDataFrame(lots, LOTS)))
    split = tax.quarantined(matches, tax.repurchases(d, spark.createDataFrame(lots, LOTS)))
    both = split.groupBy("disposal_id").agg(F.sum("matched").alias("x")).join(matches.groupBy("disposal_id").agg(F.sum("matched").alias("y")), "disposal_id")
    assert both.where("x <> y").count() == 0 and both.count() == matches.select("disposal_id").distinct().count()
