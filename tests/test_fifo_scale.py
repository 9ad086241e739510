"""Acceptance of sales over many rows, with adaptive execution on, against a plain walk."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyweave.operators import fifo


def test_many_rows(spark):
    rng = random.Random(7)
    keys = 4000
    told = [(rng.randrange(keys), k, rng.randrange(900), rng.choice([1, 1, -1, -1, -1]), rng.randrange(1, 40)) for k in range(60_000)]
    df = spark.createDataFrame(told, "asset long, id long, day int, side int, q int").repartition(16)
    events = df.select("asset", "id", F.timestamp_add("DAY", "day", F.lit("2020-01-01").cast("timestamp")).alias("at"), "side", F.col("q").cast("decimal(18,6)").alias("quantity"), F.lit(1).cast("decimal(20,6)").alias("unit_price"), F.lit(0).cast("decimal(20,6)").alias("fees"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    found = {r.id for r in fifo.accepted_sales(events, ["asset"], "at", ["id"]).select("id").collect()}
    held, want = defaultdict(int), set()
    for asset, k, day, side, q in sorted(told, key=lambda x: (x[2], x[1])):
        if side == 1:
            held[asset] += q
        elif q <= held[asset]:
            held[asset] -= q
            want.add(k)
    assert found == want
