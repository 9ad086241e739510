"""Events in several batches, with restarts in between, give what one batch gives."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import fifo
from tallyweave.streaming import lots

SCHEMA = "isin string, id string, event_timestamp timestamp, action string, quantity decimal(20,6), unit_price decimal(20,6), fees decimal(20,6)"


def some(n, seed=1):
    rng, day = random.Random(seed), datetime.datetime(2020, 1, 1)
    # One asset has a third of all events.
    return [(rng.choice(["A", "A", "B", "C", "D"]), f"{k:04}", day + datetime.timedelta(hours=k), rng.choice(["buy", "buy", "sell"]), rng.randint(1, 40), rng.randint(1, 99), rng.choice([None, 1])) for k in range(n)]


def exact(rows):
    return [(*r[:4], *(None if x is None else Decimal(x) for x in r[4:])) for r in rows]


def run(spark, folder, rows, cuts):
    own = lots.stateful(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    (folder / "in").mkdir(parents=True)
    told = own.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(exact(rows[a:b]), SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        lots.follow(told, f"{folder}/out", f"{folder}/state").awaitTermination()
    return sorted(((r.isin, r.status, r.l and r.l.id, r.r.id, r.matched, r.cost, r.gain) for r in spark.read.parquet(f"{folder}/out").collect()), key=repr)


@pytest.mark.parametrize("seed", [1])
def test_batches_equal_one_and_the_table(spark, tmp_path, seed):
    rows = some(240, seed)
    cut = run(spark, tmp_path / "cut", rows, [60, 61, 170])
    assert cut == run(spark, tmp_path / "one", rows, [])
    assert {r[1] for r in cut} == {"matched", "rejected"}
    df = spark.createDataFrame(exact(rows), SCHEMA)
    events = df.fillna({"fees": 0}).withColumn("side", F.when(F.col("action") == "buy", 1).otherwise(-1))
    taken = fifo.accepted(events, ["isin"], "event_timestamp", ["id"])[0].drop("bought", "sold")
    found = fifo.matched(taken.where("side = 1"), taken.where("side = -1"), ["isin"], "event_timestamp", ["id"])
    want = sorted(((r.isin, "matched", r.l.id, r.r.id, r.matched, r.cost, r.gain) for r in found.collect()), key=repr)
    assert [r for r in cut if r[1] == "matched"] == want
    assert {r[3] for r in cut if r[1] == "rejected"} == {r[1] for r in rows if r[3] == "sell"} - {r.id for r in taken.select("id").collect()}


def test_late_and_invalid_events_change_nothing(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    at = lambda k: day + datetime.timedelta(days=k)
    rows = [("A", "1", at(5), "buy", 10, 2, None), ("A", "0", at(4), "buy", 10, 2, None), ("A", "2", None, "buy", 5, 1, 0), ("A", "3", at(6), "buy", 0, 1, 0), ("A", "4", at(6), "hold", 5, 1, 0), (None, "5", at(6), "buy", 5, 1, 0), ("A", "6", at(7), "sell", 11, 3, 0), ("A", "7", at(8), "sell", 10, 3, 0)]
    found = run(spark, tmp_path, rows, [1])
    assert {(r[1], r[3]) for r in found if r[0]} == {("late", "0"), ("invalid", "2"), ("invalid", "3"), ("invalid", "4"), ("rejected", "6"), ("matched", "7")}


def test_many_assets_share_a_state(spark, tmp_path, monkeypatch):
    """Assets of one group keep their own lots and places over batches, and state is asked for once a group."""
    monkeypatch.setattr(lots, "GROUPS", 2)
    day = datetime.datetime(2020, 1, 1)
    rows = [(f"A{k:03}", f"{turn}-{k:03}", day + datetime.timedelta(days=turn), "sell" if turn == 3 else "buy", 5 + turn if turn < 3 else 12, 2, 0) for turn in range(1, 4) for k in range(60)]
    found = run(spark, tmp_path, rows, [60, 150])
    assert found == sorted(((f"A{k:03}", "matched", f"{t}-{k:03}", f"3-{k:03}", Decimal(q), Decimal(2 * q), Decimal(0)) for k in range(60) for t, q in ((1, 6), (2, 6))), key=repr)
    plan = lots.matches(lots.stateful(spark).readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "_group" in plan
