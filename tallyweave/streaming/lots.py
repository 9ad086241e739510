"""First-in-first-out lots over a stream of events, with the open lots of each asset as state.

A sale takes from the oldest open lots; one that they do not cover is rejected
whole and changes nothing. What is told of a batch does not depend on how the
events are cut into batches: several batches give what one gives, and what
operators.fifo gives for the same table.

Assets are dealt by a hash into GROUPS groups, so that state is asked for once a
group and batch and not once an asset. The state of a group is the list of its
assets' open lots, written once a batch, and the place of each asset's last
event. Events of a batch are taken in order of time and id; one that comes after
a later event of its asset has been taken is told as late and changes nothing. A
batch's events of one group are held by one task, so their number is bounded by
what the source puts into a batch (maxFilesPerTrigger, maxBytesPerTrigger), not
by the assets' history. GROUPS must stay the same as long as a state is kept.

Events without a key, time, side, or with a quantity that is null or not above
zero are told as invalid. Missing prices and fees count as zero.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.fifo import Q, priced

MICRO = 1_000_000
#: Groups that assets are dealt into.
GROUPS = 4096
_LOT = "asset string, id string, at long, quantity long, price long, fees long, remaining long"
_SIDES = "id string, at long, quantity long, price long, fees long"
_OUT = ["asset", "status", *(f"{side}_{f.split()[0]}" for side in ("l", "r") for f in _SIDES.split(", ")), "matched"]
_SCHEMA = "asset string, status string, " + ", ".join(f"{side}_{f}" for side in ("l", "r") for f in _SIDES.split(", ")) + ", matched long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenLots(StatefulProcessor):
    """Takes the events of each asset of a group in turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lots = handle.getListState("lots", _LOT)
        self.last = handle.getListState("last", "asset string, at long, id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        good = events["at"].notna() & events["side"].isin([1, -1]) & (events["quantity"].fillna(0) > 0) & events["asset"].notna()
        out = [(e.asset, "invalid", *[None] * 5, e.id, *map(_whole, (e.at, e.quantity, e.price, e.fees)), None) for e in events[~good].itertuples()]
        open_lots, last = {}, {x[0]: (x[1], x[2]) for x in self.last.get()} if self.last.exists() else {}
        for x in self.lots.get() if self.lots.exists() else ():
            open_lots.setdefault(x[0], deque()).append(list(x[1:]))
        held = {asset: sum(x[5] for x in lots) for asset, lots in open_lots.items()}
        turns = events[good].sort_values(["asset", "at", "id"], kind="stable")
        for asset, name, at, side, quantity, price, fees in zip(*(turns[c].tolist() for c in ("asset", "id", "at", "side", "quantity", "price", "fees")), strict=True):
            at, quantity = int(at), int(quantity)
            own = (name, at, quantity, _whole(price) or 0, _whole(fees) or 0)
            if asset in last and (at, name) < last[asset]:
                out.append((asset, "late", *[None] * 5, *own, None))
                continue
            last[asset] = (at, name)
            lots = open_lots.setdefault(asset, deque())
            if side == 1:
                lots.append([*own, quantity])
                held[asset] = held.get(asset, 0) + quantity
            elif quantity > held.get(asset, 0):
                out.append((asset, "rejected", *[None] * 5, *own, None))
            else:
                held[asset], left = held[asset] - quantity, quantity
                while left:
                    part = min(left, lots[0][5])
                    out.append((asset, "matched", *lots[0][:5], *own, part))
                    left, lots[0][5] = left - part, lots[0][5] - part
                    if not lots[0][5]:
                        lots.popleft()
        kept = [(asset, *x) for asset, lots in open_lots.items() for x in lots]
        if kept:
            self.lots.put(kept)
        else:
            self.lots.clear()
        if last:
            self.last.put([(asset, *x) for asset, x in last.items()])
        told = pd.DataFrame(out, columns=_OUT)
        yield told.astype({c: "Int64" for c in _OUT if c.split("_")[-1] in ("at", "quantity", "price", "fees", "matched")})

    def close(self) -> None:
        pass


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def matches(events: DataFrame, asset: str = "isin", at: str = "event_timestamp") -> DataFrame:
    """What a stream of events (asset, id, at, action, quantity, unit_price, fees) leads to, as events arrive.

    (asset, status, l, r, matched, cost, proceeds, gain): status matched has a lot l and a sale r; rejected, late and invalid have the event as r.
    """
    micro = lambda c: (F.col(c).cast("decimal(20,6)") * MICRO).cast("long")
    action = F.lower("action")
    rows = events.select(
        F.col(asset).alias("asset"), F.col("id").cast("string").alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"),
        F.when(action == "buy", 1).when(action == "sell", -1).alias("side"), micro("quantity").alias("quantity"), micro("unit_price").alias("price"), micro("fees").alias("fees"),
    )
    found = rows.withColumn("_group", F.pmod(F.xxhash64("asset"), F.lit(GROUPS)).cast("int")).groupBy("_group").transformWithStateInPandas(OpenLots(), _SCHEMA, "Append", "None")
    money = lambda c, kind="decimal(20,6)": (F.col(c).cast("decimal(28,0)") / MICRO).cast(kind)

    def side(s: str):
        fields = F.struct(F.col(f"{s}_id").alias("id"), F.timestamp_micros(f"{s}_at").alias("at"), money(f"{s}_quantity").alias("quantity"), money(f"{s}_price").alias("unit_price"), money(f"{s}_fees").alias("fees"))
        return F.when(F.col(f"{s}_id").isNotNull(), fields)

    return priced(found.select(F.col("asset").alias(asset), "status", side("l").alias("l"), side("r").alias("r"), money("matched", Q).alias("matched")))


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside the given one that keeps state as such streams need it."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return own


def follow(events: DataFrame, out: str, state: str, asset: str = "isin", at: str = "event_timestamp") -> StreamingQuery:
    """Take what has arrived, append what it leads to to Parquet under out, keep lots under state, and stop; started again it goes on from there.

    events is a stream of a session from stateful().
    """
    return matches(events, asset, at).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
