"""First-in-first-out lots without state: cumulative quantities are intervals, and a match is an overlap.

Every breakpoint of a line of quantity belongs to one lot and one sale, so no
pairs are tried. Keys with up to FEW rows are dealt out once, and all is found
where they lie. Those with more are told apart first (parted()): their running
sums are taken in two steps, by (keys, month) and within it, and overlaps by
blocks of the line, so that one asset with very many rows is dealt over both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import stored, united

Q = "decimal(28,6)"
#: Units of quantity to a block.
BLOCK = 4096
#: Rows of some keys that one task may hold, those that a task gets on average, and into how many groups keys are dealt to count them.
FEW, EACH, GROUPS = 50_000, 50_000, 1 << 16


def parted(df: DataFrame, keys: list[str], *others: DataFrame) -> list[tuple[int, list[DataFrame]]]:
    """The tables (df and others) in parts by keys: rows of keys that all fit a task, with the number of tasks to deal them to, and the rest,
    with 0, if there are any.

    Rows are counted by hash of keys where they lie; groups with more than FEW rows are the rest, and few keys may go with them.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS))
    every = df.select(*keys)
    for other in others:
        every = every.transform(united, other.select(*keys))
    # At most a number for each FEW rows comes to the driver.
    counted = every.groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    total, crowded = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(F.when(F.col("n") > FEW, F.col("g")))).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // EACH))
    if not crowded:
        return [(tasks, [df, *others])]
    many = group.isin(crowded)
    return [(tasks, [x.where(~many) for x in (df, *others)]), (0, [x.where(many) for x in (df, *others)])]


def joined(parts: list[DataFrame]) -> DataFrame:
    """Parts put together again."""
    return parts[0] if len(parts) == 1 else parts[0].transform(united, parts[1])


def running(df: DataFrame, keys: list[str], at: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Sums (column to new name) up to and with each row, by keys in the order of (at, *order); at is a timestamp."""
    df = df.withColumn("_month", F.date_trunc("month", F.col(at)))
    months = df.groupBy(*keys, "_month").agg(*(F.sum(c).alias(f"_{out}") for c, out in sums.items()))
    before = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(*keys, "_month", *(F.coalesce(F.sum(f"_{out}").over(before), F.lit(0)).cast(Q).alias(f"_before_{out}") for out in sums.values()))
    within = Window.partitionBy(*keys, "_month").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumns({f"_inside_{out}": F.sum(c).over(within) for c, out in sums.items()})
    found = inside.join(months, [*keys, "_month"]).withColumns({out: (F.col(f"_before_{out}") + F.col(f"_inside_{out}")).cast(Q) for out in sums.values()})
    return found.drop("_month", *(f"_{kind}_{out}" for kind in ("before", "inside") for out in sums.values()))


def intervals(df: DataFrame, keys: list[str], at: str, order: list[str], quantity: str = "quantity") -> DataFrame:
    """df with lo and hi: where a row's quantity lies on its keys' line."""
    return running(df, keys, at, order, {quantity: "hi"}).withColumn("lo", (F.col("hi") - F.col(quantity)).cast(Q))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, left struct l, right struct r and the quantity matched, for intervals [lo, hi) that overlap.

    Each side's intervals must not overlap among themselves. The other columns of a side are in its struct.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c not in (*keys, "lo", "hi")]
        blocks = F.sequence(F.floor(F.col("lo") / block).cast("long"), F.greatest(F.ceil(F.col("hi") / block).cast("long") - 1, F.floor(F.col("lo") / block).cast("long")))
        pieces = df.where("hi > lo").select(*keys, "lo", "hi", F.struct(*fields).alias(name), F.explode(blocks).alias("_block"))
        return pieces.select(*keys, "_block", F.greatest("lo", (F.col("_block") * block).cast(Q)).cast(Q).alias("at"), F.struct("lo", "hi", F.col(name).alias("row")).alias(name))

    return _met(cut(left, "l").transform(united, cut(right, "r"), allowMissingColumns=True), keys, ["_block"])


def _met(points: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """overlaps() of pieces (at, and l or r: lo, hi, row); an overlap is told where it begins, which is in one piece of the line."""
    line = Window.partitionBy(*keys, *within).orderBy("at")
    upto = line.rangeBetween(Window.unboundedPreceding, 0)
    marked = points.select(*keys, "at", F.last("l", ignorenulls=True).over(upto).alias("l"), F.last("r", ignorenulls=True).over(upto).alias("r"), F.lead("at").over(line).alias("_next"))
    both = marked.where("l IS NOT NULL AND r IS NOT NULL AND at = greatest(l.lo, r.lo) AND (_next IS NULL OR _next > at)")
    return both.select(*keys, F.col("l.row").alias("l"), F.col("r.row").alias("r"), (F.least("l.hi", "r.hi") - F.col("at")).cast(Q).alias("matched")).where("matched > 0")


def accepted(events: DataFrame, keys: list[str], at: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events that take place, running totals of all): sales that the lots so far do not cover are left out whole.

    Both results and the events, which are read twice, are stored. events have side 1 (buy) or -1 (sell) and quantity; both results have bought and sold, up to and with each row.
    Keys whose running balance never goes below zero need no state. The others are streamed in order, one number held a key.
    """
    sides = events.withColumns({"_b": F.when(F.col("side") == 1, F.col("quantity")).otherwise(0), "_s": F.when(F.col("side") == -1, F.col("quantity")).otherwise(0)})
    line = stored(running(sides, keys, at, order, {"_b": "bought", "_s": "sold"}))
    short = line.where("sold > bought").select(*keys).distinct()
    # Stored before it is dealt out: behind a join by the same keys the planner would leave the exchange out, and then read the join's own in pieces.
    hard = stored(line.drop("bought", "sold").join(short, keys, "left_semi").withColumn("_units", (F.col("quantity").cast(Q) * 1_000_000).cast("long")))
    hard = hard.repartition(*keys).sortWithinPartitions(*keys, at, *order)

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, available = None, 0
        for rows in parts:
            keep = []
            for key, side, quantity in zip(zip(*(rows.column(k).to_pylist() for k in keys), strict=True), rows.column("side").to_pylist(), rows.column("_units").to_pylist(), strict=True):
                if key != last:
                    last, available = key, 0
                good = side == 1 or quantity <= available
                if good:
                    available += quantity * side
                keep.append(good)
            yield rows.filter(pa.array(keep, pa.bool_()))

    kept = running(stored(hard.mapInArrow(fold, hard.schema).drop("_units")), keys, at, order, {"_b": "bought", "_s": "sold"})
    return stored(line.join(short, keys, "left_anti").transform(united, kept).drop("_b", "_s")), line.drop("_b", "_s")


def accepted_sales(events: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    return accepted(events, keys, at, order)[0].where("side = -1").drop("bought", "sold")


def matched(lots: DataFrame, sales: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """FIFO matches of sales that are all covered: keys, l, r, matched, cost, proceeds and gain.

    Both sides have quantity, unit_price and fees; fees are shared by quantity.
    """
    found = [_together(a, b, keys, at, order, fit) if fit else overlaps(intervals(a, keys, at, order), intervals(b, keys, at, order), keys) for fit, (a, b) in parted(lots, keys, sales)]
    return priced(joined(found))


def _together(lots: DataFrame, sales: DataFrame, keys: list[str], at: str, order: list[str], tasks: int) -> DataFrame:
    """overlaps() of the lines of both sides for keys that fit a task: rows are dealt out once."""
    sides = [df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name)) for df, name in ((lots, "l"), (sales, "r"))]
    rows = sides[0].transform(united, sides[1], allowMissingColumns=True).dropna(subset=keys).repartition(tasks, *keys)
    line = Window.partitionBy(*keys).orderBy(*(f"{name}.{c}" for name in "lr" for c in (at, *order))).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_hi", F.when(F.col("l").isNotNull(), F.sum("l.quantity").over(line)).otherwise(F.sum("r.quantity").over(line)).cast(Q))
    rows = rows.withColumn("at", (F.col("_hi") - F.coalesce("l.quantity", "r.quantity")).cast(Q)).where("_hi > at")
    told = [F.when(F.col(x).isNotNull(), F.struct(F.col("at").alias("lo"), F.col("_hi").alias("hi"), F.col(x).alias("row"))).alias(x) for x in "lr"]
    return _met(rows.select(*keys, "at", *told), keys, [])


def priced(found: DataFrame) -> DataFrame:
    """Overlaps with cost, proceeds and gain."""
    cost = F.col("matched") * F.col("l.unit_price") + shared(F.col("l.fees"), F.col("matched"), F.col("l.quantity"))
    proceeds = F.col("matched") * F.col("r.unit_price") - shared(F.col("r.fees"), F.col("matched"), F.col("r.quantity"))
    out = found.withColumns({"cost": cost.cast(Q), "proceeds": proceeds.cast(Q)})
    return out.withColumn("gain", (F.col("proceeds") - F.col("cost")).cast(Q))


def shared(fees: Column, part: Column, whole: Column) -> Column:
    """fees * part / whole, divided last."""
    return (fees.cast("decimal(20,6)") * part.cast("decimal(18,6)") / whole.cast("decimal(18,6)")).cast(Q)


def open_lots(lots: DataFrame, sold: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """lots with remaining quantity and cost, after sold (keys, quantity) was taken from the oldest."""
    placed = intervals(lots, keys, at, order).join(sold.groupBy(*keys).agg(F.sum("quantity").cast(Q).alias("_sold")), keys, "left")
    return remaining(placed)


def remaining(placed: DataFrame) -> DataFrame:
    """Lots (hi, _sold) that are not sold out, with remaining quantity and cost."""
    left = F.greatest(F.lit(0).cast(Q), F.least(F.col("quantity").cast(Q), F.col("hi") - F.coalesce("_sold", F.lit(0).cast(Q)))).cast(Q)
    placed = placed.withColumn("remaining", left).where("remaining > 0")
    cost = F.col("remaining") * F.col("unit_price") + shared(F.col("fees"), F.col("remaining"), F.col("quantity"))
    return placed.withColumn("remaining_cost", cost.cast(Q)).drop("lo", "hi", "_sold")


def merged_lots(lots: DataFrame, old: str, new: str, effective, ratio) -> DataFrame:
    """Open lots of old become lots of new: quantity times ratio, the same cost, fees and date.

    lots: asset, acquired, quantity, unit_price, fees. Errors where a lot is later than the merger.
    """
    if not old or not new or old == new:
        raise ValueError("a merger needs two different assets")
    if not ratio > 0:
        raise ValueError("a merger needs a positive ratio")
    mine, ratio, day = F.col("asset") == old, F.lit(ratio).cast("decimal(18,6)"), F.lit(effective).cast("timestamp")
    quantity = (F.col("quantity") * ratio).cast("decimal(18,6)")
    price = ((F.col("quantity") * F.col("unit_price")).cast(Q) / quantity).cast("decimal(20,6)")
    late = F.when(mine & (F.col("acquired") > day), F.raise_error(F.lit("a lot is later than the merger")).cast("boolean")).otherwise(F.lit(True))
    moved = lots.where(late)
    return moved.withColumns({
        "unit_price": F.when(mine, price).otherwise(F.col("unit_price")).cast("decimal(20,6)"), "quantity": F.when(mine, quantity).otherwise(F.col("quantity")).cast("decimal(18,6)"),
        "asset": F.when(mine, F.lit(new)).otherwise(F.col("asset")),
    })


def merger_totals(lots: DataFrame, old: str, ratio) -> DataFrame:
    """Old and new quantity, whole units, fraction and number of lots of a merger."""
    total = lots.where(F.col("asset") == old).agg(F.sum("quantity").cast("decimal(18,6)").alias("old_quantity"), F.count("*").alias("lots"))
    new = (F.col("old_quantity") * F.lit(ratio).cast("decimal(18,6)")).cast("decimal(28,6)")
    return total.withColumn("new_quantity", new).withColumn("whole_units", F.floor("new_quantity").cast("long")).withColumn("fraction", (F.col("new_quantity") - F.col("whole_units")).cast("decimal(28,6)"))
