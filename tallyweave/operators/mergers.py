"""Corporate mergers: exchange ratios and what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialize import united

RATIO = "decimal(18,6)"


def nav_ratio(old: Column, new: Column) -> Column:
    """Old over new price, to six places, half to even."""
    return F.bround(old.cast(RATIO) / new.cast(RATIO), 6).cast(RATIO)


def resolved(mergers: DataFrame) -> DataFrame:
    """Mergers (old_nav, new_nav, old_quantity) with ratio, new quantity, whole units, fraction and payout."""
    ratio = nav_ratio(F.col("old_nav"), F.col("new_nav"))
    out = mergers.withColumn("ratio", ratio).withColumn("new_quantity", (F.col("old_quantity").cast(RATIO) * F.col("ratio")).cast("decimal(28,6)"))
    out = out.withColumn("whole_units", F.floor("new_quantity").cast("long")).withColumn("fraction", (F.col("new_quantity") - F.col("whole_units")).cast("decimal(28,6)"))
    return out.withColumn("cash_payout", F.bround(F.col("fraction") * F.col("new_nav").cast(RATIO), 2).cast("decimal(20,2)"))


def ratio_of(direct: Column, old_nav: Column, new_nav: Column, whole: Column, cash: Column, old_quantity: Column) -> Column:
    """A given ratio, else that of the prices, else that of what was received."""
    received = (whole.cast(RATIO) + F.greatest(F.coalesce(cash.cast(RATIO) / F.nullif(new_nav.cast(RATIO), F.lit(0).cast(RATIO)), F.lit(0).cast(RATIO)), F.lit(0).cast(RATIO))).cast(RATIO)
    return F.coalesce(direct.cast(RATIO), F.when((old_nav > 0) & (new_nav > 0), nav_ratio(old_nav, new_nav)), F.when(old_quantity > 0, F.bround(received / old_quantity.cast(RATIO), 6).cast(RATIO)))


def nav(requests: DataFrame, prices: list[DataFrame], override: str | None = None) -> DataFrame:
    """requests (isin, price_date) with the price of the first source that has that very day; an override goes first."""
    out, found = requests, [F.col(override)] if override else []
    for k, p in enumerate(prices):
        out = out.join(p.select("isin", "price_date", F.col("price").alias(f"_p{k}")), ["isin", "price_date"], "left")
        found.append(F.col(f"_p{k}"))
    return out.withColumn("price", F.coalesce(*found)).drop(*(f"_p{k}" for k in range(len(prices))))


def latest(mergers: DataFrame, old_isin: str) -> DataFrame:
    return mergers.where(F.lower("old_isin") == old_isin.lower()).orderBy(F.desc("effective_date"), F.desc("id")).limit(1)


def added(mergers: DataFrame, old_isin: str, new_isin: str, effective_date, new_symbol: str | None = None, exchange_ratio=1) -> DataFrame:
    """mergers with one more, ISINs in capitals, under the next id; two different ISINs and a positive ratio are needed."""
    old, new = (old_isin or "").strip().upper(), (new_isin or "").strip().upper()
    if not old or not new or old == new or not exchange_ratio > 0:
        raise ValueError("a merger needs two different ISINs and a positive ratio")
    row = mergers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).select(
        (F.col("last") + 1).alias("id"), F.lit(old).alias("old_isin"), F.lit(new).alias("new_isin"), F.lit(new_symbol and new_symbol.strip().upper()).alias("new_symbol"),
        F.lit(effective_date).cast("timestamp").alias("effective_date"), F.lit(str(exchange_ratio)).cast(RATIO).alias("exchange_ratio"),
    )
    typed = row.select(*(F.col(c).cast(mergers.schema[c].dataType).alias(c) for c in row.columns if c in mergers.columns))
    return mergers.transform(united, typed, allowMissingColumns=True)
