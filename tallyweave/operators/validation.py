"""Ledger rows that hold what their action needs: as an array of errors, strict, or split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACTIONS, ASSET_TYPES, STATUSES

HEADER = ("event_timestamp", "action", "currency", "total_amount", "fx_rate", "local_total_amount", "tax_year", "account_country", "provider")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def identity() -> Column:
    """ISIN, else symbol, else name; NULL if all are blank."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("isin", "symbol", "asset_name")))


def errors() -> Column:
    """What is wrong with a ledger row, as an array of messages."""
    action, kind, status = (F.lower(F.trim(F.col(c))) for c in ("action", "asset_type", "verification_status"))
    trade, security = action.isin("buy", "sell"), action.isin("buy", "sell", "dividend")
    checks = [(F.col(c).isNull(), f"{c} is missing") for c in HEADER]
    checks += [
        (~action.isin(*ACTIONS), "unknown action"),
        (status.isNotNull() & ~status.isin(*STATUSES), "unknown verification status"),
        (action.isin("salary_payout", "corporate_action"), "action has no strict form"),
        (security & kind.isNull(), "asset_type is missing"),
        (security & kind.isNotNull() & ~kind.isin(*ASSET_TYPES), "unknown asset type"),
        (security & identity().isNull(), "no isin, symbol or name"),
        (trade & ~F.coalesce(F.col("quantity") > 0, F.lit(False)), "quantity must be positive"),
        (trade & ~F.coalesce(F.col("unit_price") >= 0, F.lit(False)), "unit_price must not be negative"),
        (trade & ~F.coalesce(F.col("fees") >= 0, F.lit(False)), "fees must not be negative"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(message)) for bad, message in checks)))


def validated(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("errors", errors())


def split(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their errors."""
    rows = validated(ledger)
    return rows.where(F.size("errors") == 0).drop("errors"), rows.where(F.size("errors") > 0)


def strict(ledger: DataFrame) -> DataFrame:
    """The rows; a bad one fails the query."""
    rows = validated(ledger)
    check = F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("bad ledger row: "), F.array_join("errors", "; ")))).otherwise(F.lit(True))
    return rows.where(check.cast("boolean")).drop("errors")


def to_raw(ledger: DataFrame) -> DataFrame:
    """Strict rows as ledger rows again; what a strict row does not carry is NULL."""
    gone = {c: F.lit(None).cast(ledger.schema[c].dataType) for c in ("source_file_name", "additional_metadata", "consensus_log", "openfigi_detected") if c in ledger.columns}
    trade = F.lower("action").isin("buy", "sell")
    return ledger.withColumns(gone | {"quantity": F.when(trade, F.col("quantity"))})


def missing_fields() -> Column:
    """Columns that a staged row lacks before it may be approved."""
    loose = F.lower(F.coalesce("action", F.lit(""))).rlike("dividend|ritenuta|tax|salary")
    needed = ["provider", "event_timestamp", "asset_type", "action", "currency", "total_amount", "account_country"]
    return F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in needed), *(F.when(~loose & F.col(c).isNull(), F.lit(c)) for c in ("quantity", "unit_price"))))


def is_approvable() -> Column:
    return F.size(missing_fields()) == 0


def chunk_errors() -> Column:
    """Regulations need a jurisdiction, research does not."""
    return F.array_compact(F.array(
        F.when(~F.col("source_type").isin("regulation", "research"), F.lit("unknown source type")),
        F.when((F.col("source_type") == "regulation") & _blank("jurisdiction"), F.lit("jurisdiction is missing")),
        F.when(F.col("chunk_index") < 0, F.lit("chunk_index must not be negative")),
    ))


def conserved(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys at which two tables differ in the sum of a column: no rows if it is conserved."""
    sums = [d.groupBy(*keys).agg(F.sum(column).alias(name)) for d, name in ((left, "left_sum"), (right, "right_sum"))]
    return sums[0].join(sums[1], keys, "full").where(~F.coalesce("left_sum", F.lit(0)).eqNullSafe(F.coalesce("right_sum", F.lit(0))))


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds)


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds)
