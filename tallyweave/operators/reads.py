"""Filtered and point reads of the engine's tables. Predicates stay plain comparisons, so scans can push them down."""

from __future__ import annotations

from datetime import datetime
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import end_of_day
from . import validation
from .materialize import united


def ledger_filter(
    ledger: DataFrame, asset_type: str | None = None, action: str | None = None, tax_year: int | None = None, isin: str | None = None, quantity_over: float | None = None, quantity_less: float | None = None,
    since: datetime | str | None = None, until: datetime | str | None = None, logic: Literal["AND", "OR"] = "AND", account_country: str | None = None, limit: int | None = None, strict: bool = False,
) -> DataFrame:
    """Rows that meet all or any of what is asked, by time. Rows that are not valid are left out, or fail the read if strict."""
    preds: list[Column] = [F.lower(c) == v.lower() for c, v in (("asset_type", asset_type), ("action", action), ("isin", isin)) if v is not None]
    preds += [F.col(c) == v for c, v in (("tax_year", tax_year), ("account_country", account_country)) if v is not None]
    if quantity_over is not None:
        preds.append(F.col("quantity") >= F.lit(str(quantity_over)).cast("decimal(20,6)"))
    if quantity_less is not None:
        preds.append(F.col("quantity") <= F.lit(str(quantity_less)).cast("decimal(20,6)"))
    if since is not None:
        preds.append(F.col("event_timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        preds.append(F.col("event_timestamp") <= end_of_day(F.lit(until).cast("timestamp")))
    if logic.upper() not in ("AND", "OR"):
        raise ValueError(f"no such logic: {logic}")
    rows = ledger if not preds else ledger.where((validation.all_of if logic.upper() == "AND" else validation.any_of)(preds))
    rows = (validation.strict(rows) if strict else validation.split(rows)[0]).orderBy("event_timestamp", "id")
    return rows if limit is None else rows.limit(limit)


def equal_filter(rows: DataFrame, order: tuple = ("event_timestamp", "id"), **wanted) -> DataFrame:
    """Rows that equal every value given that is not None: the lists of ledger, staged, income, remittance and chunk rows."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order) if order else rows


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value).limit(1)


def trades(ledger: DataFrame, isin: str, action: str, strict: bool = False) -> DataFrame:
    rows = ledger.where((F.lower("isin") == isin.lower()) & (F.lower("action") == action))
    return (validation.strict(rows) if strict else validation.split(rows)[0]).orderBy("event_timestamp", "id")


def purchases_in_window(ledger: DataFrame, isin: str, after, before) -> DataFrame:
    """Purchases later than after, and up to before."""
    return trades(ledger, isin, "buy").where((F.col("event_timestamp") > F.lit(after).cast("timestamp")) & (F.col("event_timestamp") <= F.lit(before).cast("timestamp")))


def fresh(files: DataFrame, manifest: DataFrame, key: str = "file_sha", done: str = "SUCCESS") -> DataFrame:
    """Files that the manifest does not have as done."""
    return files.join(manifest.where(F.col("status") == done).select(key), key, "left_anti")


def fresh_income(files: DataFrame, staged: DataFrame, approved: DataFrame, key: str = "source_document_sha") -> DataFrame:
    return files.join(staged.select(key).transform(united, approved.select(key)).distinct(), key, "left_anti")


def searched(rows: DataFrame, text: str, columns: tuple[str, ...] = ("symbol", "provider", "isin", "asset_name")) -> DataFrame:
    """Rows whose columns, joined by blanks, hold a text in any case."""
    if not text.strip():
        return rows
    return rows.where(F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))).contains(text.strip().lower()))


def latest_mergers(mergers: DataFrame) -> DataFrame:
    """The latest merger of each old ISIN."""
    order = Window.partitionBy(F.lower("old_isin")).orderBy(F.desc("effective_date"), F.desc("id"))
    return mergers.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def income(rows: DataFrame, schema: str | None = None, **wanted) -> DataFrame:
    """Income rows with their payload parsed."""
    from ..schemas import INCOME_PAYLOAD

    return equal_filter(rows, (F.desc("tax_year"), F.desc("id")), **wanted).withColumn("payload", F.from_json("payload_json", schema or INCOME_PAYLOAD))


def isins_of_regime(classes: DataFrame, regime: str) -> DataFrame:
    return classes.where(F.col("tax_regime") == regime).select("isin")


def classes(rows: DataFrame) -> DataFrame:
    """All classifications by ISIN; one without domicile fails the read."""
    good = F.when(F.col("domicile_country").isNull(), F.raise_error(F.concat(F.lit("no domicile of "), "isin")).cast("boolean")).otherwise(F.lit(True))
    return rows.where(good).orderBy("isin")


def figi_backfilled(rows: DataFrame, figi: DataFrame) -> DataFrame:
    """Rows with symbol and detection filled from a table (isin, ticker, name), where they lack them."""
    known = figi.select(F.upper("isin").alias("_isin"), "ticker", "name").dropDuplicates(["_isin"])
    out = rows.join(known, F.upper(rows["isin"]) == F.col("_isin"), "left")
    return out.withColumns({"symbol": F.coalesce("symbol", "ticker"), "openfigi_detected": F.coalesce("openfigi_detected", "name")}).drop("_isin", "ticker", "name")


def tax_years(sessions: DataFrame, column: str = "tax_year") -> DataFrame:
    return sessions.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.desc(column))


def net_holding(ledger: DataFrame, isin: str, on) -> DataFrame:
    """Bought less sold up to a moment, in either language of the ledger."""
    action = F.lower("action")
    signed = F.when(action.isin("buy", "acquisto"), F.col("quantity")).when(action.isin("sell", "vendita"), -F.col("quantity"))
    rows = ledger.where((F.lower("isin") == isin.lower()) & (F.col("event_timestamp") <= F.lit(on).cast("timestamp")))
    return rows.agg(F.coalesce(F.sum(signed), F.lit(0)).cast("decimal(28,6)").alias("holding"))


def with_local_amount(rows: DataFrame) -> DataFrame:
    """local_total_amount where it lacks: the total in EUR, else times the rate."""
    total = F.col("total_amount").cast("decimal(20,6)")
    return rows.withColumn("local_total_amount", F.coalesce("local_total_amount", F.when(F.upper("currency") == "EUR", total).otherwise((total * F.col("fx_rate").cast("decimal(18,6)")).cast("decimal(20,6)"))))


def tree(paths: DataFrame, name: str | None = None, column: str = "path") -> DataFrame:
    """The folders and files of a table of paths: path, name, parent, depth, kind (dir, file), files (how many a folder has below it) and place.

    Ordered by place they are a tree: each folder before what it holds, folders before files, names without regard to case.
    What begins with a dot is left out with all below it. With a name, only files and folders whose own name holds it stay,
    and the folders that they are in. Paths that repeat, are null or empty count once or not at all.
    """
    parts = F.filter(F.split(column, "/"), lambda x: x != "")
    rows = paths.select(parts.alias("_parts")).distinct().where((F.size("_parts") > 0) & ~F.exists("_parts", lambda x: x.startswith(".")))
    last = F.size("_parts")
    if name and name.strip():
        wanted = name.strip().lower()
        # A path is followed down to the deepest of its names that is wanted.
        last = F.coalesce(F.array_max(F.filter(F.transform("_parts", lambda x, k: F.when(F.lower(x).contains(wanted), k + 1)), lambda k: k.isNotNull())), F.lit(0))
    rows = rows.withColumn("_last", last).where("_last > 0").select("_parts", F.explode(F.sequence(F.lit(1), "_last")).alias("depth"))
    told = rows.select(F.slice("_parts", F.lit(1), F.col("depth")).alias("_own"), "depth", (F.col("depth") == F.size("_parts")).alias("_file"))
    nodes = told.groupBy("_own", "depth", "_file").agg(F.count("*").alias("files"))
    # A level's folders sort before its files; a folder's key begins those of all below it.
    key = F.concat(F.transform(F.slice("_own", F.lit(1), F.col("depth") - 1), lambda x: F.concat(F.lit("0"), F.lower(x))), F.array(F.concat(F.col("_file").cast("int").cast("string"), F.lower(F.element_at("_own", -1)))))
    return nodes.select(
        F.array_join("_own", "/").alias("path"), F.element_at("_own", -1).alias("name"), F.array_join(F.slice("_own", F.lit(1), F.col("depth") - 1), "/").alias("parent"), "depth",
        F.when(F.col("_file"), "file").otherwise("dir").alias("kind"), F.when(~F.col("_file"), F.col("files")).alias("files"), F.array_join(key, "\x01").alias("place"),
    )
