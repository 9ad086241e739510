"""Changes to tables as new tables: keyed merges, promotions, deletes. Writing is the caller's, under a new path or a table format's own merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import validation
from .materialize import stored, united


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new in place of those with their keys; a key twice in new is an error."""
    once = new.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    good = F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("key twice:"), *(F.col(k).cast("string") for k in keys))).cast("boolean")).otherwise(F.lit(True))
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).transform(united, once.where(good).drop("_n"), allowMissingColumns=True)


def updated(rows: DataFrame, where: Column, **values) -> DataFrame:
    """rows with columns set where a condition holds."""
    return rows.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, v in values.items()})


def deleted(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(~F.coalesce(where, F.lit(False)))


def appended(old: DataFrame, new: DataFrame, id_column: str = "id") -> DataFrame:
    """old and new, whose rows get the ids after the last one; ids are given by partition sizes, not by one task."""
    last = old.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("last")).first()["last"]
    # Read twice, and the same each time only if stored.
    numbered = stored(new.drop(id_column).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_first"))
    starts = sizes.select("_p", "_first", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ids = (F.lit(last) + F.col("start") + F.col("_m") - F.col("_first") + 1).cast("long")
    return old.transform(united, numbered.join(starts, "_p").withColumn(id_column, ids).drop("_p", "_m", "_first", "start"), allowMissingColumns=True)


def _probe(rows: DataFrame) -> list[Column]:
    """What two rows share if they are the same event: day, action, quantity, and ISIN, else symbol, else kind."""
    who = F.coalesce(*(F.nullif(F.upper(F.trim(rows[c])), F.lit("")) for c in ("isin", "symbol")), F.upper(rows["asset_type"]))
    return [F.to_date(rows["event_timestamp"]).alias("_day"), F.lower(rows["action"]).alias("_action"), F.coalesce(rows["quantity"].cast("decimal(20,6)"), F.lit(-1).cast("decimal(20,6)")).alias("_quantity"), who.alias("_who")]


def duplicates(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """staged with is_duplicate: whether the ledger has the same event."""
    there = ledger.select(*_probe(ledger)).distinct().withColumn("_there", F.lit(True))
    keyed = staged.select("*", *_probe(staged))
    return keyed.join(there, ["_day", "_action", "_quantity", "_who"], "left").withColumn("is_duplicate", F.coalesce("_there", F.lit(False))).drop("_day", "_action", "_quantity", "_who", "_there")


def _firsts(rows: DataFrame) -> DataFrame:
    """rows (_probe() and _held: whether the ledger has it) with _first: whether a row leads its event, what the ledger has before what is staged, then by id.

    One exchange by event, and none if rows lie by day of event_timestamp.
    """
    order = Window.partitionBy("_day", "_action", "_quantity", "_who").orderBy(F.desc("_held"), "id")
    return rows.withColumn("_first", F.row_number().over(order) == 1)


def promoted_together(rows: DataFrame, held: Column) -> DataFrame:
    """promoted()[0] where ledger and staged rows are one table, of which each row is staged, and in the ledger if held; rows are not dealt out again if they lie by day."""
    held = F.coalesce(held, F.lit(False))
    last = rows.where(held).agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    every = rows.withColumn("_held", F.explode(F.when(held, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    good = every.where(F.col("_held") | (validation.is_approvable() & F.col("approved_financial_record_id").isNull()))
    out = _firsts(good.select("*", *_probe(good))).where("_held OR _first")
    moved = {"id": F.when(F.col("_held"), F.col("id")).otherwise(last + F.col("id") + 1).cast("long"), "verification_status": F.when(F.col("_held"), F.col("verification_status")).otherwise("approved")}
    return out.withColumns(moved).select(*(c for c in rows.columns if c != "approved_financial_record_id"))


def promoted(staged: DataFrame, ledger: DataFrame, force: bool = False, where: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger with what may be promoted, staged with status and link, what was refused and why).

    Rows are promoted as if one after the other by id: of several staged rows of one event the first moves, and the ledger then
    has it for the others, unless forced. The id of a promoted row is derived from its staged id and the ledger's last one.
    """
    fresh = staged.where("approved_financial_record_id IS NULL").where(where if where is not None else F.lit(True))
    asked, good = duplicates(fresh, ledger), fresh.where(validation.is_approvable())
    if not force:
        # Staged rows meet the ledger's events where they are dealt to. Parts of an event that are null would meet as well, but no row without them may be approved.
        # What is promoted comes about without asked, which only what is refused needs.
        there = ledger.select(*_probe(ledger)).distinct().withColumn("_held", F.lit(True))
        good = _firsts(good.select("*", *_probe(good), F.lit(False).alias("_held")).transform(united, there, allowMissingColumns=True)).where("_first AND NOT _held").select(good.columns)
        firsts = good.select(F.col("id").alias("_first"))
        known = asked.join(firsts, asked["id"] == firsts["_first"], "left")
        asked = known.withColumn("is_duplicate", F.col("is_duplicate") | (validation.is_approvable() & F.col("_first").isNull())).drop("_first")
    reasons = F.array_compact(F.array(F.when(~validation.is_approvable(), F.concat(F.lit("missing: "), F.array_join(validation.missing_fields(), ", "))), F.when(F.lit(not force) & F.col("is_duplicate"), F.lit("duplicate"))))
    refused = asked.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last")).first()["last"]
    moved = good.withColumns({"_staged": F.col("id"), "id": (F.lit(last) + F.col("id") + 1).cast("long"), "verification_status": F.lit("approved")})
    linked = staged.join(moved.select(F.col("_staged").alias("_s"), F.col("id").alias("_link")), staged["id"] == F.col("_s"), "left")
    linked = linked.withColumns({"approved_financial_record_id": F.coalesce("approved_financial_record_id", "_link"), "verification_status": F.when(F.col("_link").isNotNull(), "approved").otherwise(F.col("verification_status"))}).drop("_s", "_link")
    return ledger.transform(united, moved.select(ledger.columns)), linked, refused


def promoted_income(staged: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged income with a payload moves over; without one it stays."""
    good = staged.where("payload_json IS NOT NULL AND approved_tax_income_record_id IS NULL")
    last = approved.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last")).first()["last"]
    moved = good.withColumn("_id", (F.lit(last) + F.col("id") + 1).cast("long"))
    linked = staged.join(moved.select(F.col("id").alias("_s"), F.col("_id").alias("_link")), staged["id"] == F.col("_s"), "left")
    linked = linked.withColumns({"approved_tax_income_record_id": F.coalesce("approved_tax_income_record_id", "_link"), "verification_status": F.when(F.col("_link").isNotNull(), "approved").otherwise(F.col("verification_status"))}).drop("_s", "_link")
    return approved.transform(united, moved.withColumn("id", F.col("_id")).select(approved.columns)), linked


def rejected(staged: DataFrame, ids: DataFrame) -> DataFrame:
    """staged with the rows of these ids (a table with id) marked as rejected; those that have been promoted stay as they are."""
    asked = ids.select(F.col("id").alias("_id")).distinct().withColumn("_asked", F.lit(True))
    told = staged.join(asked, staged["id"] == F.col("_id"), "left")
    return updated(told, F.coalesce("_asked", F.lit(False)) & F.col("approved_financial_record_id").isNull(), verification_status="rejected").drop("_id", "_asked")


_FIELD = "struct<value:string,value_type:string,status:string>"


def field_set(fields: Column, name: str, value: str | Column, kind: str, status: str) -> Column:
    """A form's fields (map of struct) with one set; what the user has overridden only the user changes."""
    new = F.create_map(F.lit(name), F.struct((value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(kind).alias("value_type"), F.lit(status).alias("status")))
    held = F.coalesce(fields, F.create_map().cast(f"map<string,{_FIELD}>"))
    locked = F.coalesce(F.try_element_at(held, F.lit(name))["status"] == "user_override", F.lit(False)) & F.lit(status != "user_override")
    return F.when(locked, held).otherwise(F.map_concat(F.map_filter(held, lambda k, _: k != name), new))


def field_cleared(fields: Column, name: str) -> Column:
    return F.map_filter(fields, lambda k, v: (k != name) | F.coalesce(v["status"] == "user_override", F.lit(False)))


def form_rows(forms: DataFrame, sections: tuple[str, ...] = ("capital_gains", "income", "tax_credits", "additional_fields"), key: str = "id") -> DataFrame:
    """A row for each field of each section."""
    parts = [forms.select(key, F.lit(s).alias("section"), F.explode(s).alias("field", "_v")) for s in sections]
    out = parts[0]
    for p in parts[1:]:
        out = out.transform(united, p)
    return out.select(key, "section", "field", "_v.*")
