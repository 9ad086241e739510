"""Several independent extractions of a document, reconciled.

votes: document, voter (1 to 3), and the columns of schemas.EXTRACTION. Deal them out with dealt() first: all that follows is found where the
votes of a document lie, so one exchange does for several of these functions.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import company_key
from ..schemas import MONEY

FIELDS = ("event_date", "asset_type", "symbol", "isin", "action", "quantity", "unit_price", "currency", "fees", "total_amount", "fx_rate", "asset_name", "provider")
MATCH = 0.40
#: Extractions that a task gets on average.
EACH = 50_000


def _blank(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)), F.lit(""))


def _near(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < F.lit("0.000001").cast("decimal(20,6)"), a.isNull() & b.isNull())


def equivalent(a: Column, b: Column) -> Column:
    """Whether two extractions (structs) say the same."""
    out = (F.date_trunc("hour", a["event_date"]) == F.date_trunc("hour", b["event_date"])) & (a["asset_type"] == b["asset_type"]) & (a["action"] == b["action"]) & (_blank(a["currency"]) == _blank(b["currency"]))
    for c in ("quantity", "unit_price", "fees", "total_amount", "fx_rate"):
        out = out & _near(a[c], b[c])
    for c in ("symbol", "isin", "provider"):
        out = out & (company_key(a[c]) == company_key(b[c]))
    return F.coalesce(out, F.lit(False))


def _compared(r: Column) -> Column:
    """What similarity() looks at, worked out once for each extraction."""
    at = r["event_date"]
    return F.struct(
        F.date_trunc("hour", at).alias("hour"), F.to_date(at).alias("day"), F.unix_timestamp(at).alias("second"), r["action"].alias("action"), r["asset_type"].alias("asset_type"),
        _blank(r["symbol"]).alias("symbol"), _blank(r["isin"]).alias("isin"), r["total_amount"].alias("total_amount"), r["quantity"].alias("quantity"),
    )


def _alike(a: Column, b: Column) -> Column:
    """Hundredths of likeness of two extractions as _compared() gives them."""

    def close(c: str, exact: str) -> Column:
        gap = F.abs(a[c] - b[c])
        return F.when(gap < F.lit(exact).cast("decimal(20,6)"), 15).when((a[c] > 0) & (gap * 20 <= a[c]), 10).otherwise(0)

    s1, s2, i1, i2 = a["symbol"], b["symbol"], a["isin"], b["isin"]
    when = F.when(a["hour"] == b["hour"], 25).when(a["day"] == b["day"], 20).when(F.abs(a["second"] - b["second"]) <= 172800, 3).otherwise(0)
    same = F.when(a["action"] == b["action"], 10).otherwise(0) + F.when(a["asset_type"] == b["asset_type"], 10).otherwise(0)
    who = F.when(((s1 != "") & (s1 == s2)) | ((i1 != "") & (i1 == i2)), 25).when((s1 != "") & (s2 != "") & (s1.contains(s2) | s2.contains(s1)), 15).otherwise(0)
    return when + same + who + close("total_amount", "0.01") + close("quantity", "0.0001")


def similarity(a: Column, b: Column) -> Column:
    """Between 0 and 1, to two places: date, action and kind, identifiers, amount and quantity."""
    return (_alike(_compared(a), _compared(b)) / 100).cast("double")


def dealt(votes: DataFrame) -> DataFrame:
    """votes, those of a document together, in as many tasks as their number asks for; the planner goes by packed bytes, and extractions pack well."""
    tasks = max(votes.sparkSession.sparkContext.defaultParallelism, -(-votes.count() // EACH))
    return votes.repartition(tasks, "document")


def numbered(votes: DataFrame) -> DataFrame:
    """votes as structs r with their position in their voter's order."""
    order = Window.partitionBy("document", "voter").orderBy(F.date_format("event_date", "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce("symbol", F.lit("")), "action", *FIELDS)
    return votes.withColumn("position", F.row_number().over(order) - 1).select("document", "voter", "position", F.struct(*FIELDS).alias("r"))


def _sameness(r: Column) -> list[Column]:
    """What two extractions share just if they are equivalent(), by name; the first is whether an extraction can be equivalent to any.

    Amounts are held to six places, as all money here, so that nearer than a millionth is equal.
    """
    need = [F.date_trunc("hour", r["event_date"]), r["asset_type"], r["action"], *(company_key(r[c]) for c in ("symbol", "isin", "provider"))]
    rest = [_blank(r["currency"]), *(r[c].cast(MONEY) for c in ("quantity", "unit_price", "fees", "total_amount", "fx_rate"))]
    fit = reduce(lambda a, b: a & b, (c.isNotNull() for c in need))
    return [fit.alias("_fit"), *(c.alias(f"_k{n}") for n, c in enumerate([*need, *rest]))]


def distinct_candidates(votes: DataFrame) -> DataFrame:
    """What no earlier candidate is equivalent to, numbered in order of voter and position.

    Equivalent extractions share their keys, so the first of each stays, found by partial aggregation; no extractions are compared in pairs. One that
    lacks what equivalence needs is a candidate of its own.
    """
    keyed = numbered(votes).select("document", F.struct("voter", "position").alias("_at"), "r", *_sameness(F.col("r")))
    alone = F.when(~F.col("_fit"), F.col("_at")).alias("_alone")
    first = keyed.groupBy("document", "_fit", alone, *(c for c in keyed.columns if c.startswith("_k"))).agg(F.min_by("r", "_at").alias("r"), F.min("_at").alias("_at"))
    return first.select("document", (F.row_number().over(Window.partitionBy("document").orderBy("_at")) - 1).alias("candidate"), "r")


def _likest(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """(document, candidate, voter, score, position) of the most similar extraction of each voter, if it is similar at all.

    The best of all pairs is the largest number made of hundredths of likeness and the position counted down, so pairs are neither sorted nor kept.
    """
    told = numbered(votes).select("document", "voter", "position", _compared(F.col("r")).alias("v"))
    pairs = candidates.select("document", "candidate", _compared(F.col("r")).alias("c")).join(told, "document")
    likeness = F.shiftleft(_alike(F.col("v"), F.col("c")).cast("long"), 32)
    best = pairs.groupBy("document", "candidate", "voter").agg(F.max(likeness + F.lit((1 << 32) - 1) - F.col("position")).alias("_best"))
    position = (F.lit((1 << 32) - 1) - F.col("_best").bitwiseAND(F.lit((1 << 32) - 1))).cast("int")
    return best.select("document", "candidate", "voter", (F.shiftright("_best", 32) / 100).alias("score"), position.alias("position")).where(f"score >= {MATCH}")


def best_matches(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """For each candidate the most similar extraction of each voter, if it is similar at all."""
    found = _likest(candidates, votes).join(candidates, ["document", "candidate"])
    own = numbered(votes).select("document", F.col("voter").alias("_voter"), F.col("position").alias("_position"), F.col("r").alias("v"))
    found = found.join(own, "document").where("voter <=> _voter AND position = _position")
    return found.select("document", "candidate", "r", "voter", "position", "v", "score")


def _abreast(votes: DataFrame) -> DataFrame:
    """(document, position, r1, r2, r3): what the voters have at each position."""
    sides = (F.any_value(F.when(F.col("voter") == v, F.col("r")), ignoreNulls=True).alias(f"r{v}") for v in (1, 2, 3))
    return numbered(votes).groupBy("document", "position").agg(*sides)


def verified(votes: DataFrame) -> DataFrame:
    """(document, status, error, mismatches): approved if all three voters agree on every row in order."""
    r1, r2, r3 = map(F.col, ("r1", "r2", "r3"))
    scores = [similarity(a, b) for a, b in ((r1, r2), (r2, r3), (r1, r3))]
    average = F.round((scores[0] + scores[1] + scores[2]) / 3, 2)
    odd = F.col("document").isNotNull() & r1.isNotNull() & r2.isNotNull() & r3.isNotNull() & ~(equivalent(r1, r2) & equivalent(r2, r3))
    told = _abreast(votes).select("document", *(F.col(f"r{v}").isNotNull().alias(f"has{v}") for v in (1, 2, 3)), F.when(odd, F.struct("position", average.alias("similarity"))).alias("odd"))
    out = told.groupBy("document").agg(*(F.count_if(f"has{v}").alias(f"n{v}") for v in (1, 2, 3)), F.array_sort(F.collect_list("odd")).alias("mismatches"))
    out = out.withColumn("mismatches", F.when(F.size("mismatches") > 0, F.col("mismatches")))
    uneven = (F.col("n1") != F.col("n2")) | (F.col("n2") != F.col("n3"))
    error = F.when(uneven, "Mismatch in transaction counts").when(F.col("mismatches").isNotNull(), "Field value mismatch")
    return out.select("document", F.when(error.isNull(), "approved").otherwise("escalated_to_user").alias("status"), error.alias("error"), F.when(~uneven, F.coalesce("mismatches", F.array().cast("array<struct<position:int,similarity:double>>"))).alias("mismatches"))


def count_mismatches(votes: DataFrame) -> DataFrame:
    """Candidates that two voters at least have, with their average similarity."""
    found = _likest(distinct_candidates(votes), votes)
    return found.groupBy("document", "candidate").agg(F.count("*").alias("voters"), F.round(F.avg("score"), 2).alias("similarity")).where("voters >= 2")


def majority(fields: DataFrame, keys: tuple[str, ...] = ("document",)) -> DataFrame:
    """fields: keys, voter, field (a path, for nested ones), value. A row for each field: value, agreed, unanimous.

    A value that two voters share wins, the first seen of several; a single voter's stands.
    """
    counted = fields.groupBy(*keys, "field", "value").agg(F.count("*").alias("n"), F.min("voter").alias("first"))
    held = counted.groupBy(*keys, "field").agg(
        F.min_by(F.struct("value", "n"), F.struct(F.when(F.col("n") >= 2, 0).otherwise(1).alias("a"), F.col("first").alias("b"))).alias("best"), F.count("*").alias("values"), F.sum("n").alias("votes"))
    agreed = (F.col("best.n") >= 2) | (F.col("votes") == 1)
    return held.select(*keys, "field", F.when(agreed, F.col("best.value")).alias("value"), agreed.alias("agreed"), (F.col("values") == 1).alias("unanimous"))


def income_status(reconciled: DataFrame, keys: tuple[str, ...] = ("document",)) -> DataFrame:
    """auto_approved if every field is unanimous, majority_agreed if every one is agreed on, else escalated_to_user."""
    held = reconciled.groupBy(*keys).agg(F.bool_and("unanimous").alias("u"), F.bool_and("agreed").alias("a"), F.count_if(~F.col("unanimous")).alias("discrepancies"))
    return held.select(*keys, F.when(F.col("u"), "auto_approved").when(F.col("a"), "majority_agreed").otherwise("escalated_to_user").alias("status"), "discrepancies")


def local_amount(currency: Column, total: Column, fx: Column) -> Column:
    return F.when(F.upper(F.trim(currency)) == "EUR", total.cast("decimal(20,6)")).when(fx.isNotNull(), (total.cast("decimal(20,6)") * fx.cast("decimal(18,6)")).cast("decimal(20,6)"))


def staged_rows(candidates: DataFrame, verdicts: DataFrame, figi: DataFrame | None = None) -> DataFrame:
    """Candidates as staged rows; those without a local amount are escalated."""
    rows = candidates.join(verdicts.select("document", "status"), "document").select("document", "status", "r.*")
    if figi is not None:
        rows = rows.join(figi.select("isin", F.col("ticker").alias("_t"), F.col("name").alias("_n")), "isin", "left").withColumns({"symbol": F.coalesce("symbol", "_t"), "openfigi_detected": F.col("_n")}).drop("_t", "_n")
    rows = rows.withColumn("local_total_amount", local_amount(F.col("currency"), F.col("total_amount"), F.col("fx_rate")))
    return rows.withColumns({"tax_year": F.year("event_date"), "verification_status": F.when(F.col("local_total_amount").isNull(), "escalated_to_user").otherwise(F.col("status"))}).drop("status")


def same_number(a: Column, b: Column) -> Column:
    """Texts that are the same number, or the same text."""
    x, y = a.try_cast("decimal(30,10)"), b.try_cast("decimal(30,10)")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.eqNullSafe(b))


def differences(votes: DataFrame) -> DataFrame:
    """(document, position, field, voter1, voter2, voter3, differs): voters side by side, a row for each field."""
    told = F.array(*(F.struct(F.lit(c).alias("field"), *(F.col(f"r{v}")[c].cast("string").alias(f"voter{v}") for v in (1, 2, 3))) for c in FIELDS))
    wide = _abreast(votes).select("document", "position", F.explode(told).alias("x")).select("document", "position", "x.*")
    return wide.withColumn("differs", ~(same_number(F.col("voter1"), F.col("voter2")) & same_number(F.col("voter2"), F.col("voter3"))))


def reconciled_by(votes: DataFrame, schema: str, reconcile, keys: list[str]) -> DataFrame:
    """Any reconciler: reconcile(rows of a document as a frame) returns a frame. Documents are small groups."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return reconcile(rows)

    return votes.groupBy(*keys).applyInPandas(run, schema)

