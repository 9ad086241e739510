"""Votes on nested objects: each voter's JSON as VARIANT, taken apart to paths, voted on by path and put together again.

Objects are reconciled field by field, however deep; lists and scalars are values, compared whole (fields of objects inside lists in
any order). A value that two voters at least give wins, the first voter's of several; a single voter's stands. What a voter does not
give is null there. A path that is an object for
one voter and a value, null or nothing for another has no agreement, nor has anything below it. An object comes about only if all of its
document's fields are agreed on.

Documents are groups of few voters, but a payload may have any number of fields: rows are fields from the first step on, dealt out by document
once, and each level of depth is one aggregation where they lie. JSON that cannot be read, or that is no object, is no vote, and is counted as bad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import stored, united


#: Levels that are taken apart at a time, and fields that a task gets on average.
LEVELS, EACH = 4, 100_000


def _members(value: Column) -> Column:
    """The fields of an object as a map, null for all else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // EACH))


def leaves(votes: DataFrame) -> DataFrame:
    """(document, voter, path, value) of votes (document, voter, payload): path an array of names, value JSON text."""
    # Payloads pack well, so files may hold many more than a task should take apart.
    level = votes.repartition(_tasks(votes), "document", "voter").select("document", "voter", F.array().cast("array<string>").alias("path"), F.try_parse_json("payload").alias("value")).where(F.size(_members(F.col("value"))) > 0)
    out = None
    # As many rounds as the deepest payload has levels, by LEVELS.
    while True:
        for _ in range(LEVELS):
            told = level.withColumn("_m", _members(F.col("value")))
            own = F.transform(F.map_entries("_m"), lambda x: F.struct(F.concat("path", F.array(x["key"])).alias("path"), x["value"].alias("value")))
            level = told.select("document", "voter", F.explode(F.when(F.size("_m") > 0, own).otherwise(F.array(F.struct("path", "value")))).alias("_x")).select("document", "voter", "_x.*")
        deeper = F.coalesce(F.size(_members(F.col("value"))) > 0, F.lit(False)).alias("_deeper")
        found = stored(level.select("document", "voter", "path", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"), deeper))
        done, more = found.where("NOT _deeper").drop("_deeper"), found.where("_deeper")
        out = done if out is None else out.transform(united, done)
        if more.isEmpty():
            return out
        level = more.select("document", "voter", "path", F.parse_json("value").alias("value"))


def fields(votes: DataFrame) -> DataFrame:
    """(document, path, value, agreed, unanimous, mixed): what the voters of each document make of each path; value is JSON text, null where there is no agreement."""
    own = leaves(votes).where("document IS NOT NULL")
    tasks = _tasks(own)
    # The voters of a document are those whose payload is an object, also an empty one.
    good = votes.where(F.col("document").isNotNull() & _members(F.try_parse_json("payload")).isNotNull()).select("document", "voter")
    root = good.select("document", "voter", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("value"))
    lines = own.transform(united, root).repartition(tasks, "document")
    counted = lines.groupBy("document", "path", "value").agg(F.count("*").alias("n"), F.min("voter").alias("first"), F.collect_set("voter").alias("who"))
    held = counted.groupBy("document", "path").agg(F.collect_list(F.struct("value", "n", "first")).alias("_values"), F.array_distinct(F.flatten(F.collect_list("who"))).alias("_gave"))
    at_root, document = F.size("path") == 0, Window.partitionBy("document")
    told = held.withColumn("_who", F.array_sort(F.max(F.when(at_root, F.array_sort("_gave"))).over(document))).where(~at_root).withColumn("_voters", F.size("_who"))
    # What a voter does not give counts as null.
    silent = F.array_except("_who", "_gave")
    null = F.filter("_values", lambda x: x["value"] == "null")
    lacking = F.size(silent) + F.when(F.size(null) > 0, F.get(null, F.lit(0))["n"]).otherwise(0)
    first = F.array_min(F.concat(silent, F.transform(null, lambda x: x["first"])))
    kinds = "array<struct<value:string,n:bigint,first:%s>>" % votes.schema["voter"].dataType.simpleString()
    every = F.concat(F.filter("_values", lambda x: x["value"] != "null"), F.when(lacking > 0, F.array(F.struct(F.lit("null").alias("value"), lacking.cast("long").alias("n"), first.alias("first")))).otherwise(F.array().cast(kinds)))
    told = told.withColumn("_every", every)
    winners = F.array_sort(F.transform(F.filter("_every", lambda x: (x["n"] >= 2) | (F.col("_voters") == 1)), lambda x: F.struct(x["first"].alias("first"), x["value"].alias("value"))))
    told = told.withColumns({"_best": F.get(winners, F.lit(0))["value"], "unanimous": F.size("_every") == 1})
    # Paths that lead on for some voters and not for all, and what lies below them; most tables have none.
    heads = lambda first, last: F.transform(F.sequence(first, last), lambda k: F.slice("path", F.lit(1), k))
    passing = F.when(at_root, F.array("path")).when(F.size("path") > 1, heads(F.lit(1), F.size("path") - 1))
    passed = lines.select("document", "voter", F.explode(passing).alias("_inner")).groupBy("document", "_inner").agg(F.size(F.collect_set("voter")).alias("n"))
    passed = passed.withColumn("_voters", F.max(F.when(F.size("_inner") == 0, F.col("n"))).over(document))
    split = stored(passed.where("size(_inner) > 0 AND n < _voters").select("document", "_inner"))
    if split.isEmpty():
        out = told.withColumn("mixed", F.lit(False))
    else:
        below = told.select("document", "path", F.explode(heads(F.lit(1), F.size("path"))).alias("_inner")).join(split, ["document", "_inner"]).select("document", "path").distinct().withColumn("_split", F.lit(True))
        out = told.join(below, ["document", "path"], "left").withColumn("mixed", F.coalesce("_split", F.lit(False)))
    agreed = F.col("_best").isNotNull() & ~F.col("mixed")
    return out.select("document", "path", F.when(agreed, F.col("_best")).alias("value"), agreed.alias("agreed"), (F.col("unanimous") & ~F.col("mixed")).alias("unanimous"), "mixed")


def reconciled(votes: DataFrame) -> DataFrame:
    """(document, payload, status, disagreed, bad) of votes: payload is the object that is agreed on, as JSON text with sorted names, else null.

    status: auto_approved if all voters say the same, majority_agreed if every field is agreed on, else escalated_to_user; failed without any vote.
    """
    told = stored(fields(votes))
    tasks = _tasks(told)
    rows = told.repartition(tasks, "document")
    sums = rows.groupBy("document").agg(F.bool_and("unanimous").alias("_u"), F.bool_and("agreed").alias("_a"), F.count_if(~F.col("agreed")).alias("disagreed"))
    good = _members(F.try_parse_json("payload")).isNotNull()
    documents = votes.select("document", good.alias("_is")).repartition(tasks, "document").groupBy("document").agg(F.count_if(~F.col("_is")).alias("bad"), F.count_if("_is").alias("_good"))
    level = rows.withColumn("_a", F.bool_and("agreed").over(Window.partitionBy("document"))).where("_a").select("document", "path", F.col("value").alias("text"))
    deepest = told.agg(F.max(F.size("path"))).first()[0] or 0
    quoted = F.expr("substring(to_json(array(element_at(path, -1))), 2, length(to_json(array(element_at(path, -1)))) - 2)")
    for depth in range(deepest, 0, -1):
        # Fields of this depth become objects a level up; all else stays as it is.
        here = F.size("path") == depth
        entry = F.when(here, F.struct(F.element_at("path", -1).alias("name"), F.concat(quoted, F.lit(":"), "text").alias("text")))
        level = level.select("document", F.when(here, F.slice("path", 1, depth - 1)).otherwise(F.col("path")).alias("path"), entry.alias("_e"), F.when(~here, F.col("text")).alias("text"))
        level = level.groupBy("document", "path").agg(F.array_sort(F.collect_list("_e")).alias("_e"), F.max("text").alias("text"))
        level = level.select("document", "path", F.coalesce("text", F.concat(F.lit("{"), F.array_join(F.transform("_e", lambda x: x["text"]), ","), F.lit("}"))).alias("text"))
    objects = level.select("document", F.col("text").alias("payload"))
    out = documents.join(sums, "document", "left").join(objects, "document", "left")
    # Voters that all give empty objects agree on that.
    empty = F.col("_a").isNull() & (F.col("_good") > 0)
    status = F.when(F.col("_good") == 0, "failed").when(F.coalesce("_u", F.lit(True)), "auto_approved").when(F.col("_a"), "majority_agreed").otherwise("escalated_to_user")
    return out.select("document", F.when(empty, F.lit("{}")).otherwise(F.col("payload")).alias("payload"), status.alias("status"), F.coalesce("disagreed", F.lit(0)).alias("disagreed"), "bad")
