"""A union of tables that are dealt by different keys, under an aggregation and a join."""

from pyspark.sql import functions as F

from tallyweave.operators.materialize import united


def parts(spark):
    rows = spark.range(0, 40_000).selectExpr("CAST(id % 997 AS INT) AS k", "CAST(id % 13 AS INT) AS p", "1 AS q").repartition(6)
    by_key = rows.groupBy("k").agg(F.sum("q").alias("q")).withColumn("p", F.lit(-1)).select("k", "p", "q")
    by_both = rows.groupBy("k", "p").agg(F.sum("q").alias("q")).select("k", "p", "q")
    return rows, by_key, by_both


def test_sums_over_a_union(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, by_key, by_both = parts(spark)
        for first, second in ((by_key, by_both), (by_both, by_key)):
            sums = first.transform(united, second).groupBy("k").agg(F.sum("q").alias("x"))
            both = sums.join(rows.groupBy("k").agg(F.sum("q").alias("y")), "k")
            assert sums.count() == 997 and both.where("x <> 2 * y").count() == 0 and both.count() == 997
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
