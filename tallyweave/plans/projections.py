"""The driver's tables as the engine's domain, in Spark and in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A ledger row for each line item. Rows of one part and day are told apart by id, a text of all their numbers.
_LEDGER = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS id,
  CAST(l_shipdate AS TIMESTAMP) AS event_timestamp, {isin} AS isin, concat('P', l_partkey) AS symbol, concat('part ', l_partkey) AS asset_name,
  CASE WHEN l_partkey % 3 = 0 THEN 'etf' ELSE 'stock' END AS asset_type,
  CASE WHEN l_returnflag = 'R' THEN 'sell' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'dividend' ELSE 'buy' END AS action,
  CAST(l_quantity AS DECIMAL(18,6)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price, CAST(round(l_tax * 100) AS DECIMAL(18,2)) AS fees,
  CAST(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(24,6)) AS local_total_amount, CAST(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(24,6)) AS total_amount,
  'EUR' AS currency, CAST(1 AS DECIMAL(18,6)) AS fx_rate, CAST({year} AS INT) AS tax_year, n_name AS account_country, {provider} AS provider
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""

LEDGER_SQL = _LEDGER.format(isin="concat('XX', lpad(CAST(l_partkey AS VARCHAR), 10, '0'))", year="year(l_shipdate)", provider="concat('S', s_nationkey % 2)")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a ledger; suppliers and nations are joined on their keys and, as small as they are, broadcast by the planner."""
    names = ("lineitem", "supplier", "nation")
    sql = _LEDGER.format(isin="concat('XX', lpad(CAST(l_partkey AS STRING), 10, '0'))", year="year(l_shipdate)", provider="concat('S', s_nationkey % 2)")
    for name in names:
        sql = sql.replace(f"FROM {name} ", "FROM {" + name + "} ").replace(f"JOIN {name} ", "JOIN {" + name + "} ")
    rows = spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})
    return rows.withColumn("verification_status", F.lit("approved"))


#: Mergers of parts whose key ends in 50 or 00 into the next one, in the middle of the dates; the ratio is a whole number.
MERGERS_SQL = """SELECT p_partkey AS id, concat('XX', lpad(CAST(p_partkey AS VARCHAR), 10, '0')) AS old_isin, concat('XX', lpad(CAST(p_partkey + 1 AS VARCHAR), 10, '0')) AS new_isin,
  concat('P', p_partkey + 1) AS new_symbol, TIMESTAMP '1998-06-30 00:00:00' AS effective_date, CAST(2 AS DECIMAL(18,6)) AS exchange_ratio FROM part WHERE p_partkey % 50 = 0"""


def mergers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MERGERS_SQL.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


#: Asset classes of parts by the remainder of their key.
CLASSES_SQL = """SELECT concat('XX', lpad(CAST(p_partkey AS VARCHAR), 10, '0')) AS isin, p_name AS asset_name,
  CASE p_partkey % 5 WHEN 0 THEN 'exit_tax' WHEN 1 THEN 'cgt_standard' WHEN 2 THEN 'offshore_distributing' WHEN 3 THEN 'offshore_non_distributing' ELSE 'etc_commodity' END AS tax_regime,
  CASE WHEN p_partkey % 7 = 0 THEN 'IE' ELSE 'LU' END AS domicile_country FROM part"""


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLASSES_SQL.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


#: A profile for each year; what kind of resident changes with it.
PROFILES_SQL = """SELECT CAST(y AS INT) AS tax_year, CASE y % 3 WHEN 0 THEN 'resident_domiciled' WHEN 1 THEN 'resident_non_domiciled' ELSE 'non_resident' END AS residency_type, CAST(0.4 AS DECIMAL(5,4)) AS marginal_tax_rate"""


def profiles(spark: SparkSession) -> DataFrame:
    return spark.range(1990, 2030).selectExpr("id AS y").selectExpr(*PROFILES_SQL.removeprefix("SELECT ").replace("CAST(y AS INT) AS tax_year, ", "CAST(y AS INT) AS tax_year~").replace(" AS residency_type, ", " AS residency_type~").split("~"))


#: Documents as chunks of as many documents as there are sources; ten chunks to a page.
CHUNKS_SQL = """SELECT doc_id AS id, source AS document_name, concat('sha-', source) AS document_sha, CASE WHEN lang = 'en' THEN 'ireland' WHEN lang = 'de' THEN NULL ELSE 'italy' END AS jurisdiction,
  CASE WHEN doc_id % 3 = 0 THEN 'research' ELSE 'regulation' END AS source_type, CAST(doc_id // 10 AS INT) AS page_number, CAST(doc_id AS INT) AS chunk_index, text AS text_content, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS parent_text_content FROM documents"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CHUNKS_SQL.replace("//", "DIV").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
