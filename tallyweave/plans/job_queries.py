"""One-operator jobs over the projected tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fifo, ingestion, mergers, reads, sessions, store, tax, validation
from ..operators.materialize import united
from ..sources import files
from . import projections as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
L = P.LEDGER_SQL


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT isin, tax_regime, domicile_country FROM ({P.CLASSES_SQL})")
def classifications_by_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classifications; one without domicile would fail the read."""
    return reads.classes(P.classifications(spark, sf_dir)).select("isin", "tax_regime", "domicile_country")


@query(f"SELECT isin FROM ({P.CLASSES_SQL}) WHERE tax_regime = 'exit_tax'")
def isins_of_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ISINs of one regime."""
    return reads.isins_of_regime(P.classifications(spark, sf_dir), "exit_tax")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def row_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key."""
    return reads.by_key(P.table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS tax_year FROM orders")
def tax_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years that there are."""
    return reads.tax_years(P.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("tax_year")))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def fresh_income_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are neither staged nor approved."""
    rows = P.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("source_document_sha"))
    return reads.fresh_income(rows, rows.where("c_custkey % 3 = 0"), rows.where("c_custkey % 5 = 0")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 8 = 0")
def fresh_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the manifest does not have as done."""
    rows = P.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("file_sha"))
    manifest = rows.where("c_custkey % 4 = 0").withColumn("status", F.when(F.col("c_custkey") % 8 == 0, "FAILED").otherwise("SUCCESS"))
    return reads.fresh(rows, manifest).select("c_custkey")


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS DECIMAL(20,6)) ELSE CAST(CAST(c_acctbal AS DECIMAL(20,6)) * 2 AS DECIMAL(20,6)) END AS DOUBLE) AS amount FROM customer")
def local_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local amount where it lacks: the total in EUR, else times the rate."""
    k = F.col("c_custkey")
    rows = P.table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, F.lit(1).cast("decimal(20,6)")).alias("local_total_amount"), F.col("c_acctbal").cast("decimal(20,6)").alias("total_amount"), F.when(k % 2 == 0, "eur").otherwise("USD").alias("currency"), F.lit(2).cast("decimal(18,6)").alias("fx_rate"))
    return reads.with_local_amount(rows).select("c_custkey", F.col("local_total_amount").cast("double").alias("amount"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'OWN' WHEN p_partkey % 3 = 0 THEN 'T' || p_partkey END AS symbol, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS detected FROM part")
def figi_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols out of a table by ISIN, where they lack."""
    part = P.table(spark, sf_dir, "part").withColumn("isin", F.concat(F.lit("xx"), F.col("p_partkey")))
    rows = part.select("p_partkey", "isin", F.when(F.col("p_partkey") % 2 == 0, "OWN").alias("symbol"), F.lit(None).cast("string").alias("openfigi_detected"))
    known = part.where("p_partkey % 3 = 0").select("isin", F.concat(F.lit("T"), F.col("p_partkey")).alias("ticker"), F.col("p_name").alias("name"))
    return reads.figi_backfilled(rows, known).select("p_partkey", "symbol", F.col("openfigi_detected").alias("detected"))


@query("SELECT 'XX' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isin FROM part WHERE p_partkey % 4 <> 0")
def isins_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISINs of twelve characters that the mapping has neither as hits nor as misses."""
    isin = F.concat(F.lit("XX"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    part = P.table(spark, sf_dir, "part")
    rows = part.select(F.explode(F.array(isin, F.lower(isin), F.substring(isin, 1, 9))).alias("isin"))
    return files.isins_to_ask(rows, part.where("p_partkey % 4 = 0").select(F.lower(isin).alias("isin")))


@query("SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS left_sum, CAST(sum(CASE WHEN l_suppkey % 10 = 3 THEN 2 * CAST(l_quantity AS DECIMAL(12,2)) END) AS DOUBLE) AS right_sum FROM lineitem WHERE l_suppkey % 10 = 3 GROUP BY l_suppkey")
def conserved_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: keys at which two tables differ in a sum."""
    rows = P.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("decimal(12,2)").alias("q"))
    changed = rows.withColumn("q", F.when(F.col("l_suppkey") % 10 == 3, F.col("q") * 2).otherwise(F.col("q")).cast("decimal(14,2)"))
    return validation.conserved(rows, changed, ["l_suppkey"], "q").select(F.col("l_suppkey").cast("long").alias("l_suppkey"), F.col("left_sum").cast("double").alias("left_sum"), F.col("right_sum").cast("double").alias("right_sum"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 AND lang = 'de' THEN 1 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS errors FROM documents")
def chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of no known type, regulations of no jurisdiction, negative numbers."""
    k = F.col("doc_id")
    rows = P.table(spark, sf_dir, "documents").select("doc_id", F.when(k % 7 == 0, "novel").when(k % 2 == 0, "regulation").otherwise("research").alias("source_type"), F.when(F.col("lang") != "de", "ireland").alias("jurisdiction"), F.when(k % 11 == 0, -1).otherwise(3).alias("chunk_index"))
    return rows.select("doc_id", F.size(validation.chunk_errors()).alias("errors"))


@query(f"SELECT id, CASE WHEN action = 'dividend' THEN NULL ELSE CAST(quantity AS DOUBLE) END AS quantity FROM ({L})")
def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: strict rows as ledger rows; a dividend carries no quantity."""
    return validation.to_raw(P.ledger(spark, sf_dir)).select("id", F.col("quantity").cast("double").alias("quantity"))


@query("SELECT o_custkey AS record, CAST(sum(CAST(o_totalprice AS DECIMAL(20,6))) AS DOUBLE) AS remitted FROM orders WHERE year(o_orderdate) = 1996 GROUP BY o_custkey")
def remitted_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was remitted in a year for each record."""
    rows = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("financial_record_id"), F.col("o_orderdate").alias("remittance_date"), F.col("o_totalprice").cast("decimal(20,6)").alias("amount_eur"))
    return tax.remitted(rows, 1996).select(F.col("financial_record_id").alias("record"), F.col("remitted_eur").cast("double").alias("remitted"))


@query("SELECT CAST(sum(g) AS DOUBLE) AS total_gain, CAST(sum(CAST(g * 0.41 AS DECIMAL(28,6))) AS DOUBLE) AS total_tax FROM (SELECT CAST(l_quantity AS DECIMAL(20,6)) AS g FROM lineitem)")
def deemed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains and tax of deemed disposals, added up."""
    gain = F.col("l_quantity").cast("decimal(20,6)")
    rows = P.table(spark, sf_dir, "lineitem").select(gain.alias("deemed_gain"), (gain * F.lit("0.41").cast("decimal(5,4)")).cast("decimal(28,6)").alias("tax_due"))
    return tax.deemed_totals(rows).select(F.col("total_gain").cast("double").alias("total_gain"), F.col("total_tax").cast("double").alias("total_tax"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59 seconds' AS sold_at FROM orders")
def simulated_disposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked about is sold at the end of its day."""
    return tax.simulated(P.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("sold_at"))).select("o_orderkey", "sold_at")


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1.5 WHEN p_partkey % 3 = 1 THEN round_even(CAST(p_retailprice AS DOUBLE) / (p_size + 1), 6) ELSE round_even(p_size / 8.0, 6) END AS DOUBLE) AS ratio FROM part")
def merger_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: a given ratio, else that of the prices, else that of what was received."""
    k, kind = F.col("p_partkey") % 3, "decimal(18,6)"
    ratio = mergers.ratio_of(F.when(k == 0, 1.5), F.when(k == 1, F.col("p_retailprice")).cast(kind), F.when(k == 1, F.col("p_size") + 1).cast(kind), F.col("p_size"), F.lit(None).cast(kind), F.lit(8).cast(kind))
    return P.table(spark, sf_dir, "part").select("p_partkey", ratio.cast("double").alias("ratio"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderpriority = '1-URGENT' THEN 'rejected' ELSE 'pending_approval' END AS status FROM orders) GROUP BY status")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as promoted rows, urgent ones rejected unless they have been promoted."""
    orders, done = P.table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F"
    rows = orders.select(F.col("o_orderkey").alias("id"), F.when(done, F.col("o_orderkey")).alias("approved_financial_record_id"), F.when(done, "approved").otherwise("pending_approval").alias("verification_status"))
    ids = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return store.rejected(rows, ids).groupBy(F.col("verification_status").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN (SELECT max(event_id) FROM events WHERE event_type = 'view') + event_id + 1 END AS approved_id FROM events")
def income_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events but for errors have their props as payload and move over, with a link; errors stay."""
    events = P.table(spark, sf_dir, "events")
    staged = events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("props")).alias("payload_json"), F.lit(None).cast("long").alias("approved_tax_income_record_id"), F.lit("auto_approved").alias("verification_status"))
    approved = events.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("props").alias("payload_json"))
    return store.promoted_income(staged, approved)[1].select("id", F.col("approved_tax_income_record_id").alias("approved_id"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'approved' WHEN event_type = 'error' THEN 'needs data' WHEN value < 5 THEN 'unanimous' WHEN value < 10 THEN 'majority' ELSE 'needs review' END AS label FROM events")
def income_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an event is shown as, by its type, value and props."""
    status = F.when(F.col("value") < 5, "auto_approved").when(F.col("value") < 10, "majority_agreed").otherwise("escalated_to_user")
    promoted, payload = F.when(F.col("event_type") == "purchase", F.col("event_id")), F.when(F.col("event_type") != "error", F.col("props"))
    return P.table(spark, sf_dir, "events").select("event_id", ingestion.income_label(status, promoted, payload).alias("label"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice < 100000 AND o_orderstatus <> 'F'")
def unpromoted_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a small sum as those that all agree on, and that are not finished yet."""
    status = F.when(F.col("o_totalprice") < 100000, "auto_approved").otherwise("majority_agreed")
    rows = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("verification_status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("approved_tax_income_record_id"))
    return ingestion.unpromoted(rows).select("id")


@query("SELECT c_custkey, 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'balance', CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE c_name END FROM customer")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field set and another replaced on each customer's form, but not where the user has overridden it; a row for each field."""
    name = lambda c, status: F.create_map(F.lit("balance"), F.struct(F.col(c).alias("value"), F.lit("text").alias("value_type"), F.lit(status).alias("status")))
    rows = P.table(spark, sf_dir, "customer").withColumn("held", F.when(F.col("c_mktsegment") == "BUILDING", name("c_mktsegment", "user_override")).otherwise(name("c_mktsegment", "computed_via_tool")))
    for field, column in (("balance", "c_name"), ("segment", "c_mktsegment")):
        rows = rows.withColumn("held", store.field_set(F.col("held"), field, F.col(column), "text", "computed_via_rag"))
    return store.form_rows(rows.select("c_custkey", F.col("held").alias("income")), ("income",), "c_custkey").select("c_custkey", "field", "value")


@query(r"""SELECT page_id, 'file' AS kind, regexp_replace(url, '[\\\\/*?:"<>| ]', '_', 'g') AS name FROM pages
UNION ALL SELECT n_nationkey, 'country', CASE lower(trim(n_name)) WHEN 'italia' THEN 'italy' WHEN 'eire' THEN 'ireland' ELSE lower(trim(n_name)) END FROM nation""".replace("\\\\", "\\"))
def named_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as names of files, and nations, in one spelling."""
    pages = P.table(spark, sf_dir, "pages").select("page_id", F.lit("file").alias("kind"), X.file_key(F.col("url")).alias("name"))
    nations = P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.lit("country").alias("kind"), X.jurisdiction(F.col("n_name")).alias("name"))
    return pages.transform(united, nations)


@query("SELECT event_id, props AS told, '[' || event_id || ', ' || value || ']' AS listed FROM events")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of events, out of answers that think about it, fence it and talk of it."""
    said = F.concat(F.lit("<think>{"), F.col("event_type"), F.lit("}</think>Here:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    listed = F.concat(F.lit("so ["), F.col("event_id"), F.lit(", "), F.col("value"), F.lit("] it is, for a "), F.col("event_type"))
    return P.table(spark, sf_dir, "events").select("event_id", X.json_object(said).alias("told"), X.json_array(listed).alias("listed"))


@query(r"""SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN len(w) > 1 AND regexp_matches(w, '^[^a-z]*[A-Z][^a-z]*$') THEN upper(w[1]) || lower(w[2:]) ELSE w END), ' ') AS calm FROM documents""")
def calmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words all in capitals, in whole documents, keep their first one."""
    return P.table(spark, sf_dir, "documents").select("doc_id", X.calmed(F.col("text")).alias("calm"))


@query("SELECT c_custkey, p AS page, c_custkey || ' on ' || p AS text FROM customer, (SELECT unnest([1, 2, 3]) AS p)")
def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of OCR output, by whichever page break it has."""
    k = F.col("c_custkey").cast("string")
    joint = F.when(F.col("c_custkey") % 3 == 0, F.lit("\n{1}------------\n")).when(F.col("c_custkey") % 3 == 1, F.lit("\f")).otherwise(F.lit("\n\n---\n\n"))
    whole = F.concat(k, F.lit(" on 1"), joint, k, F.lit(" on 2 "), joint, F.lit(" "), k, F.lit(" on 3"))
    rows = P.table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(X.ocr_pages(X.ocr_markdown(whole))).alias("p", "text"))
    return rows.select("c_custkey", (F.col("p") + 1).alias("page"), "text")


@query("SELECT conv_id, turn, CAST(len(text) AS BIGINT) AS input_tokens, CASE WHEN role = 'assistant' THEN CAST(len(role) AS BIGINT) ELSE 0 END AS output_tokens, CASE WHEN role = 'system' THEN 7 ELSE CAST(len(text) AS BIGINT) + CASE WHEN role = 'assistant' THEN CAST(len(role) AS BIGINT) ELSE 0 END END AS total_tokens FROM conversations")
def token_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The use of tokens, told as JSON of each turn's lengths; totals filled from their parts where they lack."""
    usage = F.to_json(F.struct(F.length("text").alias("input_tokens"), F.when(F.col("role") == "assistant", F.length("role")).alias("output_tokens"), F.when(F.col("role") == "system", 7).alias("total_tokens")))
    return sessions.usage(P.table(spark, sf_dir, "conversations").select("conv_id", "turn", usage.alias("usage"))).drop("usage")


@query(f"WITH l AS ({L}), e AS (SELECT isin, id, event_timestamp AS t, action, quantity AS q, sum(CASE WHEN action = 'buy' THEN quantity ELSE 0 END) OVER w AS bought, sum(CASE WHEN action = 'sell' THEN quantity ELSE 0 END) OVER w AS sold FROM l WHERE action <> 'dividend' WINDOW w AS (PARTITION BY isin ORDER BY event_timestamp, id)) SELECT id, CAST(bought AS DOUBLE) AS bought, CAST(sold AS DOUBLE) AS sold FROM e")
def running_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: what was bought and sold of an asset up to each event."""
    side = F.when(F.col("action") == "buy", F.col("quantity")).otherwise(0), F.when(F.col("action") == "sell", F.col("quantity")).otherwise(0)
    rows = P.ledger(spark, sf_dir).where("action <> 'dividend'").select("isin", "id", "event_timestamp", side[0].alias("_b"), side[1].alias("_s"))
    return fifo.running(rows, ["isin"], "event_timestamp", ["id"], {"_b": "bought", "_s": "sold"}).select("id", F.col("bought").cast("double").alias("bought"), F.col("sold").cast("double").alias("sold"))


@query("SELECT c_custkey AS id, CAST(1990 + c_nationkey AS INT) AS tax_year, c_mktsegment AS income_type, c_name AS employer_name, CAST(CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS DOUBLE) AS gross_pay FROM customer WHERE 1990 + c_nationkey >= 2000")
def income_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' segment, name and balance as income with a JSON payload, read by jurisdiction with the payload's schema."""
    payload = F.to_json(F.struct(F.col("c_mktsegment").alias("income_type"), F.col("c_name").alias("employer_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("gross_pay_eur")))
    rows = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (1990 + F.col("c_nationkey")).cast("int").alias("tax_year"), F.when(F.col("c_nationkey") >= 10, "ireland").otherwise("italy").alias("jurisdiction"), payload.alias("payload_json"))
    found = reads.income(rows, jurisdiction="ireland")
    return found.select("id", "tax_year", F.col("payload.income_type").alias("income_type"), F.col("payload.employer_name").alias("employer_name"), F.col("payload.gross_pay_eur").cast("double").alias("gross_pay"))
