"""Document, vector, session and consensus queries over the projected tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arithmetic import arithmetic
from ..operators import chunking, consensus, interactions, masking, nested_votes, portfolio, reads, retrieval, sessions, store, text_index
from ..operators.materialize import new_folder
from ..streaming.ingest import event_windows as windows
from . import projections as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
C = P.CHUNKS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT id, document_name FROM ({C}) WHERE source_type = 'regulation' AND jurisdiction = 'ireland' AND (contains(lower(text_content), 'the and') OR contains(lower(text_content), 'and of') OR contains(lower(text_content), 'the and of')) ORDER BY id LIMIT 50")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3: chunks that hold a run of the query's words."""
    return retrieval.keyword_search(P.chunks(spark, sf_dir), "The and of", 50, "IE", "regulation").select("id", "document_name")


_QUERY = [((k * 37) % 64 - 31.5) / 64 for k in range(64)]


@query(f"SELECT vec_id FROM embeddings WHERE label % 2 = 0 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_QUERY}::DOUBLE[]), vec_id LIMIT 20")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors among those of even label: filtered first, so none is missed."""
    rows = P.table(spark, sf_dir, "embeddings").where("label % 2 = 0")
    return retrieval.knn(rows, _QUERY, 20, id_column="vec_id").select("vec_id")


@query("""SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), e.vec_id) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5""")
def nearest_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 for every row whose id is divisible by 20."""
    rows = P.table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.knn_join(rows, queries, 5, id_column="vec_id").select("query_id", "vec_id", "rank")


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunks(spark, sf_dir).join(P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


_NEAR = "list_distance(CAST(embedding AS DOUBLE[]), {}::DOUBLE[])"


#: Words of chunks as the index has them, and BM25 for a table q of (query_id, word), in SQL.
def _words_of(text: str) -> str:
    return f"list_filter(list_transform(string_split(lower(coalesce({text}, '')), ' '), lambda w: regexp_replace(w, '" + r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$" + "', '', 'g')), lambda w: w <> '')"


_BM25 = f"""t AS (SELECT id, {_words_of('text_content')} AS ws FROM ({C})), tf AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(ws) AS word FROM t) GROUP BY id, word),
df AS (SELECT word, ln(1 + ((SELECT count(*) FROM t) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY word),
b AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / (SELECT avg(len(ws)) FROM t)))), 9) AS score FROM q JOIN df USING (word) JOIN tf USING (word) JOIN t USING (id) GROUP BY query_id, id)"""


def _indexed(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    return text_index.build(P.chunks(spark, sf_dir), new_folder(spark, "texts"))


def _asked(spark: SparkSession, sf_dir: str, words: int) -> DataFrame:
    """The first words of every twentieth document as a table of queries."""
    head = F.slice(F.split(F.lower("text"), " "), 1, words)
    return P.table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(head, " ").alias("query"), F.size(head).alias("n"))


@query("""WITH p AS (SELECT doc_id AS query_id, array_to_string(string_split(lower(text), ' ')[:3], ' ') AS phrase FROM documents WHERE doc_id % 20 = 0 AND len(string_split(text, ' ')) >= 3)
SELECT query_id, doc_id AS id FROM p JOIN documents ON contains(lower(text), phrase) WHERE NOT contains(phrase, '  ')""")
def phrases_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold the first three words of every twentieth one, by the index."""
    asked = _asked(spark, sf_dir, 3).where("n = 3").select("query_id", F.col("query").alias("phrase"))
    return text_index.phrase_hits(_indexed(spark, sf_dir), asked).join(asked, "phrase").select("query_id", "id")


@query(f"""WITH q AS (SELECT DISTINCT query_id, word FROM (SELECT doc_id AS query_id, unnest({_words_of("array_to_string(string_split(lower(text), ' ')[:8], ' ')")}) AS word FROM documents WHERE doc_id % 20 = 0)), {_BM25}
SELECT query_id, id, CAST(rank AS INT) AS rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 10""")
def ranked_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents with the highest BM25 for the first eight words of every twentieth one."""
    found = text_index.bm25(_indexed(spark, sf_dir), _asked(spark, sf_dir, 8), 10)
    return found.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("rank"))


@query(f"""WITH c AS (SELECT k.*, embedding FROM ({C}) k JOIN embeddings ON id = vec_id), n AS (SELECT id FROM c ORDER BY {_NEAR.format(_QUERY)}, id LIMIT 200),
s AS (SELECT id FROM c WHERE contains(lower(text_content), 'the and') OR contains(lower(text_content), 'and of') OR contains(lower(text_content), 'of with') ORDER BY id LIMIT 50),
q AS (SELECT 0 AS query_id, unnest(['the', 'and', 'of', 'with']) AS word), {_BM25}
SELECT id, coalesce(score, 0) AS rerank_score FROM c LEFT JOIN b USING (id) WHERE id IN (SELECT id FROM n UNION SELECT id FROM s) ORDER BY rerank_score DESC, id LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest and keyword candidates, each once, the best by BM25 over all chunks."""
    return retrieval.hybrid(_embedded(spark, sf_dir), "the and of with", _QUERY, 10, index=_indexed(spark, sf_dir)).select("id", "rerank_score")


@query(f"""WITH a AS (SELECT vec_id AS id, {_NEAR.format(_QUERY)} AS d FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY d, id LIMIT 15), b AS (SELECT vec_id AS id, {_NEAR.format(_QUERY[::-1])} AS d FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY d, id LIMIT 15)
SELECT id, phrase FROM (SELECT id, d, 'a' AS phrase FROM a UNION ALL SELECT id, d, 'b' FROM b WHERE id NOT IN (SELECT id FROM a)) ORDER BY d, id LIMIT 15""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several phrases at once, each chunk as the first found it."""
    return retrieval.evidence(_embedded(spark, sf_dir), [("a", _QUERY), ("b", _QUERY[::-1])], 15).select("id", "phrase")


@query("SELECT a.conv_id AS conv_id, a.turn AS of_turn, b.turn AS turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, J14, W: the window of every turn."""
    rows = P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_name"), F.col("turn").alias("chunk_index"), "role")
    found = retrieval.neighbours(rows, rows, 1)
    return found.select(F.col("document_name").alias("conv_id"), F.col("of_index").alias("of_turn"), F.col("chunk_index").alias("turn"), "role")


@query(f"""SELECT lower(document_name) AS document, jurisdiction, page_number, sha256(string_agg(text_content, chr(10) || chr(10) ORDER BY chunk_index)) AS sha, count(*) AS chunks, page_number > any_value(first) AS has_previous, page_number < any_value(last) AS has_next
FROM (SELECT *, min(page_number) OVER (PARTITION BY lower(document_name)) AS first, max(page_number) OVER (PARTITION BY lower(document_name)) AS last FROM ({C})) GROUP BY 1, 2, 3""")
def page_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every document from its chunks."""
    return retrieval.pages(P.chunks(spark, sf_dir)).select("document", "jurisdiction", "page_number", X.text_sha(F.col("text")).alias("sha"), "chunks", "has_previous", "has_next")


@query(f"SELECT document_sha, document_name, jurisdiction, source_type, count(*) AS chunks FROM ({C}) GROUP BY ALL")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: chunks of each document."""
    return retrieval.document_summary(P.chunks(spark, sf_dir))


@query(f"SELECT document_name, jurisdiction, source_type, count(*) AS chunks, min(page_number) || '-' || max(page_number) AS page_range FROM ({C}) GROUP BY ALL")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: chunks and pages of each document."""
    return retrieval.document_metadata(P.chunks(spark, sf_dir)).select("document_name", "jurisdiction", "source_type", "chunks", "page_range")


@query(f"SELECT document_sha, document_name, count(*) AS chunks, min(page_number) AS start_page, max(page_number) AS end_page, max(page_number) - min(page_number) + 1 AS total_pages FROM ({C}) GROUP BY 1, 2")
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: page spans."""
    return retrieval.document_statistics(P.chunks(spark, sf_dir))


@query("SELECT doc_id, abs(CASE WHEN u > 9223372036854775807 THEN CAST(u - 18446744073709551616 AS BIGINT) ELSE CAST(u AS BIGINT) END) AS chunk_id FROM (SELECT doc_id, CAST(CAST('0x' || substr(sha256(source || '_' || doc_id), 1, 16) AS UBIGINT) AS HUGEINT) AS u FROM documents)")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids out of a hash."""
    return P.table(spark, sf_dir, "documents").select("doc_id", retrieval.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(len(coalesce(text, '')) // 4) OVER (w ROWS UNBOUNDED PRECEDING) AS spent FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE n = 1 OR (n <= 3 AND spent <= 200)""")
def history_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest turns within a budget."""
    return sessions.compacted(P.table(spark, sf_dir, "conversations"), most_tokens=200, most_turns=3).select("conv_id", "turn")


@query("SELECT conv_id, count(*) AS messages, sha256(string_agg(upper(role[1]) || lower(role[2:]) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as text."""
    return sessions.transcripts(P.table(spark, sf_dir, "conversations")).select("conv_id", "messages", X.text_sha(F.col("transcript")).alias("sha"))


@query("SELECT CAST(sum(len(text)) AS BIGINT) AS characters, sum(len(text)) > 1000 AS over FROM documents")
def context_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters against a threshold."""
    return sessions.context_size(P.table(spark, sf_dir, "documents"), 1000)


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS sha, translate(html[:120], chr(10), ' ') AS preview FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages without tags, its hash, a preview."""
    return P.table(spark, sf_dir, "pages").select("page_id", X.text_sha(X.without_tags(F.col("html"))).alias("sha"), X.preview(F.col("html")).alias("preview"))


@query("SELECT s_suppkey, regexp_replace(regexp_replace(upper(trim(s_name || ' s.p.a. ltd')), '\\b(S\\.?P\\.?A\\.?|LTD|INC|CORP|CO|LIMITED)\\b', '', 'g'), '[^A-Z0-9]', '', 'g') AS key FROM supplier")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without legal suffixes."""
    return P.table(spark, sf_dir, "supplier").select("s_suppkey", X.company_key(F.concat("s_name", F.lit(" s.p.a. ltd"))).alias("key"))


@query("SELECT p_partkey, CAST(p_size * 3 - 2 AS VARCHAR) AS value FROM part")
def calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic in text."""
    return P.table(spark, sf_dir, "part").select("p_partkey", arithmetic(F.concat(F.col("p_size").cast("string"), F.lit(" * 3 - 4 / 2"))).alias("value"))


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of JSON columns."""
    rows = P.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("p.k").alias("total"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows, the same for a stream."""
    return windows(P.table(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "events", F.col("total").cast("double").alias("total"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of each user's events: the second misreads every seventh, the third misses every fiftieth."""
    rows = P.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("voter"), F.col("ts").alias("event_date"), F.lit("stock").alias("asset_type"), F.format_string("E%012d", "event_id").alias("symbol"),
        F.lit(None).cast("string").alias("isin"), F.col("event_type").alias("action"), F.lit(1).cast("decimal(20,6)").alias("quantity"), F.lit(None).cast("decimal(20,6)").alias("unit_price"), F.lit("EUR").alias("currency"), F.lit(0).cast("decimal(20,6)").alias("fees"),
        F.col("value").cast("decimal(20,6)").alias("total_amount"), F.lit(1).cast("decimal(20,6)").alias("fx_rate"), F.lit(None).cast("string").alias("asset_name"), F.lit("broker").alias("provider"), "event_id",
    )
    amount = F.when((F.col("voter") == 2) & (F.col("event_id") % 700 == 0), F.col("total_amount") + 1).otherwise(F.col("total_amount")).cast("decimal(20,6)")
    return rows.withColumn("total_amount", amount).where("NOT (voter = 3 AND event_id % 500 = 7)").drop("event_id")


@query("""SELECT user_id AS document, CASE WHEN missing + misread > 0 THEN 'escalated_to_user' ELSE 'approved' END AS status, CASE WHEN missing > 0 THEN 'Mismatch in transaction counts' WHEN misread > 0 THEN 'Field value mismatch' END AS error
FROM (SELECT user_id, count(*) FILTER (event_id % 500 = 7) AS missing, count(*) FILTER (event_id % 700 = 0) AS misread FROM events GROUP BY user_id)""")
def consensus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings agree row by row or are escalated."""
    return consensus.verified(consensus.dealt(_votes(spark, sf_dir))).select("document", "status", "error")


_LIKE = """CASE WHEN date_trunc('hour', a.ts) = date_trunc('hour', b.ts) THEN 25 WHEN CAST(a.ts AS DATE) = CAST(b.ts AS DATE) THEN 20 WHEN abs(date_diff('second', date_trunc('second', a.ts), date_trunc('second', b.ts))) <= 172800 THEN 3 ELSE 0 END
  + CASE WHEN a.event_type = b.event_type THEN 10 ELSE 0 END + 10 + CASE WHEN a.event_id = b.event_id THEN 25 ELSE 0 END + 15
  + CASE WHEN abs(a.amount - b.amount) < 0.01 THEN 15 WHEN a.amount > 0 AND abs(a.amount - b.amount) * 20 <= a.amount THEN 10 ELSE 0 END"""


@query(f"""WITH v AS (SELECT user_id AS document, voter, ts, event_id, event_type, CAST(CASE WHEN voter = 2 AND event_id % 700 = 0 THEN value + 1 ELSE value END AS DECIMAL(20,6)) AS amount,
  row_number() OVER (PARTITION BY user_id, voter ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id) AS position FROM events, (SELECT unnest([1, 2, 3]) AS voter) WHERE NOT (voter = 3 AND event_id % 500 = 7) AND user_id IN (SELECT user_id FROM events WHERE event_id % 500 = 7)),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY document, date_trunc('hour', ts), event_type, event_id, amount ORDER BY voter, position) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY voter, position) - 1 AS candidate FROM f),
s AS (SELECT b.document, b.candidate, a.voter, a.position, ({_LIKE}) / 100.0 AS score FROM c b JOIN v a ON a.document = b.document),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY document, candidate, voter ORDER BY score DESC, position) = 1)
SELECT document, CAST(candidate AS INT) AS candidate, count(*) AS voters, round(avg(CAST(score AS DOUBLE)), 2) AS similarity FROM best WHERE score >= 0.40 GROUP BY document, candidate HAVING count(*) >= 2""")
def consensus_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of uneven readings and their likeness to each reading."""
    votes = consensus.dealt(_votes(spark, sf_dir))
    uneven = consensus.verified(votes).where("error = 'Mismatch in transaction counts'").select("document")
    return consensus.count_mismatches(votes.join(uneven, "document", "left_semi"))


@query("""SELECT user_id AS document, CAST(n - 1 AS INT) AS position, 'total_amount' AS field FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id) AS n FROM events) WHERE event_id % 700 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 500 = 7)""")
def voter_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings side by side where they differ."""
    votes = consensus.dealt(_votes(spark, sf_dir))
    even = consensus.verified(votes).where("error IS NULL OR error = 'Field value mismatch'").select("document")
    return consensus.differences(votes).where("differs").join(even, "document", "left_semi").select("document", "position", "field")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    readings = F.array(F.struct(F.lit(1).alias("voter"), kind.alias("value")), F.struct(F.lit(2).alias("voter"), F.when(n % 3 == 0, "x").otherwise(kind).alias("value")), F.struct(F.lit(3).alias("voter"), F.when(n % 5 == 0, "y").otherwise(kind).alias("value")))
    return P.table(spark, sf_dir, "events").select(n.alias("document"), F.lit("kind").alias("field"), F.explode(readings).alias("r")).select("document", "field", "r.*")


@query("SELECT event_id AS document, CASE WHEN event_id % 15 = 0 THEN NULL ELSE event_type END AS value, event_id % 15 <> 0 AS agreed, event_id % 3 <> 0 AND event_id % 5 <> 0 AS unanimous FROM events")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two of three readings say."""
    return consensus.majority(_fields(spark, sf_dir)).select("document", "value", "agreed", "unanimous")


@query("SELECT CASE WHEN event_id % 15 = 0 THEN 'escalated_to_user' WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'majority_agreed' ELSE 'auto_approved' END AS status, count(*) AS documents FROM events GROUP BY 1")
def income_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a reconciled record is."""
    return consensus.income_status(consensus.majority(_fields(spark, sf_dir))).groupBy("status").agg(F.count("*").alias("documents"))


@query("SELECT count(*) AS n, min(id) AS first, max(id) AS last, count(DISTINCT id) AS ids FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER () FROM customer)")
def appended_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: new rows get the ids after the last."""
    old = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    out = store.appended(old, P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    return out.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("id").alias("ids"))


@query(f"SELECT lower(concat_ws('|', isin, provider, account_country)) AS key, l.id FROM ({P.LEDGER_SQL}) l")
def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R18 for every position."""
    rows = P.ledger(spark, sf_dir)
    return portfolio.drill_down(portfolio.identities(rows), rows).select("key", "id")


@query()
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with placeholders in place of personal data, and how many each has."""
    found = masking.masked(P.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", X.text_sha(F.col("masked.text")).alias("sha"), F.size("masked.placeholders").alias("placeholders"), masking.leftovers(F.col("masked.text")).alias("left"))


@query()
def late_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences to children, parents and windows."""
    docs = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_sha"), "text")
    return chunking.late_chunks(docs).select("document_sha", "chunk_index", "start", "stop", "window", F.length("parent_text_content").alias("parent_characters"))


@query(f"SELECT document_name, CAST((n - 1) // 5 AS INT) AS batch, sha256(string_agg(text_content, chr(10) || chr(10) ORDER BY chunk_index)) AS sha, count(*) AS pages FROM (SELECT *, row_number() OVER (PARTITION BY document_name ORDER BY chunk_index) AS n FROM ({C})) GROUP BY 1, 2")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined in fives, with where each lies."""
    rows = P.chunks(spark, sf_dir).select("document_name", F.col("chunk_index").alias("page_number"), F.col("text_content").alias("text"))
    return chunking.page_batches(rows, "document_name").select("document_name", "batch", X.text_sha(F.col("text")).alias("sha"), F.size("ranges").cast("long").alias("pages"))


@query(f"SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: x IN {X.ITALIAN})) > len(list_filter(w, lambda x: x IN {X.ENGLISH})) THEN 'it' ELSE 'en' END AS language FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents)")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: a language by its frequent words."""
    return P.table(spark, sf_dir, "documents").select("doc_id", X.language(F.col("text")).alias("language"))


_URL_NODES = r"""u AS (SELECT DISTINCT list_filter(string_split(regexp_extract(url, '^https?://([^?#]+)', 1), '/'), lambda x: x <> '') AS ps FROM pages),
v AS (SELECT ps, {last} AS deepest FROM u WHERE len(list_filter(ps, lambda x: starts_with(x, '.'))) = 0),
n AS (SELECT ps[:d] AS own, d, d = len(ps) AS is_file FROM (SELECT ps, unnest(range(1, deepest + 1)) AS d FROM v WHERE deepest > 0))
SELECT array_to_string(own, '/') AS path, CAST(d AS INT) AS depth, CASE WHEN is_file THEN 'file' ELSE 'dir' END AS kind, CASE WHEN NOT is_file THEN count(*) END AS files FROM n GROUP BY own, d, is_file"""


def _url_tree(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    paths = P.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^?#]+)", 1).alias("path"))
    return reads.tree(paths, name).select("path", "depth", "kind", "files")


@query("WITH " + _URL_NODES.format(last="len(ps)"))
def url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and paths of all pages as folders and files, with how many files each folder has below it."""
    return _url_tree(spark, sf_dir)


@query("WITH " + _URL_NODES.format(last="coalesce(list_max(list_transform(range(1, len(ps) + 1), lambda k: CASE WHEN contains(lower(ps[k]), '25') THEN k ELSE 0 END)), 0)"))
def url_tree_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has 25 in its name, and the folders that it is in."""
    return _url_tree(spark, sf_dir, "25")


@query("""WITH r AS (SELECT conv_id, turn, role, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 90 + turn * (1 + conv_id % 40) AS BIGINT)) AS t FROM conversations)
SELECT a.conv_id || '-' || a.turn AS request_id, CASE WHEN b.conv_id IS NULL THEN 'UNANSWERED' ELSE 'COMPLETED' END AS status, CAST(date_diff('second', a.t, b.t) AS DOUBLE) AS seconds
FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' AND b.t >= a.t AND b.t <= a.t + INTERVAL 20 MINUTE WHERE a.role = 'user'""")
def requests_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users said and what was answered within twenty minutes, as a log that comes in two parts and is followed as a stream; turns take as many minutes as the conversation's number says."""
    rows = P.table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    user = F.col("role") == "user"
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + (F.col("conv_id") * 90 + F.col("turn") * (1 + F.col("conv_id") % 40)) * 60)
    log = rows.select(F.concat_ws("-", "conv_id", F.when(user, F.col("turn")).otherwise(F.col("turn") - 1)).alias("request_id"), F.when(user, "request").otherwise("response_completed").alias("kind"), at.alias("at"), "text")
    folder = new_folder(spark, "log")
    end = log.agg(F.max("at").alias("at")).select(F.explode(F.array(F.lit("request"), F.lit("response_completed"))).alias("kind"), F.expr("at + INTERVAL 9 DAYS").alias("at"))
    clock = lambda days: end.select(F.lit("clock").alias("request_id"), "kind", F.expr(f"at + INTERVAL {days} DAYS").alias("at"), F.lit("").alias("text"))
    middle = log.agg(F.expr("percentile_approx(unix_seconds(at), 0.5)")).first()[0] or 0
    for part in (log.where(F.unix_seconds("at") <= middle), log.where(F.unix_seconds("at") > middle), clock(0), clock(9)):
        part.write.mode("append").parquet(f"{folder}/in")
        found = interactions.paired(spark.readStream.schema(log.schema).parquet(f"{folder}/in"), "20 minutes", "1 day")
        found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("request_id <> 'clock'").select("request_id", "status", "seconds")


_NESTED = """v AS (SELECT event_id // 3 AS document, event_id % 3 + 1 AS voter, event_type, props, value FROM events),
f AS (SELECT document, voter, 'who.type' AS path, '"' || event_type || '"' AS value FROM v UNION ALL SELECT document, voter, 'who.props.k', CAST(json_extract(props, '$.k') AS VARCHAR) FROM v UNION ALL SELECT document, voter, 'large', CASE WHEN value > 10 THEN 'true' ELSE 'false' END FROM v),
n AS (SELECT document, count(DISTINCT voter) AS voters FROM v GROUP BY document), c AS (SELECT document, path, value, count(*) AS n, min(voter) AS first FROM f GROUP BY document, path, value),
b AS (SELECT document, path, arg_min(value, first) FILTER (n >= 2 OR voters = 1) AS value, count(*) = 1 AS unanimous FROM c JOIN n USING (document) GROUP BY document, path)"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events that follow each other as three readings of one document, the objects in them two deep."""
    who = F.struct(F.col("event_type").alias("type"), F.parse_json("props").alias("props"))
    payload = F.to_json(F.struct(who.alias("who"), (F.col("value") > 10).alias("large")))
    return P.table(spark, sf_dir, "events").select(F.expr("event_id DIV 3").alias("document"), (F.col("event_id") % 3 + 1).alias("voter"), payload.alias("payload"))


@query(f"WITH {_NESTED} SELECT document, path, value, value IS NOT NULL AS agreed, unanimous FROM b")
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readings agree on, by path."""
    return nested_votes.fields(_payloads(spark, sf_dir)).select("document", F.array_join("path", ".").alias("path"), "value", "agreed", "unanimous")


@query(f"""WITH {_NESTED}, w AS (SELECT document, bool_and(value IS NOT NULL) AS agreed, bool_and(unanimous) AS same, count(*) FILTER (value IS NULL) AS disagreed, max(value) FILTER (path = 'large') AS l, max(value) FILTER (path = 'who.props.k') AS k, max(value) FILTER (path = 'who.type') AS t FROM b GROUP BY document)
SELECT document, CASE WHEN agreed THEN '{{"large":' || l || ',"who":{{"props":{{"k":' || k || '}},"type":' || t || '}}}}' END AS payload, CASE WHEN same THEN 'auto_approved' WHEN agreed THEN 'majority_agreed' ELSE 'escalated_to_user' END AS status, disagreed, 0 AS bad FROM w""")
def nested_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects that readings agree on, put together again."""
    return nested_votes.reconciled(_payloads(spark, sf_dir))
