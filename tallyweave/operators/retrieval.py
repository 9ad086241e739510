"""Chunks of documents: keyword, nearest-neighbour and hybrid search, neighbours, pages, statistics.

A chunk table has the columns of schemas.CHUNKS, its vectors beside its text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jurisdiction as normal
from . import text_index, vector_index
from .materialize import new_folder, united

KEYWORD_LIMIT = 50


def _scoped(chunks: DataFrame, jurisdiction: str | None, source_type: str | None) -> DataFrame:
    if jurisdiction:
        chunks = chunks.where(normal(F.col("jurisdiction")) == normal(F.lit(jurisdiction)))
    return chunks.where(F.col("source_type") == source_type) if source_type else chunks


def phrases(query: str) -> list[str]:
    """Runs of two and three words of a query; single letters are left out. One word stands for itself."""
    words = [w for w in query.lower().split() if len(w) > 1]
    runs = [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]
    return runs or words


def keyword_search(chunks: DataFrame, query: str, limit: int = KEYWORD_LIMIT, jurisdiction: str | None = None, source_type: str | None = None, compat: bool = False) -> DataFrame:
    """Chunks that hold any phrase of the query, literally, by id. A query without phrases finds nothing; under compat, where only runs count, everything."""
    found = phrases(query) if not compat else [p for p in phrases(query) if " " in p]
    rows = _scoped(chunks, jurisdiction, source_type)
    text = F.lower("text_content")
    if found:
        rows = rows.where(reduce(lambda a, b: a | b, (text.contains(p) for p in found)))
    elif not compat:
        rows = rows.where(F.lit(False))
    return rows.orderBy("id").limit(limit).withColumns({"distance": F.lit(0.0), "context": F.coalesce("parent_text_content", "text_content")})


def distance(vector: Column, query: list[float], metric: str = "l2") -> Column:
    """Distance of a vector column to a query, in double precision, JVM-side; no expression for each of its numbers."""
    q = F.array(*(F.lit(float(x)) for x in query))
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    if metric != "cosine":
        raise ValueError(f"no such metric: {metric}")
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - dot / (norm * float(np.linalg.norm(query)))


def knn(chunks: DataFrame, query: list[float], limit: int, jurisdiction: str | None = None, source_type: str | None = None, metric: str = "l2", id_column: str = "id", vector_column: str = "embedding", compat: bool = False) -> DataFrame:
    """The nearest chunks, exactly. Filters come before the limit; under compat after a pool of max(10 * limit, 100), as there."""
    rows = chunks if compat else _scoped(chunks, jurisdiction, source_type)
    rows = rows.where(F.size(vector_column) == len(query)).withColumn("distance", distance(F.col(vector_column), query, metric))
    if compat and (jurisdiction or source_type):
        rows = _scoped(rows.orderBy("distance", id_column).limit(max(10 * limit, 100)), jurisdiction, source_type)
    return rows.orderBy("distance", id_column).limit(limit)


def knn_join(chunks: DataFrame, queries: DataFrame, limit: int, id_column: str = "id", vector_column: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, distance, rank, cells_read): the nearest chunks of each row of a query table, exactly, by an index built for the purpose."""
    index = vector_index.build(chunks.select(id_column, vector_column), new_folder(chunks.sparkSession, "vectors"), id_column, vector_column)
    return vector_index.search(index, queries, limit, query_id, vector_column)


def lexical_score(query: str) -> Callable[[Column], Column]:
    """The share of a query's words that a text holds: what ranks where no model is given."""
    words = sorted({w for w in query.lower().split() if len(w) > 1})

    def score(text: Column) -> Column:
        return sum((F.lower(text).contains(w).cast("double") for w in words), F.lit(0.0)) / max(len(words), 1)

    return score


def hybrid(
    chunks: DataFrame, query: str, embedding: list[float], limit: int, jurisdiction: str | None = None, source_type: str | None = None, score: Callable[[Column], Column] | None = None,
    metric: str = "l2", index: text_index.TextIndex | None = None,
) -> DataFrame:
    """The nearest max(20 * limit, 150) and the first 50 by keyword, each chunk once, the best by score.

    With an index of the chunks keywords are found by it and BM25 is the score, unless one is given; without, texts are scanned.
    """
    if len(query.split()) < 3:
        raise ValueError("a query needs three words at least")
    near = knn(chunks, embedding, max(20 * limit, 150), jurisdiction, source_type, metric).withColumn("_from", F.lit(0))
    said = indexed_search(chunks, index, query, KEYWORD_LIMIT, jurisdiction, source_type) if index else keyword_search(chunks, query, KEYWORD_LIMIT, jurisdiction, source_type).drop("context")
    both = near.transform(united, said.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("id").orderBy("_from"))
    once = both.withColumn("_n", first).where("_n = 1").drop("_n", "_from")
    if index and score is None:
        told = text_index.bm25(index, chunks.sparkSession.createDataFrame([(0, query)], "query_id int, query string")).select("id", F.col("score").alias("_score"))
        scored = once.join(told, "id", "left").withColumn("rerank_score", F.coalesce("_score", F.lit(0.0))).drop("_score")
    else:
        scored = once.withColumn("rerank_score", (score or lexical_score(query))(F.col("text_content")))
    return scored.orderBy(F.desc("rerank_score"), "id").limit(limit)


def indexed_search(chunks: DataFrame, index: text_index.TextIndex, query: str, limit: int = KEYWORD_LIMIT, jurisdiction: str | None = None, source_type: str | None = None) -> DataFrame:
    """What keyword_search() finds, by an index of the chunks; no text is read but of those found."""
    asked = chunks.sparkSession.createDataFrame([(p,) for p in phrases(query)], "phrase string")
    hits = text_index.phrase_hits(index, asked).select("id").distinct()
    return _scoped(chunks, jurisdiction, source_type).join(hits, "id", "left_semi").orderBy("id").limit(limit).withColumn("distance", F.lit(0.0))


def evidence(chunks: DataFrame, queries: list[tuple[str, list[float]]], limit: int) -> DataFrame:
    """Several phrases at once: each chunk as the first phrase found it, by distance."""
    found = reduce(lambda a, b: a.transform(united, b), (knn(chunks, e, limit).withColumns({"phrase": F.lit(p), "_order": F.lit(k)}) for k, (p, e) in enumerate(queries)))
    first = F.row_number().over(Window.partitionBy("id").orderBy("_order"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n", "_order").orderBy("distance", "id").limit(limit)


def neighbours(chunks: DataFrame, wanted: DataFrame, window: int = 1) -> DataFrame:
    """Chunks of the same document within a window of those wanted (document_name, chunk_index), themselves included, with of_index.

    Each wanted row becomes the few indexes it asks for, and these are joined as keys.
    """
    asked = wanted.select("document_name", F.col("chunk_index").alias("of_index"), F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    return chunks.join(asked, ["document_name", "chunk_index"])


def pages(chunks: DataFrame) -> DataFrame:
    """Every page with its chunks' texts in order, their number, and whether pages are before and after it."""
    keys = [F.lower("document_name").alias("document"), "jurisdiction", "page_number"]
    found = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text_content"))).alias("_t"), F.count("*").alias("chunks"))
    last = chunks.groupBy(F.lower("document_name").alias("document")).agg(F.min("page_number").alias("_first"), F.max("page_number").alias("_last"))
    return found.join(last, "document").select(
        "document", "jurisdiction", "page_number", F.array_join(F.transform("_t", lambda x: x["text_content"]), "\n\n").alias("text"), "chunks",
        (F.col("page_number") > F.col("_first")).alias("has_previous"), (F.col("page_number") < F.col("_last")).alias("has_next"),
    )


def page(chunks: DataFrame, document: str, number: int, jurisdiction: str | None = None) -> DataFrame:
    rows = chunks.where(F.lower("document_name") == document.lower())
    rows = rows if jurisdiction is None else rows.where(normal(F.col("jurisdiction")) == normal(F.lit(jurisdiction)))
    return pages(rows).where(F.col("page_number") == number)


def document_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_sha", "document_name", "jurisdiction", "source_type").agg(F.count("*").alias("chunks"))


def document_metadata(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_name", "jurisdiction", "source_type").agg(F.count("*").alias("chunks"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page")).withColumn("page_range", F.concat_ws("-", "first_page", "last_page"))


def document_statistics(chunks: DataFrame, sha: str | None = None) -> DataFrame:
    rows = chunks if sha is None else chunks.where(F.col("document_sha") == sha)
    return rows.groupBy("document_sha", "document_name").agg(F.count("*").alias("chunks"), F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page")).withColumn("total_pages", F.col("end_page") - F.col("start_page") + 1)


def chunk_id(sha: Column, index: Column) -> Column:
    """A stable id: the first eight bytes of a hash, as a non-negative number."""
    head = F.conv(F.substring(F.sha2(F.concat_ws("_", sha, index.cast("string")).cast("binary"), 256), 1, 16), 16, -10).cast("bigint")
    return F.abs(head)


def pooled(tokens: Column) -> Column:
    """The mean of token vectors (an array of equal arrays), scaled to length one."""
    n = F.size(tokens)
    total = F.aggregate(F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), F.transform(F.element_at(tokens, 1), lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    mean = F.transform(total, lambda x: x / n)
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mean, lambda x: x / norm)
