"""From files to staged rows and chunks, each content once, with a manifest of what went well and what did not."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunking, reads, retrieval, store
from .materialize import united


class TaxEngine(Protocol):
    """What a country's rules offer: disposals and lots in, a row for each disposal out."""

    def disposal_gains(self, disposals: DataFrame, lots: DataFrame, classes: DataFrame, profiles: DataFrame) -> DataFrame: ...


def statements(files: DataFrame, manifest: DataFrame, parse: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(staged rows, manifest rows) of files whose content is not yet done.

    A file with any row that cannot be read gives no rows, and is noted as failed with the first error, to be tried again.
    parse(files, strict=False) gives rows with source_file_sha and error.
    """
    new = reads.fresh(files.dropDuplicates(["file_sha"]), manifest)
    rows = parse(new, strict=False)
    told = rows.groupBy("source_file_sha").agg(F.count_if(F.col("error").isNull()).alias("transaction_count"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("row"))).alias("error_message"))
    noted = new.select("file_sha", "file_name").join(told.withColumnRenamed("source_file_sha", "file_sha"), "file_sha", "left")
    failed = F.col("error_message").isNotNull()
    noted = noted.select("file_sha", "file_name", F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"), F.when(failed, 0).otherwise(F.coalesce("transaction_count", F.lit(0))).cast("int").alias("transaction_count"), "error_message", F.current_timestamp().alias("processed_at"))
    bad = told.where("error_message IS NOT NULL").select("source_file_sha")
    return rows.join(bad, "source_file_sha", "left_anti").drop("error"), noted


def documents(chunks: DataFrame, docs: DataFrame, replace: bool = False, source_type: str = "regulation", confidence: str = "high", encode=None) -> DataFrame:
    """The chunk table with documents (document_sha, document_name, jurisdiction, text, and page_number where they are pages).

    Documents that the table has are skipped, or replaced whole. Pages are joined in batches before they are cut; a chunk is on the
    page that its beginning lies on, and chunks are numbered through their document. Documents without pages are on page 0.
    """
    new = docs if replace else docs.join(chunks.select("document_sha").distinct(), "document_sha", "left_anti")
    named = new.select("document_sha", "document_name", "jurisdiction").dropDuplicates(["document_sha"])
    if "page_number" in docs.columns:
        batches = chunking.page_batches(new.select("document_sha", "page_number", "text")).withColumn("_batch", F.struct("document_sha", "batch"))
        cut = chunking.late_chunks(batches, key="_batch", encode=encode).join(batches.select("_batch", "ranges"), "_batch")
        cut = renumbered(cut.withColumns({"document_sha": F.col("_batch.document_sha"), "batch": F.col("_batch.batch"), "page_number": chunking.page_of(F.col("ranges"), F.col("start"))}))
    else:
        cut = chunking.late_chunks(new, encode=encode).withColumn("page_number", F.lit(0))
    rows = cut.join(named, "document_sha").select(
        retrieval.chunk_id(F.col("document_sha"), F.col("chunk_index")).alias("id"), "document_name", "document_sha", "jurisdiction", F.lit(source_type).alias("source_type"), F.lit(confidence).alias("confidence_level"),
        "page_number", "text_content", "chunk_index", F.lit(None).cast("long").alias("parent_chunk_id"), "parent_text_content", F.current_timestamp().alias("created_at"), "embedding",
    )
    kept = chunks.join(named.select("document_sha"), "document_sha", "left_anti").select(chunks.columns)
    return kept.transform(united, rows.select(chunks.columns))


def income_label(status: Column, promoted: Column, payload: Column) -> Column:
    """What a staged income row is shown as."""
    return F.when(promoted.isNotNull(), "approved").when(payload.isNull(), "needs data").when(status == "auto_approved", "unanimous").when(status == "majority_agreed", "majority").otherwise("needs review")


def unpromoted(staged: DataFrame) -> DataFrame:
    """Income that all voters agree on and that has not moved yet."""
    return staged.where("verification_status = 'auto_approved' AND approved_tax_income_record_id IS NULL")


def renumbered(pages: DataFrame, key: str = "document_sha") -> DataFrame:
    """Chunks of several batches of pages in one order."""
    return pages.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(key).orderBy("batch", "chunk_index")) - 1).cast("int"))


def edited(rows: DataFrame, id_column: str, value, **changes) -> DataFrame:
    """One row changed, its local amount filled in where it lacks."""
    out = store.updated(rows, F.col(id_column) == value, **changes)
    return reads.with_local_amount(out) if "local_total_amount" in rows.columns else out
