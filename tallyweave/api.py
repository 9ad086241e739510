"""The engine's surface for tools and agents: named questions over its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .functions.arithmetic import evaluated
from .operators import portfolio, reads, retrieval, tax


@dataclass
class Engine:
    """Tables by name (ledger, chunks, classifications, profiles, mergers, remittances, income), and injected models."""

    tables: dict[str, DataFrame]
    embed: Callable[[str], list[float]] | None = None
    tools: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, tool: Callable) -> None:
        self.tools[name] = tool

    def call(self, name: str, **arguments):
        return self.tools[name](**arguments) if name in self.tools else getattr(self, name)(**arguments)

    def list_documents(self) -> DataFrame:
        return retrieval.document_metadata(self.tables["chunks"]).orderBy("jurisdiction", "document_name")

    def query_tax_knowledge(self, query_text: str, limit: int = 10, jurisdiction: str | None = None, source_type: str | None = None) -> DataFrame:
        if self.embed is None:
            raise ValueError("no embedding model was given")
        return retrieval.hybrid(self.tables["chunks"], query_text, self.embed(query_text), limit, jurisdiction, source_type)

    def keyword_search_knowledge(self, query_text: str, limit: int = retrieval.KEYWORD_LIMIT, jurisdiction: str | None = None, source_type: str | None = None) -> DataFrame:
        return retrieval.keyword_search(self.tables["chunks"], query_text, limit, jurisdiction, source_type)

    def get_chunk_content(self, chunk_id: int) -> DataFrame:
        found = reads.by_key(self.tables["chunks"], "id", chunk_id)
        if found.isEmpty():
            raise LookupError(f"no chunk {chunk_id}")
        return found

    def get_surrounding_context(self, chunk_id: int, window: int = 1) -> DataFrame:
        wanted = self.get_chunk_content(chunk_id).select("document_name", "chunk_index")
        return retrieval.neighbours(self.tables["chunks"], wanted, window).orderBy("chunk_index")

    def get_document_statistics(self, document_sha: str) -> DataFrame:
        return retrieval.document_statistics(self.tables["chunks"], document_sha)

    def get_document_page(self, document_name: str, page_number: int, jurisdiction: str | None = None) -> DataFrame:
        return retrieval.page(self.tables["chunks"], document_name, page_number, jurisdiction)

    def filter_financial_records(self, **wanted) -> DataFrame:
        return reads.ledger_filter(self.tables["ledger"], **({"limit": 100} | wanted))

    def portfolio_snapshot(self, **wanted) -> tuple[DataFrame, DataFrame]:
        return portfolio.snapshot(self.tables["ledger"], self.tables.get("mergers"), **wanted)

    def cgt_computation(self, tax_year: int) -> DataFrame:
        """Disposals of a year with their gains; annual_summary() adds them up."""
        ledger = self.tables["ledger"]
        sold = tax.disposals_of(ledger.where(f"year(event_timestamp) = {int(tax_year)}"))
        return tax.disposal_gains(sold, tax.lots_of(ledger), self.tables["classifications"], self.tables["profiles"], self.tables.get("remittances"))

    def taxpayer_profile(self, tax_year: int) -> DataFrame:
        return reads.by_key(self.tables["profiles"], "tax_year", tax_year)

    def income_records(self, **wanted) -> DataFrame:
        return reads.income(self.tables["income"], **wanted)

    def calculate(self, expression: str) -> str:
        return format(evaluated(expression).normalize(), "f")
