"""Operator 10, secrets by a trigram inverted index.

The driver turns each rule's regular expression into a Boolean query over
trigrams that every match must hold (trigrams.py). Each task indexes the texts
it reads, piece by piece: the trigram codes of all bytes are computed at once,
those that a rule names become postings (trigram -> texts), the queries are
evaluated by intersecting and uniting postings, and only the texts left are
verified by the expression itself. A rule without mandatory trigrams scans
every text. Nothing is shuffled, and a lost task is simply run again.

Null and empty texts have no spans. Spans are code points, end exclusive.
Matches that fail a rule's test are dropped and not retried. Repeated rows give
repeated rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import trigrams
from .common import by_batch, column, slices, table, text_bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Rule:
    """kind; pattern; a match counts if its group is at least so many characters long."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    query: trigrams.Query = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigrams.of_pattern(self.pattern))


#: The kinds that the result must hold, in order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Added by this operator.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # From the beginning of a run, and with what a run holds taken at once: a run is read once, whatever it is made of.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge", r"(?:ghp|gho|ghu|ghs|ghr|glpat)[_-][A-Za-z0-9_-]{20,}"),
)


def compiled(rule: Rule) -> re.Pattern:
    # Letters in either case are ASCII letters only. A short run of hex digits fails whole, so the long ones can be asked for.
    return re.compile(rule.pattern.replace("[0-9a-f]+", "[0-9a-f]{24,}") if rule.kind == "hex" else rule.pattern, re.ASCII)


def matches(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Index:
    """Postings of the named trigrams over the texts of one piece."""

    def __init__(self, names: list[str]):
        self.numbers = {x: k for k, x in enumerate(names)}
        self.of_code = np.zeros(1 << 24, np.uint16)
        for x, k in self.numbers.items():
            a, b, c = x.encode()
            self.of_code[a << 16 | b << 8 | c] = k + 1

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n = len(offsets) - 1
        low = LOWER[data].astype(np.int32)
        named = self.of_code[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(named)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        pairs = np.unique((named[at][inside].astype(np.int64) - 1) * self.n + text[inside])
        self.texts = pairs % self.n if self.n else pairs
        self.heads = np.searchsorted(pairs, np.arange(len(self.numbers) + 1) * self.n)

    def search(self, query: trigrams.Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            k = self.numbers[query]
            return self.texts[self.heads[k] : self.heads[k + 1]]
        found = sorted(map(self.search, query[1]), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and spans, an array of (kind, start, end) by start, then order of rules, for every row of docs."""
    names = sorted(set().union(*(trigrams.of_query(r.query) for r in rules)))
    patterns = [compiled(r) for r in rules]
    held: list[Index] = []

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Index(names))
        index, texts, found = held[0], column(batch, "text"), [[] for _ in range(batch.num_rows)]
        for first, last in slices(texts, 4 << 20):
            piece = texts.slice(first, last - first)
            index.build(*text_bytes(piece))
            read: Callable[[int], str] = lambda i, own=piece.to_pylist(): own[i] or ""
            for k, rule in enumerate(rules):
                for i in index.search(rule.query).tolist():
                    found[first + i] += [(start, k, end) for start, end in matches(rule, patterns[k], read(i))]
        spans = [[{"kind": rules[k].kind, "start": start, "end": end} for start, k, end in sorted(x)] for x in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(spans, kind)], ["id", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = by_batch(docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>", rows)
    return out.withColumnRenamed("id", id_column)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = "kind IN ('assign', 'access', 'hex')"
    told = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    count = "CAST(size(filter(spans, x -> x.kind = '{0}')) AS BIGINT) AS n_{0}"
    return secret_spans(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", *(count.format(r.kind) for r in BASE), f"sha2({told.format(f'filter(spans, x -> x.{base})')}, 256) AS base_sha256", f"{told.format('spans')} AS spans"
    )


def brute(text: str | None) -> tuple[list[int], str, str]:
    """The query's columns for one text, plainly, for tests: counts, digest and spans."""
    every = sorted((start, k, end) for k, r in enumerate(BASE + MORE) for start, end in matches(r, re.compile(r.pattern, re.ASCII), text or ""))
    tell = lambda most: ",".join(f"{(BASE + MORE)[k].kind}:{s}:{e}" for s, k, e in every if k < most)
    return [sum(k == i for _, k, _ in every) for i in range(3)], hashlib.sha256(tell(3).encode()).hexdigest(), tell(99)


def _oracle() -> str:
    """The same in DuckDB's SQL: matches and the pieces between them give the places."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    parts = []
    for n, rule in enumerate(BASE + MORE):
        # SQL's expressions know no lookbehind and need no possessive quantifiers; what stands before is tested apart.
        p = rule.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", either).replace("(?<![A-Za-z0-9_-])", "").replace("}+", "}").replace("'", "''")
        free = " AND NOT regexp_matches(substring(t, s, 1), '[A-Za-z0-9_-]')" if rule.pattern.startswith("(?<!") else ""
        parts.append(f"""
  SELECT doc_id, n, kind, s, e FROM (SELECT doc_id, t, m, {n} AS n, '{rule.kind}' AS kind, CAST(e - len(m) AS BIGINT) AS s, e FROM (
    SELECT doc_id, t, m, sum(len(m) + len(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, t, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d))))
  WHERE len(regexp_extract(m, '{p}', {rule.group})) >= {rule.least}{free}""")
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, sha256(coalesce({told} FILTER (n < {len(BASE)}), '')) AS base_sha256, coalesce({told}, '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


ORACLE = _oracle()
