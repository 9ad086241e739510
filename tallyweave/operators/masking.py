"""Masking of personal data in documents by fixed patterns, with placeholders that can be turned back.

Spans are needed, which no built-in expression gives together with the numbering
of placeholders: a pandas UDF, a text at a time. Model passes are injected.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[int, int, str]

#: Patterns of each kind.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("ITALIAN_FISCAL_CODE", r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b"),
    ("IRISH_PPSN", r"\b\d{7}[A-Z]{1,2}\b"),
    ("LOCATION", r"(?i)\b(?:via|viale|piazza|corso|strada|vicolo|p\.zza|c\.so|v\.le)\s+[A-Za-z\s']+\d+\b"),
    ("LOCATION", r"(?i)\b\d{5}\s+[A-Za-z\s']+\b"),
    ("ACCOUNT_NUMBER", r"(?i)\b(?:conto|account)(?:\s+number)?\s+([A-Z0-9-]{3,20})\b"),
    ("ACCOUNT_NUMBER", r"\bU\*\*\*[0-9]{3,10}\b"),
)
FIRST = ("ITALIAN_FISCAL_CODE", "IRISH_PPSN")
DATE_OR_TIME = r"(?i)^(?:del\s+)?\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{2}:\d{2}:\d{2})\b$"
PLACEHOLDER = r"\[ANONYMIZED_[A-Z_]+_[A-Z_]+_\d+\]"
#: Words that statements use, which are no personal data.
PLAIN_WORDS = frozenset("""
date account description transaction type symbol quantity price currency gross amount commission net buy sell deposit withdrawal transfer forex trade starting cash ending change total
fee fees tax taxes base component shares share order executed via for stock etf dividend salary pension payout isin to from the a an of in on by at with and or but as
data conto descrizione tipo operazione simbolo quantita prezzo valuta importo commissioni netto acquisto vendita deposito prelievo trasferimento totale debito credito eseguito inoltro
negoziazione richiesta immissione controvalore ritenuta spese signor signora italia torino milano roma nota informativa ordine confermiamo scadenza intermediario mercato esecuzione borsa
liquidazione consegna pagamento contanti effetti fiscali saranno disponibili menu gain capital cap
di da con su per tra fra il la i gli le un una uno del della dei degli delle al alla ai agli alle nel nella nei negli nelle col coi sul sulla sui sugli sulle pel pei dal dalla dai dagli dalle
vs vostro vostra vostri vostre
""".split())

_COMPILED = tuple((kind, re.compile(p)) for kind, p in PATTERNS)
_DATE, _NO_WORD = re.compile(DATE_OR_TIME), re.compile(r"[^\w\s]|_")


def found(text: str) -> list[Span]:
    return [(m.start(), m.end(), kind) for kind, p in _COMPILED for m in p.finditer(text)]


class Clear:
    """Spans of a text that keep clear of each other; each is looked up among those there by bisection."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[Span] = []

    def offer(self, spans: Iterable[Span]) -> None:
        """Take in, from the left and at one place the longest first, what touches none of those there."""
        for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
            k = bisect_left(self.starts, end)
            if not k or self.spans[k - 1][1] <= start:
                self.starts.insert(k, start)
                self.spans.insert(k, (start, end, kind))


def chosen(spans: Iterable[Span]) -> list[Span]:
    """Spans that do not overlap: identity numbers before all others, each lot from the left."""
    spans, clear = list(spans), Clear()
    for early in (True, False):
        clear.offer(s for s in spans if (s[2] in FIRST) == early)
    return clear.spans


def harmless(value: str) -> bool:
    """A date or time, or nothing but words that statements use."""
    words = set(_NO_WORD.sub("", value.lower()).split())
    return bool(_DATE.match(value.strip())) or bool(words) and words <= PLAIN_WORDS


class Placeholders:
    """Names for values: a value has one of a kind and source, which are numbered on from those already known."""

    def __init__(self, source: str, known: dict[str, str] | None = None):
        self.source, self.values = source.upper(), dict(known or {})
        self.names: dict[tuple[str, str], str] = {}
        self.numbers: Counter[str] = Counter()
        for name, value in self.values.items():
            prefix = name.rpartition("_")[0]
            self.names.setdefault((prefix, value), name)
            self.numbers[prefix] += 1

    def of(self, kind: str, value: str) -> str:
        prefix = f"[ANONYMIZED_{self.source}_{kind}"
        if (prefix, value) not in self.names:
            self.numbers[prefix] += 1
            name = self.names[prefix, value] = f"{prefix}_{self.numbers[prefix]}]"
            self.values[name] = value
        return self.names[prefix, value]


def masked_text(text: str, source: str = "PRESIDIO", finder: Callable[[str], list[Span]] = found, known: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """The text with placeholders, and what each stands for. Numbers run from the right; the pieces are joined once."""
    placeholders = Placeholders(source, known)
    hidden = [s for s in chosen(finder(text)) if not harmless(text[s[0] : s[1]])]
    names = [placeholders.of(kind, text[a:b]) for a, b, kind in hidden[::-1]][::-1]
    borders = [0, *(x for s in hidden for x in s[:2]), len(text)]
    between = [text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)]
    return "".join(x for pair in zip(between, [*names, ""], strict=True) for x in pair), placeholders.values


def masked(docs: DataFrame, text_column: str = "text", passes: tuple[tuple[str, Callable[[str], list[Span]]], ...] = (("PRESIDIO", found),)) -> DataFrame:
    """docs with masked (text, placeholders), after each pass in turn; at least one pass."""
    if not passes:
        raise ValueError("no masking pass is enabled")

    @F.pandas_udf("struct<text:string,placeholders:map<string,string>>")
    def mask(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            names: dict[str, str] = {}
            for source, finder in passes:
                if t is not None:
                    t, names = masked_text(t, source, finder, names)
            rows.append((t, names))
        return pd.DataFrame(rows, columns=["text", "placeholders"])

    return docs.withColumn("masked", mask(text_column))


def unmasked(text: Column, placeholders: Column) -> Column:
    """The text with what each placeholder stands for, longer names first."""
    entries = F.array_sort(F.map_entries(placeholders), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(entries, text, lambda t, e: F.replace(t, e["key"], e["value"]))


def unmasked_within(value: Column, kind: T.DataType, placeholders: Column) -> Column:
    """unmasked() for every text in a value of any nested type."""
    if isinstance(kind, T.StringType):
        return unmasked(value, placeholders)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: unmasked_within(x, kind.elementType, placeholders))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: unmasked_within(x, kind.valueType, placeholders))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(unmasked_within(value[f.name], f.dataType, placeholders).alias(f.name) for f in kind.fields)))
    return value


def placeholders_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def leftovers(text: Column) -> Column:
    """Placeholders still in a text."""
    return F.regexp_count(text, F.lit(PLACEHOLDER))
