"""Formats of Spark's data source API: broker statements, OCR text and chat sessions, as tables and as streams.

After register(spark), spark.read.format("broker_statement").load(folder) and
spark.readStream.format("broker_statement").load(folder) read all files below a
folder. Files are listed once, packed into partitions of about `partitionBytes`
and read where they are parsed. path_country and path_provider are the two
folders above a file; comparisons of them (equality, IN, IS NOT NULL) and of
path are pushed down to the listing, so that other files are never opened.

Folders are read through pyarrow's file systems: a path that all executors
share, or a URI (file, hdfs, s3, gs).

Options: path, suffix, partitionBytes, mode. With mode FAILFAST (default) a file
or row that cannot be read fails the query; with PERMISSIVE it is a row with
`error` and nothing else but its place. Empty files have no rows, null bytes and
texts that are not UTF-8 are read as Latin-1.

Streams take files in order of their time of change and path; an offset is the
last file's. A file that comes later with an earlier time is not seen.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from ..functions.text import PAGE_BREAKS
from ..schemas import SESSION
from .files import AMOUNT, CURRENCY, DATE, ISIN, KIND, NAME, QUANTITY, TICKER

_PLACE = "path string, path_country string, path_provider string"
_UNITS = Decimal("0.000001")


@dataclass(frozen=True)
class File:
    path: str
    size: int
    changed: int

    @property
    def folders(self) -> tuple[str | None, str | None]:
        parts = self.path.split("/")
        return (parts[-3].lower(), parts[-2].lower()) if len(parts) > 3 else (None, None)

    @property
    def place(self) -> tuple[int, str]:
        return self.changed, self.path


@dataclass
class Files(InputPartition):
    files: list[File]


def _listed(path: str, suffix: str) -> list[File]:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (fs.LocalFileSystem(), path)
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((File(x.path, x.size, x.mtime_ns or 0) for x in found if x.is_file and fnmatch(x.base_name, f"*{suffix}")), key=lambda f: f.place)


def _content(path: str, file: File) -> bytes:
    from pyarrow import fs

    system = fs.FileSystem.from_uri(path)[0] if re.match(r"\w+://", path) else fs.LocalFileSystem()
    with system.open_input_stream(file.path) as f:
        return f.read()


def _text(content: bytes) -> str:
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _packed(files: list[File], most: int) -> list[Files]:
    """Files in partitions of about so many bytes, in their order."""
    out, size = [], 0
    for f in files:
        if not out or size + f.size > most:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out


class _Format(DataSource):
    """A kind of file: rows() makes tuples of columns, without the place and the error, or raises ValueError."""

    columns, width, suffix = "", 0, ""

    def rows(self, file: File, text: str, content: bytes) -> Iterator[tuple | ValueError]:
        raise NotImplementedError

    def schema(self) -> StructType | str:
        return f"{self.columns}, {_PLACE}, error string"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self)

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self)

    @property
    def folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("a folder must be given by load(path)")
        return self.options["path"]

    def listed(self) -> list[File]:
        return _listed(self.folder, self.options.get("suffix", self.suffix))

    def packed(self, files: list[File]) -> list[Files]:
        return _packed(files, int(self.options.get("partitionBytes", 32 << 20)))

    def read(self, part: Files) -> Iterator[tuple]:
        strict = self.options.get("mode", "FAILFAST").upper() == "FAILFAST"
        for file in part.files:
            content = _content(self.folder, file)
            for row in self.rows(file, _text(content), content):
                if not isinstance(row, ValueError):
                    yield (*row, file.path, *file.folders, None)
                elif strict:
                    raise ValueError(f"{row}: {file.path}")
                else:
                    yield (*[None] * self.width, file.path, *file.folders, str(row))


class _Reader(DataSourceReader):
    def __init__(self, source: _Format):
        self.source, self.tests = source, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name in ("path", "path_country", "path_provider"):
                self.tests.append((name, None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def _wanted(self, file: File) -> bool:
        own = dict(zip(("path", "path_country", "path_provider"), (file.path, *file.folders), strict=True))
        return all(own[name] is not None and (values is None or own[name] in values) for name, values in self.tests)

    def partitions(self) -> list[Files]:
        # Spark asks for a partition even where there is nothing to read.
        return self.source.packed([f for f in self.source.listed() if self._wanted(f)]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.source.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, source: _Format):
        self.source = source

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.source.listed()
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((x["changed"], x["path"]) for x in (start, end))
        return self.source.packed([f for f in self.source.listed() if after < f.place <= upto]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.source.read(partition)


def _number(text: str | None) -> Decimal | None:
    """An Italian number, as functions.numbers.italian_decimal reads it."""
    s = re.sub("[€$ ]", "", (text or "").strip(" "))
    if "," in s:
        s = s.replace(".", "").replace(",", ".") if "." in s else s.replace(",", ".")
    elif re.fullmatch(r"[0-9-]*[0-9][0-9-]*\.[^.]{3}", s):
        s = s.replace(".", "")
    if not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", s):
        return None
    try:
        return Decimal(s).quantize(_UNITS, ROUND_HALF_UP)
    except InvalidOperation:
        return None


def _day(text: str) -> datetime.datetime | None:
    for form in ("%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d"):
        if re.fullmatch(form.replace("%d", r"\d\d").replace("%m", r"\d\d").replace("%Y", r"\d{4}"), text):
            try:
                return datetime.datetime.strptime(text, form)
            except ValueError:
                continue
    return None


class BrokerStatement(_Format):
    """An Italian broker's statements; further options: provider, country."""

    width, suffix = 20, ".csv"
    columns = (
        "provider string, source_file_name string, source_file_sha string, event_timestamp timestamp, asset_type string, symbol string, isin string, asset_name string, action string, quantity decimal(20,6), "
        "unit_price decimal(20,6), currency string, fees decimal(20,6), total_amount decimal(20,6), fx_rate decimal(20,6), local_total_amount decimal(20,6), tax_year int, account_country string, "
        "verification_status string, row int"
    )

    @classmethod
    def name(cls) -> str:
        return "broker_statement"

    def rows(self, file: File, text: str, content: bytes) -> Iterator[tuple | ValueError]:
        lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip(" ")]
        at = next((k for k, x in enumerate(lines) if DATE in x and KIND in x), None)
        if at is None:
            yield ValueError("no header")
            return
        header = [c.strip(" ").lower() for c in lines[at].split(";")]
        whole = (self.options.get("provider", "directa"), file.path.rsplit("/", 1)[-1], hashlib.sha256(content).hexdigest())
        for number, line in enumerate(lines[at + 1 :]):
            yield self._row(whole, number, header, [c.strip(" ") for c in line.split(";")])

    def _row(self, whole: tuple, number: int, header: list[str], cells: list[str]) -> tuple | ValueError:
        def cell(name: str) -> str | None:
            k = header.index(name.lower()) if name.lower() in header else len(cells)
            return cells[k] or None if k < len(cells) else None

        if len(cells) < len(header):
            return ValueError("too few columns")
        day, kind = cell(DATE), (cell(KIND) or "").lower()
        if not day or not kind:
            return ValueError("no date or kind")
        at, total = _day(day), _number(cell(AMOUNT) if AMOUNT.lower() in header else "0")
        dividend, withheld = "dividendo" in kind or "incasso dividendi" in kind, "ritenuta" in kind
        for wrong, message in ((at is None, "no such date"), (total is None, "no such amount"), (not (dividend or withheld), "unknown kind of operation")):
            if wrong:
                return ValueError(message)
        total, currency, upper = abs(total), (cell(CURRENCY) or "EUR").upper(), lambda name: (cell(name) or "").upper() or None
        one, euro = Decimal(1), currency == "EUR"
        return (
            *whole, at, "stock" if dividend else "tax_payment", upper(TICKER), upper(ISIN), cell(NAME), "dividend" if dividend else "tax_payment", _number(cell(QUANTITY)) or None, None, currency, Decimal(0), total,
            one if euro else None, total if euro else None, at.year, self.options.get("country", "italy"), "pending_approval", number,
        )


class OcrText(_Format):
    """OCR output cut into pages at the first kind of page break that leaves any text; the text as it is."""

    columns, width, suffix = "page_number int, text string", 2, ".txt"

    @classmethod
    def name(cls) -> str:
        return "ocr_text"

    def rows(self, file: File, text: str, content: bytes) -> Iterator[tuple | ValueError]:
        for sign, pattern in PAGE_BREAKS:
            pages = [p for p in (x.strip() for x in re.split(pattern, text)) if p] if re.search(sign, text) else []
            if pages:
                break
        else:
            pages = [text.strip()]
        yield from ((k, p) for k, p in enumerate(pages, 1) if content)


class ChatSession(_Format):
    """One JSON file a session."""

    width, suffix = 5, ".json"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SESSION.fields if f.name != "_corrupt_record")

    @classmethod
    def name(cls) -> str:
        return "chat_session"

    def rows(self, file: File, text: str, content: bytes) -> Iterator[tuple | ValueError]:
        try:
            told = json.loads(text)
            fields = SESSION["messages"].dataType.elementType.names
            plain = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
            messages = told.get("messages")
            yield (*(plain(told.get(c)) for c in ("id", "title", "created_at", "updated_at")), None if messages is None else [tuple(plain(m.get(c)) for c in fields) for m in messages])
        except (ValueError, AttributeError):
            yield ValueError("no such session")


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters pushed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in (BrokerStatement, OcrText, ChatSession):
        spark.dataSource.register(kind)
