"""Files as tables: text, Markdown, broker statements, sessions, binary documents, and what their paths tell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, text
from ..schemas import SESSION
from ..operators.materialize import united


def binary(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".pdf", ".csv")) -> DataFrame:
    """(path, file_name, file_sha, length, content) of all files below a folder with one of the suffixes."""
    pattern = "{" + ",".join(f"*{s}" for s in suffixes) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_sha"), "length", "content")


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where it is not."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def whole_texts(spark: SparkSession, folder: str, suffix: str = ".md") -> DataFrame:
    """(path, text) of all files below a folder."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page_number, text): a page for each file without its tags; empty files have none."""
    clean = F.regexp_replace(text.without_tags(F.col("text")), r"^\s+|\s+$", "")
    return whole_texts(spark, folder, ".md").select("path", F.lit(0).alias("page_number"), clean.alias("text")).where("text <> ''")


def context_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = whole_texts(spark, folder, ".md").transform(united, whole_texts(spark, folder, ".txt"))
    return rows.withColumn("char_count", F.length("text")).withColumn("relative_path", F.element_at(F.split("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/"), -1))


def parsed_pages(files: DataFrame, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_number, text) of binary documents by an injected parser: PDF, OCR and the like."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                pages = parse(bytes(content))
                if pages:
                    yield pd.DataFrame({"path": path, "page_number": range(1, len(pages) + 1), "text": pages})

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string")


def ocr_pages(texts: DataFrame, key: str = "path") -> DataFrame:
    """(key, page_number, text) of OCR output, cleaned and cut into pages."""
    return texts.select(key, F.posexplode(text.ocr_pages(F.col("text")))).select(key, (F.col("pos") + 1).alias("page_number"), text.ocr_markdown(F.col("col")).alias("text"))


def table_markdown(table: Column) -> Column:
    """An array of rows of cells as an aligned Markdown table; '' without rows."""
    cells = F.transform(table, lambda r: F.transform(r, lambda c: F.replace(F.replace(F.coalesce(F.trim(c), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))))
    width = F.array_max(F.transform(cells, lambda r: F.size(r)))
    padded = F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    widths = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.greatest(F.lit(3), F.array_max(F.transform(padded, lambda r: F.length(r[i])))))

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.zip_with(row, widths, lambda c, w: F.rpad(c, w, " ")), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    lines = F.transform(padded, line)
    whole = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when((F.size(table) > 0) & (width > 0), whole).otherwise("")


#: How the statement names its columns.
DATE, KIND, TICKER, ISIN, NAME, QUANTITY, AMOUNT, CURRENCY = "Data operazione", "Tipo operazione", "Ticker", "Isin", "Descrizione", "Quantità", "Importo euro", "Divisa"


def broker_statement(files: DataFrame, provider: str = "directa", country: str = "italy", strict: bool = True) -> DataFrame:
    """Rows of an Italian broker's `;` statements (path, file_name, file_sha, content) as staged ledger rows.

    The header is the first line that names date and kind of operation. Rows that cannot be read fail the query if
    strict, and otherwise come back with their error and nothing else.
    """
    lines = F.filter(F.split(decoded(F.col("content")), r"\r\n|\r|\n", -1), lambda x: F.trim(x) != "")
    marks = F.transform("lines", lambda x: x.contains(DATE) & x.contains(KIND))
    at = F.array_position(marks, F.lit(True))

    def bad(message: str) -> Column:
        return F.when(F.lit(strict), F.raise_error(F.concat(F.lit(message + ": "), F.col("file_name"), F.coalesce(F.concat(F.lit(" "), F.col("line")), F.lit(""))))).otherwise(F.lit(message)).cast("string")

    found = files.withColumn("lines", lines).withColumn("at", at).withColumn("header", F.transform(F.split(F.element_at("lines", F.nullif("at", F.lit(0)).cast("int")), ";", -1), lambda c: F.lower(F.trim(c))))
    rows = found.select("file_name", "file_sha", "header", F.posexplode_outer(F.when(F.col("at") > 0, F.slice("lines", F.col("at").cast("int") + 1, F.size("lines"))).otherwise(F.array(F.lit(None).cast("string")))).alias("number", "line"), (F.col("at") > 0).alias("has_header")).where("line IS NOT NULL OR NOT has_header")
    rows = rows.withColumn("cells", F.transform(F.split("line", ";", -1), lambda c: F.trim(c)))

    def cell(name: str) -> Column:
        k = F.array_position("header", F.lit(name.lower())).cast("int")
        return F.when(k > 0, F.nullif(F.try_element_at("cells", k), F.lit("")))

    rows = rows.withColumns({"_date": cell(DATE), "_kind": F.lower(cell(KIND)), "_amount": F.coalesce(cell(AMOUNT), F.when(F.array_contains("header", AMOUNT.lower()), F.lit(None)).otherwise("0")), "_currency": F.upper(F.coalesce(cell(CURRENCY), F.lit("EUR"))), "_quantity": numbers.italian_decimal(cell(QUANTITY))})
    rows = rows.withColumns({"_at": numbers.statement_date(F.col("_date")), "_total": F.abs(numbers.italian_decimal(F.col("_amount")))})
    dividend, withheld = F.col("_kind").contains("dividendo") | F.col("_kind").contains("incasso dividendi"), F.col("_kind").contains("ritenuta")
    error = (
        F.when(~F.col("has_header"), bad("no header")).when(F.size("cells") < F.size("header"), bad("too few columns")).when(F.col("_date").isNull() | F.col("_kind").isNull(), bad("no date or kind"))
        .when(F.col("_at").isNull(), bad("no such date")).when(F.col("_total").isNull(), bad("no such amount")).when(~(dividend | withheld), bad("unknown kind of operation"))
    )
    euro = F.col("_currency") == "EUR"
    money = T.DecimalType(20, 6)
    rows = rows.withColumn("error", error)
    out = rows.select(
        F.lit(provider).alias("provider"), F.col("file_name").alias("source_file_name"), F.col("file_sha").alias("source_file_sha"), F.col("_at").alias("event_timestamp"),
        F.when(dividend, "stock").when(withheld, "tax_payment").alias("asset_type"), F.upper(cell(TICKER)).alias("symbol"), F.upper(cell(ISIN)).alias("isin"), cell(NAME).alias("asset_name"),
        F.when(dividend, "dividend").when(withheld, "tax_payment").alias("action"), F.nullif("_quantity", F.lit(0).cast(money)).alias("quantity"), F.lit(None).cast(money).alias("unit_price"), F.col("_currency").alias("currency"),
        F.lit(0).cast(money).alias("fees"), F.col("_total").cast(money).alias("total_amount"), F.when(euro, F.lit(1).cast(money)).alias("fx_rate"), F.when(euro, F.col("_total").cast(money)).alias("local_total_amount"),
        F.year("_at").alias("tax_year"), F.lit(country).alias("account_country"), F.lit("pending_approval").alias("verification_status"), F.col("number").alias("row"), "error",
    )
    # The error is read, so that it is evaluated, in strict mode too.
    return out.where("error IS NULL").drop("error") if strict else out


def path_parts(path: Column, root: str) -> Column:
    """struct(country, provider) of `root/country/provider/...`; NULL where the path is not of that form."""
    tail = F.regexp_extract(path, rf"{root.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/([^/]+)/[^/]+$", 0)
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return F.when(tail != "", F.struct(F.lower(F.regexp_extract(path, rf"{name}/([^/]+)/([^/]+)/[^/]+$", 1)).alias("country"), F.lower(F.regexp_extract(path, rf"{name}/([^/]+)/([^/]+)/[^/]+$", 2)).alias("provider")))


def path_jurisdiction(path: Column, kind: str) -> Column:
    """A regulation's folder names its jurisdiction, or it is an error; research may have one of two."""
    found = F.lower(F.regexp_extract(path, rf"/{kind}s?/([^/]+)/", 1))
    if kind == "regulation":
        return F.when(found == "", F.raise_error(F.concat(F.lit("no jurisdiction in "), path)).cast("string")).otherwise(found)
    return F.when(found.isin("italy", "ireland"), found)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file a session; files that cannot be read have only _corrupt_record."""
    return spark.read.schema(SESSION).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)


def interaction_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("timestamp string, request_id string, kind string, model string, prompt string, response string, duration_ms double").json(folder)


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a cache table, keyed by content, has of what is wanted; and what it lacks."""
    return wanted.join(cache, keys), wanted.join(cache.select(*keys), keys, "left_anti")


def figi(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows with ticker and figi_name by ISIN, of twelve characters; a mapping row without ticker is a known miss."""
    known = mapping.select(F.upper("isin").alias("_isin"), "ticker", F.col("name").alias("figi_name")).dropDuplicates(["_isin"])
    return rows.join(known, F.when(F.length(F.trim("isin")) == 12, F.upper(F.trim("isin"))) == F.col("_isin"), "left").drop("_isin")


def isins_to_ask(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """ISINs of twelve characters that the mapping has neither as hits nor as known misses."""
    isin = F.upper(F.trim("isin"))
    return rows.select(isin.alias("isin")).where(F.length("isin") == 12).distinct().join(mapping.select(F.upper("isin").alias("isin")), "isin", "left_anti")


#: What reads a kind of document: more may be put in.
READERS: dict[str, Callable[..., DataFrame]] = {"markdown": markdown, "broker_statement": broker_statement, "binary": binary, "sessions": sessions, "pages": parsed_pages}
