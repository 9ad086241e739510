"""Tables to files: pages, logs, sessions."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folder_key


def export_pages(pages: DataFrame, folder: str) -> None:
    """pages (jurisdiction, document, page_number, text) as text, a folder for each jurisdiction, document and page, under a header line."""
    rows = pages.select(
        F.coalesce("jurisdiction", F.lit("none")).alias("jurisdiction"), folder_key(F.col("document")).alias("document"), F.col("page_number").alias("page"),
        F.concat(F.lit("# "), F.col("document"), F.lit(", page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.col("text")).alias("value"),
    )
    rows.write.mode("overwrite").partitionBy("jurisdiction", "document", "page").text(folder)


def export_page_files(pages: DataFrame, folder: str) -> int:
    """pages (jurisdiction, document, page_number, text) as `{jurisdiction}/{document}/page_N.md` under a folder that all executors reach; how many.

    A page is written whole under its own name, so a task that is run again leaves the same files.
    """
    rows = pages.select(
        F.concat_ws("/", F.coalesce("jurisdiction", F.lit("none")), folder_key(F.col("document")), F.concat(F.lit("page_"), F.col("page_number").cast("string"), F.lit(".md"))).alias("path"),
        F.concat(F.lit("# "), F.col("document"), F.lit(", page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("value"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                files.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{root}/{path}") as out:
                    out.write(value.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_log(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def log_text(rows: DataFrame) -> DataFrame:
    """Log rows as text, a block each: when, what and who, then the question and the answer."""
    head = F.concat_ws(" ", F.concat(F.lit("["), F.col("timestamp"), F.lit("]")), "kind", "model", "request_id")
    return rows.select(F.concat_ws("\n", head, F.concat(F.lit("> "), F.coalesce("prompt", F.lit(""))), F.concat(F.lit("< "), F.coalesce("response", F.lit(""))), F.lit("")).alias("value"))


def save_sessions(sessions: DataFrame, folder: str) -> None:
    """Each session in place of what the folder has under its id; other sessions stay."""
    rows = sessions.drop("_corrupt_record").withColumn("session", F.col("id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").json(folder)


def delete_sessions(sessions: DataFrame, ids: list[str]) -> DataFrame:
    """sessions without those of these ids."""
    return sessions.where(~F.coalesce(F.col("id").isin(ids), F.lit(False)))


def config(defaults: Mapping[str, object], user: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None, given: Mapping[str, object] | None = None, prefix: str = "TALLYWEAVE_") -> dict[str, object]:
    """Settings: what is given, else the environment, else the user's file, else the default; a default's type is kept."""
    environment = os.environ if environment is None else environment
    out = {}
    for name, default in defaults.items():
        value = (given or {}).get(name)
        if value is None:
            value = environment.get(prefix + name.upper())
        if value is None:
            value = (user or {}).get(name)
        if value is None:
            value = default
        elif isinstance(default, bool) and isinstance(value, str):
            value = value.strip().lower() in ("1", "true", "yes", "on")
        elif default is not None and not isinstance(value, type(default)):
            value = type(default)(value)
        out[name] = value
    return out


def saved_settings(path: str) -> dict[str, object]:
    """The user's own settings; none where there is no file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def save_settings(path: str, defaults: Mapping[str, object], **changes: object) -> dict[str, object]:
    """The user's settings with changes, written as a whole; None takes a setting back to its default, and only known names may be set."""
    unknown = sorted(set(changes) - set(defaults))
    if unknown:
        raise KeyError(f"no such settings: {unknown}")
    held = {k: v for k, v in (saved_settings(path) | changes).items() if v is not None}
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(held, f, indent=2, sort_keys=True)
    os.replace(f"{path}.new", path)
    return held


def reset_settings(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)
