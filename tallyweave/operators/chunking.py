"""Documents into sentences, children, parents and windows, a document at a time on the executors.

A sentence splitter and an encoder may be passed in; without them sentences end
at punctuation and chunks carry no vectors.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHILD, PARENT, ENCODED = 1400, 3000, 8000
PAGES_TOGETHER = 5
Span = tuple[int, int]
_END = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n")


def sentences(text: str) -> list[Span]:
    """Start and end of each sentence: up to punctuation before a blank, or to an empty line."""
    out, start = [], 0
    for stop in [*(m.end() for m in _END.finditer(text)), len(text)]:
        piece = text[start:stop]
        first = stop - len(piece.lstrip())
        last = start + len(piece.rstrip())
        if first < last:
            out.append((first, last))
        start = stop
    return out


def packed(lengths: list[int], most: int) -> list[Span]:
    """Runs of items, each as long as it can be within most; an item that is longer stands alone."""
    out, first, total = [], 0, 0
    for k, n in enumerate(lengths):
        if total + n > most and k > first:
            out.append((first, k))
            first, total = k, 0
        total += n
    return [*out, (first, len(lengths))] if lengths else out


def parents(children: list[Span], most: int) -> list[Span]:
    """What of its neighbourhood fits around each child: as many on its left as on its right, then on the left or else on the right what still fits.

    A wider neighbourhood is never shorter, so each of the three widths is found by bisection.
    """
    starts, ends, out = [a for a, _ in children], [b for _, b in children], []
    for k in range(len(children)):
        sides = range(1, min(k, len(children) - 1 - k) + 1)
        even = bisect_right(sides, most, key=lambda n, k=k: ends[k + n] - starts[k - n])
        left, right = min(k - even, bisect_left(starts, ends[k + even] - most)), k + even
        if left == k - even:
            right = max(right, bisect_right(ends, starts[left] + most) - 1)
        out.append((starts[left], ends[right]))
    return out


def chunked_text(text: str, split: Callable[[str], list[Span]] = sentences, child: int = CHILD, parent: int = PARENT, window: int = ENCODED) -> list[tuple[Span, Span, int]]:
    """For each child: its span, its parent's span, the number of the encoder window that it is in."""
    spans = split(text)
    children = [(spans[a][0], spans[b - 1][1]) for a, b in packed([e - s for s, e in spans], child)]
    windows = packed([e - s for s, e in children], window)
    of = [w for w, (a, b) in enumerate(windows) for _ in range(a, b)]
    return list(zip(children, parents(children, parent), of, strict=True))


#: Characters of chunks that leave a task together.
TOGETHER = 4 << 20


def late_chunks(docs: DataFrame, key: str = "document_sha", text: str = "text", split: Callable[[str], list[Span]] = sentences, encode: Callable[[str, list[Span]], np.ndarray] | None = None) -> DataFrame:
    """(key, chunk_index, start, stop, text_content, parent_text_content, window, embedding) of every document.

    encode(window text, spans in it) gives a vector for each child of a window, so that a child is encoded with what stands around it.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "chunk_index", "start", "stop", "text_content", "parent_text_content", "window", "embedding"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32())]

    def vectors(t: str, rows: list[tuple[Span, Span, int]]) -> list:
        out: list = []
        for _, group in groupby(rows, key=lambda r: r[2]):
            own = [r[0] for r in group]
            start, stop = own[0][0], own[-1][1]
            out += [[float(x) for x in v] for v in encode(t[start:stop], [(a - start, b - start) for a, b in own])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            held, of, size = [], [], 0
            for k in range(batch.num_rows):
                t = texts[k].as_py() or ""
                rows = chunked_text(t, split)
                told = vectors(t, rows) if encode else [None] * len(rows)
                held += [(i, c[0], c[1], t[c[0] : c[1]], t[p[0] : p[1]].strip(), w, v) for i, ((c, p, w), v) in enumerate(zip(rows, told, strict=True))]
                of += [k] * len(rows)
                size += sum(p[1] - p[0] + c[1] - c[0] for c, p, _ in rows)
                if size > TOGETHER and k < batch.num_rows - 1:
                    yield told_batch(keys, held, of)
                    held, of, size = [], [], 0
            if held:
                yield told_batch(keys, held, of)

    def told_batch(keys: pa.Array, held: list[tuple], of: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), *(pa.array(x, y) for x, y in zip(zip(*held, strict=True), types, strict=True))], names)

    schema = f"{key} {kind}, chunk_index int, start int, stop int, text_content string, parent_text_content string, window int, embedding array<float>"
    return docs.select(key, text).mapInArrow(run, schema)


def page_batches(pages: DataFrame, key: str = "document_sha", joint: str = "\n\n", together: int = PAGES_TOGETHER) -> DataFrame:
    """(key, batch, text, ranges) of pages (key, page_number, text): their texts joined, and where each page lies, end exclusive."""
    order = Window.partitionBy(key).orderBy("page_number")
    placed = pages.withColumn("batch", F.floor((F.row_number().over(order) - 1) / together).cast("int"))
    held = placed.groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    ranges = F.aggregate(
        "p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page_number:int,start:int,stop:int>>").alias("r")),
        lambda a, x: F.struct((a["at"] + F.length(x["text"]) + len(joint)).alias("at"), F.concat(a["r"], F.array(F.struct(x["page_number"].cast("int").alias("page_number"), a["at"].alias("start"), (a["at"] + F.length(x["text"])).alias("stop")))).alias("r")),
        lambda a: a["r"],
    )
    return held.select(key, "batch", F.array_join(F.transform("p", lambda x: x["text"]), joint).alias("text"), ranges.alias("ranges"))


def page_of(ranges: Column, offset: Column) -> Column:
    """The first page whose range, end included, holds an offset; an error if none does."""
    found = F.filter(ranges, lambda r: (r["start"] <= offset) & (offset <= r["stop"]))
    return F.when(F.size(found) > 0, found[0]["page_number"]).otherwise(F.raise_error(F.concat(F.lit("no page holds offset "), offset.cast("string"))).cast("int"))
