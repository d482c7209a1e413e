"""Overlapping chunks of texts, cut at paragraph, sentence or line ends; offsets are code points of the cleaned text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import packed, rows_of
from tessera.functions.text import clean_text

# fixed values: sentence ends, in the order in which they are tried
ENDINGS = (". ", "。", "！", "？", "! ", "? ", "；", ";")


def cut_end(text: str, start: int, size: int) -> int:
    """Where a chunk that starts here ends: a boundary in its second half, or its full size."""
    end, half = start + size, start + size // 2
    if (at := text.rfind("\n\n", start, end)) > half:
        return at + 2
    best = end
    for ending in ENDINGS:
        if (at := text.rfind(ending, start, end)) > half:
            best = at + len(ending)
            break
    if best == end and (at := text.rfind("\n", start, end)) > half:
        return at + 1
    return best


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk of a cleaned text. A next start that doesn't get past the last one is the chunk's end instead."""
    if len(text) <= size:
        yield 0, len(text)
        return
    start, last = 0, -1
    while start < len(text):
        if start + size >= len(text):
            if text[start:].strip():
                yield start, len(text)
            return
        end = cut_end(text, start, size)
        if text[start:end].strip():
            yield start, end
            last = start
        start = end - overlap if end - overlap > max(last, start) else end


def _chunks(batches: Iterable[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The chunks of texts (key, text), handed on a few at a time."""
    for b in batches:
        schema = pa.schema([b.schema.field("key"), ("chunk_index", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("content", pa.string())])
        yield from packed(((key, i, s, e, text[s:e]) for key, text in rows_of(b) for i, (s, e) in enumerate(spans(text, size, overlap))), schema)


def chunk(docs: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """key, chunk_index, start_char, end_char, content. Empty and null texts give none. A narrow map over Arrow batches."""
    if not 100 <= size <= 2000 or not 0 <= overlap <= 500:
        raise ValueError("size must be from 100 to 2000, overlap from 0 to 500")
    kind = dict(docs.dtypes)[key]
    cleaned = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), clean_text(F.col(text)).alias("text"))
    return cleaned.mapInArrow(lambda it: _chunks(it, size, overlap), f"key {kind}, chunk_index int, start_char int, end_char int, content string").withColumnRenamed("key", key)
