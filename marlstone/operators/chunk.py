"""Chunking: fixed strides inside the JVM, paragraphs and sentences by Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, in characters: length from which a text is long, chunk sizes of short and long texts, overlap.
LONG_TEXT, SHORT_CHUNK, LONG_CHUNK, OVERLAP = 3000, 2048, 4096, 400
SCHEMA = "id string, doc_id long, text string, chunk_index int, total_chunks int, char_start int, char_end int"


def chunk_size(length):
    return F.when(length < LONG_TEXT, SHORT_CHUNK).otherwise(LONG_CHUNK)


def stride_chunks(docs: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of the text's size, each starting ``overlap`` characters before the last one's end."""
    n, size = F.length("text"), chunk_size(F.length("text"))
    last = F.greatest(F.ceil((n - overlap) / (size - overlap)) - 1, F.lit(0)).cast("int")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: i * (size - overlap)))
    each = docs.where("text is not null and text != ''").select("doc_id", "text", size.alias("size"), F.size(starts).alias("total_chunks"), F.posexplode(starts).alias("chunk_index", "char_start"))
    piece = F.substring(F.col("text"), F.col("char_start") + 1, F.col("size"))
    return each.select(
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("id"),
        "doc_id",
        piece.alias("text"),
        "chunk_index",
        "total_chunks",
        "char_start",
        (F.col("char_start") + F.length(piece)).alias("char_end"),
    )


def pack(text: str, size: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of chunks: paragraphs packed up to size, each chunk reaching ``overlap`` back; oversize paragraphs are cut."""
    if len(text) <= size:
        return [(0, len(text))] if text else []
    spans: list[tuple[int, int]] = []
    start = end = None
    for m in re.finditer(r"\S(?:(?!\n\s*\n).)*", text, re.S):
        a, b = m.start(), m.end()
        if start is not None and b - start > size:
            spans.append((start, end))
            start = max(end - overlap, start + 1)
            if b - start > size:
                start = None
        if start is None:
            start = a
        end = b
        if end - start > size * 1.5:
            cut = force_split(text[start:end], size, overlap)
            spans += [(start + x, start + y) for x, y in cut[:-1]]
            start, end = start + cut[-1][0], start + cut[-1][1]
    if start is not None:
        spans.append((start, end))
    return spans


def force_split(text: str, size: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most size that end at a sentence in their second half if there is one; the last ends the text."""
    stops = [m.end() for m in re.finditer(r"\.(?= )", text)]
    bounds = [0]  # starts and ends in turn
    while bounds[-1] + size < len(text):
        start = bounds[-1]
        last = bisect_left(stops, start + size) - 1
        end = stops[last] if last >= 0 and stops[last] > start + size // 2 else start + size
        bounds += [end, max(start + 1, end - overlap)]
    bounds.append(len(text))
    return list(zip(bounds[::2], bounds[1::2]))


def chunk_corpus(docs: DataFrame) -> DataFrame:
    """Paragraph-aware chunks of (doc_id, text), with exact offsets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                spans = pack(text, SHORT_CHUNK if len(text) < LONG_TEXT else LONG_CHUNK) if text else []
                rows += [(doc_id, text[a:b], i, len(spans), a, b) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "chunk_index", "total_chunks", "char_start", "char_end"])

    cut = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string, chunk_index int, total_chunks int, char_start int, char_end int")
    return cut.select(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("id"), "*")
