"""Exact deduplication in two passes of Bloom filtering.

Pass 1 sets, for each text's hash, a bit in each of K bit arrays and notes the
bits that are set twice. Tasks send positions only (at most two of each), cut
into segments; a segment's owner counts them and keeps one bit per position
that was set more than once. A hash all of whose K bits were set more than once
may be repeated; any other hash certainly is not.

Pass 2 tests every row against these bits. Rows that can't be repeated pass
straight through as groups of their own. Only the rest shuffle, as narrow rows
without text, by the SHA-256 of the normalised text.

The filter has between 2**16 and 2**28 bits an array (64 MB for two arrays at
most, whatever the corpus): about 32 for each row until the bound is met, after
which it lets more rows shuffle and the result stays the same.

Equality: texts without the characters ``[\\x20\\x09-\\x0D]``. Null counts as the
empty text, so null, empty and blank texts form one group. The row with the
most code points in its original text stays, then the smallest doc_id (null
last); of rows that agree in both, all but one count as dropped. An empty table
gives no rows. Other columns are ignored by ``dedup_decisions`` and kept by
``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, parts_of, read, stored, without

K = 2
SEGMENT_BITS = 16
#: Bytes of text that are worked on at once.
CHUNK = 4 << 20
BLANK = b" \t\n\x0b\x0c\r"


def digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode().translate(None, BLANK)).digest()


def filter_bits(rows: int) -> int:
    """log2 of the bits of one array."""
    return min(28, max(SEGMENT_BITS, int(rows * 32 - 1).bit_length()))


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """A row for each of the K arrays."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :K]
    return np.ascontiguousarray((words >> np.uint64(64 - bits)).T.astype(np.int64))


def repeated_bits(docs: DataFrame, rows: int) -> tuple[Broadcast, int]:
    """Pass 1: the bits that were set more than once, packed, as a broadcast of K * 2**bits bits."""
    bits = filter_bits(rows)
    spark = docs.sparkSession
    width = 1 << SEGMENT_BITS

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole, 0, CHUNK)):
            p = _positions([digest(t) for t in batch.column(0).to_pylist()], bits)
            flat = np.sort((p + (np.arange(K) << bits)[:, None]).ravel())
            third = np.r_[False, False, flat[2:] == flat[:-2]] if len(flat) > 2 else np.zeros(len(flat), bool)
            flat = flat[~third]  # two of each say enough
            segments, starts = np.unique(flat >> SEGMENT_BITS, return_index=True)
            parts = np.split((flat & (width - 1)).astype("<u2"), starts[1:])
            yield pa.RecordBatch.from_arrays([pa.array(segments.astype(np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["segment", "positions"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(np.frombuffer(raw, "<u2"), minlength=width)
                seen = once.setdefault(segment, np.zeros(width, np.uint8))
                np.minimum(seen + n, 2, out=n)
                seen[:] = n
        packed = {s: np.packbits(c > 1).tobytes() for s, c in once.items() if (c > 1).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary())], ["segment", "bits"])

    n_segments = K << (bits - SEGMENT_BITS)
    sent = in_arrow(docs.select("text"), positions, "segment int, positions binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = in_arrow(sent.repartition(min(n_segments, max(parts, 8)), "segment"), count, "segment int, bits binary")
    table = np.zeros(n_segments * width // 8, np.uint8)
    for row in merged.toLocalIterator():  # one partition of the bounded filter at a time
        at = row.segment * width // 8
        table[at : at + width // 8] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(table), bits


def hashed(docs: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """Pass 2: the columns given, and ``sha__`` (binary), ``chars__`` and ``maybe__``."""
    table, bits = repeated_bits(docs, rows)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("sha__", T.BinaryType()), T.StructField("chars__", T.LongType()), T.StructField("maybe__", T.BooleanType())])
    at = [*columns, "text"].index("text")
    # The column names of a batch may clash, so columns go by position.
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = table.value
        for batch in (part for whole in batches for part in parts_of(whole, at, CHUNK)):
            texts = batch.column(at).to_pylist()
            digests = [digest(t) for t in texts]
            p = _positions(digests, bits) + (np.arange(K) << bits)[:, None] if digests else np.zeros((K, 0), np.int64)
            maybe = ((bitmap[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=0)
            arrays = [batch.column(i) for i in range(len(columns))] + [pa.array(digests, pa.binary()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(maybe)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return in_arrow(given, test, schema)


def dedup_decisions(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(hashed(docs.select("doc_id", "text"), ["doc_id"], docs.count()).withColumn("row__", F.monotonically_increasing_id()))
    sha = F.lower(F.hex("sha__")).alias("text_sha256")
    single = rows.where("not maybe__").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    maybe = rows.where("maybe__")
    best = F.struct((-F.col("chars__")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"), F.col("row__").alias("row"))
    # Stored, so that both sides of the join come straight from an exchange and Spark can split a hot group.
    groups = stored(maybe.groupBy("sha__").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best__")))
    joined = maybe.join(groups, "sha__").select("doc_id", F.col("best__.id").alias("keep_id"), "group_size", (F.col("row__") == F.col("best__.row")).alias("kept"), sha)
    return single.unionByName(joined)


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat another's text, with its own columns.

    Decided on rows without text; of the texts only those move that may go or that have a twin in doc_id and text.
    """
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    maybe = hashed(narrow, ["doc_id", "text_hash"], docs.count()).where("maybe__")
    # Stored, so that both sides of the join come straight from an exchange and Spark can split a hot group.
    kinds = stored(maybe.groupBy("sha__", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"), F.max("chars__").alias("chars")))
    best = F.struct((-F.col("chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    least = stored(kinds.groupBy("sha__").agg(F.min(best).alias("best")))
    asked = kinds.join(least, "sha__").select("doc_id", "text_hash", (best == F.col("best")).alias("stays"), "times")
    return without(docs, asked.where("not stays or times > 1"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_decisions(read(spark, sf_dir, "documents"))
