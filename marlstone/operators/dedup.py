"""Corpus deduplication: corrupted texts, exact copies, near copies among neighbours of a length bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.llm.common import in_arrow
from marlstone.sources.shared import kept

# Characters of a length bucket, following rows that a row is compared with, similarity, shingle size.
BUCKET, NEIGHBOURS, SIMILAR, SHINGLE = 200, 19, 0.85, 5
#: Characters of a block of neighbours, and bits of a character in a packed shingle.
BLOCK, BITS = 8_000_000, 12


def corrupted(docs: DataFrame) -> DataFrame:
    return docs.where(tx.is_corrupted(F.col("text")))


def exact(docs: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each text by key. Rows that agree in text and key are one row."""
    hashed = docs.withColumn("h__", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    first = hashed.groupBy("h__").agg(F.min(key).alias(key))
    return hashed.join(first, ["h__", key], "left_semi").dropDuplicates(["h__", key]).drop("h__")


def _shingles(text: str, others: dict[str, int]) -> np.ndarray:
    """The distinct shingles of a text as sorted numbers, equal just where the shingles are. Five characters of 12 bits
    make 60; a shingle with a later character has its number from others."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c = np.concatenate([c + np.uint64(1), np.zeros(max(SHINGLE - len(c), 0), np.uint64)])  # a shorter text is one shingle
    n = len(c) - SHINGLE + 1
    packed = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        packed = packed << np.uint64(BITS) | c[i : i + n]
    late = c >= 1 << BITS
    if late.any():
        so_far = np.concatenate([[0], np.cumsum(late)])
        for i in np.flatnonzero(so_far[SHINGLE:] > so_far[:-SHINGLE]).tolist():
            packed[i] = 1 << 63 | others.setdefault(text[i : i + SHINGLE], len(others))
    return np.unique(packed)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two runs: a merge
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _compared(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (bucket, block, own, rank, key, text), sorted by the first two and rank: each with the own rows
    of its block that are at most NEIGHBOURS before it.

    Shingles fall into bins by a hash; the sum of the lesser counts of each bin bounds what two sets share from
    above, so that only pairs that this bound lets pass are compared in full.
    """
    group, at, sets, keys = None, np.zeros(NEIGHBOURS, np.int64), [], []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        out: list[tuple] = []
        for bucket, block, own, rank, key, text in zip(*columns):
            if (bucket, block) != group:
                group, others = (bucket, block), {}
                width = max(6, (BUCKET * (bucket + 1) // 8).bit_length())
                bins, sizes = np.zeros((NEIGHBOURS, 1 << width), np.int32), np.zeros(NEIGHBOURS, np.int64)
                at[:], sets, keys = -NEIGHBOURS - 1, [None] * NEIGHBOURS, [None] * NEIGHBOURS
            near = np.flatnonzero(at >= rank - NEIGHBOURS)
            if not own and not len(near):
                continue
            x = _shingles(text, others)
            mine = np.bincount(((x * np.uint64(0x9E37_79B9_7F4A_7C15)) >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width).astype(np.int32)
            if len(near):
                most = np.minimum(bins[near], mine).sum(axis=1, dtype=np.int64)
                for i in near[most >= SIMILAR * (sizes[near] + len(x) - most) - 1e-6].tolist():
                    k = _common(sets[i], x)
                    jaccard = k / (len(sets[i]) + len(x) - k)
                    if jaccard >= SIMILAR:
                        out.append((bucket, keys[i], key, jaccard))
            if own:
                i = rank % NEIGHBOURS
                at[i], sets[i], keys[i], bins[i], sizes[i] = rank, x, key, mine, len(x)
        if out:
            kind = batch.schema.field(4).type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), kind, kind, pa.float64()))], names)


def _ranks(rows: DataFrame, key: str) -> DataFrame:
    """(uid, rank) of rows (uid, key, bucket): the place in key order within the bucket, from 0. Counted within ranges
    of rows, with what lies before each range, so no task has a whole bucket."""
    order = [F.asc_nulls_last(key), F.col("uid")]
    ranges = kept(rows.repartitionByRange("bucket", *order).withColumn("part", F.spark_partition_id()))
    w = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = ranges.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")).select("bucket", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("bucket", "part").orderBy(*order))
    return ranges.join(before, ["bucket", "part"]).select("uid", (within - 1 + F.col("before")).alias("rank"))


def _pairs(docs: DataFrame, key: str) -> DataFrame:
    """(bucket, a, b, jaccard) of near_pairs."""
    text = tx.stripped(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = kept(docs.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("uid"), key, F.floor(F.length("text") / BUCKET).alias("bucket"), text.alias("t")))
    per = F.greatest(F.lit(2 * NEIGHBOURS), F.least(F.lit(1024), F.floor(F.lit(BLOCK) / (BUCKET * (F.col("bucket") + 1))))).cast("long")
    placed = rows.join(_ranks(rows.select("uid", key, "bucket"), key), "uid").withColumn("per", per).withColumn("home", F.floor(F.col("rank") / F.col("per")))
    # The first rows of a block are the last neighbours of the block before it.
    blocks = F.when((F.col("home") > 0) & (F.col("rank") % F.col("per") < NEIGHBOURS), F.array(F.col("home"), F.col("home") - 1)).otherwise(F.array("home"))
    dealt = placed.withColumn("block", F.explode(blocks)).select("bucket", "block", (F.col("block") == F.col("home")).alias("own"), "rank", key, "t")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("a", kind), T.StructField("b", kind), T.StructField("jaccard", T.DoubleType())])
    return in_arrow(dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "rank"), lambda batches: _compared(batches, schema.names), schema)


def near_pairs(docs: DataFrame, key: str = "id") -> DataFrame:
    """(a, b, jaccard): pairs of near copies; b is one of the next NEIGHBOURS rows of a's length bucket in key order.

    Buckets are cut into blocks of rows that follow each other; a block has the
    first neighbours of the next one too, and walks its rows in order.
    """
    return _pairs(docs, key).select("a", "b", "jaccard")


def near_dups(docs: DataFrame, key: str = "id") -> DataFrame:
    """Keys of rows that repeat an earlier row which itself stays, decided in key order.

    Only keys of pairs that are similar enough meet; those of one bucket are
    resolved in one group.
    """

    def resolve(table: pa.Table) -> pa.Table:
        gone: set = set()
        for a, b in sorted(zip(table["a"].to_pylist(), table["b"].to_pylist())):
            if a not in gone:
                gone.add(b)
        return pa.table([pa.array(sorted(gone), table.schema.field("b").type)], [key])

    pairs = _pairs(docs, key).select("bucket", "a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return pairs.groupBy("bucket").applyInArrow(resolve, T.StructType([T.StructField(key, docs.schema[key].dataType)]))


def _steps(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """docs without corrupted rows, and then without exact copies; each worked out once."""
    sound = kept(docs.where(~tx.is_corrupted(F.col("text"))))
    return sound, kept(exact(sound, key))


def deduplicate(docs: DataFrame, key: str = "id") -> DataFrame:
    """docs without corrupted rows, then without exact, then without near copies."""
    first = _steps(docs, key)[1]
    return first.join(near_dups(first, key), key, "left_anti")


def counts(docs: DataFrame, key: str = "id") -> DataFrame:
    """(step, removed) of the three steps."""
    sound, first = _steps(docs, key)
    n = [x.count() for x in (docs, sound, first)]
    return docs.sparkSession.createDataFrame([("corrupted", n[0] - n[1]), ("exact", n[1] - n[2]), ("near", near_dups(first, key).count())], "step string, removed long")
