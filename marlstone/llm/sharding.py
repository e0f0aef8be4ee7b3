"""Two-pass external shuffle into shards, with DataFrame operations only.

Pass 1 scatters whole records uniformly into buckets that fit a task's memory,
by a seeded hash of the record. Pass 2 permutes each bucket by Fisher-Yates, lays
the buckets end to end, which gives every record its place in one random order
of the whole table, and writes them. Shard s of n takes places ceil(s*N/n) to
ceil((s+1)*N/n)-1, so counts differ by one at most (law ``rows``), each bucket
goes to one or two shards, and slots have no gaps.

The order depends on seed and records only, not on partitions or files: each
bucket's permutation is drawn in a fixed order of buckets (``permutations``) and
stored, and the records of a bucket are ranked by their hash before. Records that are equal in every column
are told apart by a running number. They are counted before they shuffle, so a
record that is repeated very often is one row a task until its copies are dealt
out, each by its number, over all buckets.

Nulls: a null text has size 1 and the crc32 of the empty text; a null doc_id is
an ordinary record. An empty table gives no rows. Other columns travel with
their record, whatever their names, but for ``shard`` and ``slot``, which are
replaced. Map columns are not hashed: records that differ in these only are told
apart by nothing, and may change places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, read, scratch_dir, stored, text_or_empty

#: Mean rows of a bucket, and mean bytes of text: whichever gives more buckets.
BUCKET_ROWS, BUCKET_BYTES = 8192, 32 << 20
#: Buckets whose place is counted together, copies of a record dealt out at once, and buckets of a task that draws permutations.
BLOCK, DRAWN = 1024, 128


def permutations(buckets: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """buckets (b, rows, first) with ``perm``: Fisher-Yates (Spark's ``shuffle``) on the places 0 to rows - 1.

    Spark seeds a partition's generator by its number and draws for row after row.
    Here a bucket's partition and its place there follow from the bucket alone, so
    its permutation does not depend on how buckets came to be dealt out.
    """
    dealt = buckets.repartition(-(-n_buckets // DRAWN), "b").sortWithinPartitions("b")
    return stored(dealt.select("*", F.shuffle(F.sequence(F.lit(0), F.col("rows").cast("int") - 1), seed).alias("perm")))


def _numbered(docs: DataFrame, seed: int, hash_: str, copy: str) -> DataFrame:
    """docs with a seeded hash of each record and, among equal records, a running number from 0."""
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumn(hash_, F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in plain)))
    times = keyed.groupBy(hash_).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(hash_)
    times = stored(times)
    if times.isEmpty():
        return keyed.withColumn(copy, F.lit(0).cast("long"))
    alone = keyed.join(times, hash_, "left_anti").withColumn(copy, F.lit(0).cast("long"))
    every = keyed.join(times, hash_, "left_semi")
    if len(plain) < len(docs.columns):
        number = F.row_number().over(W.partitionBy(hash_).orderBy(*(F.col(f"`{c}`") for c in plain))) - 1
        return alone.unionByName(every.withColumn(copy, number.cast("long")))
    # Equal records become one row with their number, then that many rows, in two steps.
    counted = every.groupBy(*(F.col(f"`{c}`") for c in every.columns)).agg(F.count(F.lit(1)).alias(copy))
    blocks = counted.withColumn(copy, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copy) - 1) / BLOCK)), lambda b: F.struct((b * BLOCK).alias("low"), F.least((b + 1) * BLOCK, F.col(copy)).alias("high")))))
    dealt = blocks.repartition(F.col(hash_), F.col(copy)["low"])
    return alone.unionByName(dealt.withColumn(copy, F.explode(F.sequence(F.col(copy)["low"], F.col(copy)["high"] - 1))))


def shuffle_into_shards(docs: DataFrame, n_shards: int = 16, seed: int = 42, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs in a random order: its columns, ``shard`` and ``slot``."""
    docs = docs.drop("shard", "slot")
    hash_, copy, bucket, rank, perm, first, place = (fresh(docs, x) for x in ("hash", "copy", "bucket", "rank", "perm", "first", "place"))
    total, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_or_empty()).cast("long")), F.lit(0))).first()
    n_buckets = max(1, -(-total // bucket_rows), -(-size // bucket_bytes))
    numbered = _numbered(docs, seed, hash_, copy)
    scattered = numbered.withColumn(bucket, F.pmod(F.xxhash64(hash_, copy), F.lit(n_buckets)))
    # One row per bucket: its row count, the place of its first row and the permutation of its rows.
    counts = stored(scattered.groupBy(F.col(bucket).alias("b")).agg(F.count(F.lit(1)).alias("rows")))
    block = F.floor(F.col("b") / BLOCK)
    blocks = counts.groupBy(block.alias("block")).agg(F.sum("rows").alias("n"))
    # One row per 1024 buckets, i.e. per 8 million records, meets in one task here.
    starts = blocks.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("start"))
    placed_buckets = counts.withColumn("block", block).join(starts, "block").select("b", "rows", (F.col("start") + F.sum("rows").over(W.partitionBy("block").orderBy("b")) - F.col("rows")).alias("first"))
    perms = permutations(placed_buckets, n_buckets, seed).select(F.col("b").alias(bucket), F.col("first").alias(first), F.col("perm").alias(perm))
    ranked = scattered.withColumn(rank, F.row_number().over(W.partitionBy(bucket).orderBy(hash_, copy, "doc_id")))
    placed = ranked.join(perms, bucket).withColumn(place, F.col(first) + F.get(F.col(perm), F.col(rank) - 1))
    # shard = floor(place * n / N); the shard's first place is ceil(shard * N / n).
    n, rows = F.lit(n_shards), F.lit(max(total, 1))
    shard = F.floor(F.col(place) * n / rows) if total * n_shards < 2**52 else F.expr(f"{place} * {n_shards} div {max(total, 1)}")
    low = F.floor((F.col("shard").cast("long") * rows + n - 1) / n) if total * n_shards < 2**52 else F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col(place) - low.cast("long")).select(*(f"`{c}`" for c in docs.columns), "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes Parquet, a folder per shard, each file in the order of its slots."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffle_into_shards(read(spark, sf_dir, "documents"))
    path = scratch_dir(spark)
    write_shards(sharded, path)
    out = spark.read.schema(sharded.schema).parquet(path)
    text = text_or_empty().cast("binary")
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
