"""Helpers shared by the corpus operators.

Every operator reads a DataFrame with at least ``doc_id`` and ``text`` (any
further columns are ignored unless it says otherwise) and never relies on
``doc_id`` being unique or present: work that spans two passes is keyed by the
pair (``doc_id``, 64-bit hash of the text), so rows that agree in both get
equal results.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper to lower case, as a bytes.translate table.
LOWER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the shared one that ``spark.checkpoint.dir`` names.

    Where that setting is absent (tests, one machine) a temporary folder is set
    as the checkpoint directory first. The folder goes when the JVM ends.
    """
    root = shared_dir(spark)
    path = f"{root}/table-{uuid.uuid4().hex}"
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, with as many underscores as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the
    lineage, survives lost executors, and is compressed, unlike a checkpoint."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_by(rows: DataFrame, column: str, wanted: DataFrame, hash_column: str) -> tuple[DataFrame, DataFrame]:
    """rows whose 64-bit hash may be among the wanted ones, and the rest, of which none is.

    A Bloom filter of one bit a hash, built and tested by SQL functions only: one
    broadcast row of 2**16 to 2**26 bits (8 MB at most), 32 for each wanted hash
    until that bound is met. What passes is joined with wanted, so a fuller filter
    costs time only; the rest, most often nearly all rows, needs no shuffle.
    """
    bits = min(26, max(16, int(32 * max(wanted.count(), 1) - 1).bit_length()))
    high = F.shiftrightunsigned(F.col(hash_column), 64 - bits)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hash_column}, {64 - bits}) & 63 as int))")
    words = wanted.where(F.col(hash_column).isNotNull()).select(F.shiftright(high, 6).alias("id"), mask.alias("m")).groupBy("id").agg(F.bit_or("m").alias("m"))
    every = rows.sparkSession.range(1 << (bits - 6)).join(words, "id", "left")
    held = fresh(rows, "bits")
    one = stored(every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("m", F.lit(0).cast("long")).alias("m"))))["m"].alias(held)))
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    may = F.coalesce(F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    both = rows.crossJoin(F.broadcast(one))  # one row of bounded size
    return both.where(may).drop(held), both.where(~may).drop(held)


def without(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """docs less the rows that asked (doc_id, text_hash, stays) names, each pair once, with the columns of docs.

    Rows whose pair has ``stays`` false go; of rows whose pair has it true one stays. Only rows that may be asked
    about, by their hash, move; twins are made one by tasks for their own rows before they do.
    """
    columns = [f"`{c}`" for c in docs.columns]
    hash_, d, h, stays = (fresh(docs, x) for x in ("hash", "d", "h", "stays"))
    asked = stored(asked.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("stays").alias(stays)))
    some, rest = split_by(docs.withColumn(hash_, F.xxhash64("text")), hash_, asked, h)
    met = some.join(asked, (F.col(hash_) == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(d)), "left").where(F.coalesce(stays, F.lit(True)))
    one = met.where(F.col(stays).isNotNull()).dropDuplicates([d, h])
    alone = met.where(F.col(stays).isNull())
    return rest.select(*columns).unionByName(alone.select(*columns)).unionByName(one.select(*columns))


#: Bounds of an Arrow batch that goes to a Python worker; Spark's own would let a batch of long texts fill its memory.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in bounded batches (the session's bounds are lowered where they are larger); what a worker has
    allocated for a task goes back to the system when the task ends, as workers are kept."""
    conf = df.sparkSession.conf
    for name, most in BATCH_BOUNDS.items():
        now = int(re.sub(r"\D", "", conf.get(name)) or 0)
        if not 0 < now <= most:
            conf.set(name, str(most))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim is not None:
                trim(0)

    return df.mapInArrow(bounded, schema)


def parts_of(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most bytes of a string or binary column, or a row if that has more."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
