"""Sources and sinks: record-marker text files, cached corpora, pages, substring search, embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as tx

#: Fixed value: a line that starts so opens a document.
MARKER = r"^(IMAGES?-\d+-|TEXT-\d+-)"
PREVIEW = 200


def parse_records(lines: DataFrame) -> DataFrame:
    """(doc_filename, text, doc_type) of lines (file, line_no, line).

    A marker line opens a document: what precedes the first comma is its name,
    the rest its first line. Blank documents go; of one name the last stays.
    """
    marked = lines.withColumn("line", F.regexp_replace("line", r"[\r\n]+$", "")).withColumn("open", F.col("line").rlike(MARKER))
    w = W.partitionBy("file").orderBy("line_no")
    numbered = marked.withColumn("gid", F.sum(F.col("open").cast("int")).over(w)).where("gid > 0")
    comma = F.instr("line", ",")
    name = F.when(F.col("open"), F.when(comma > 0, F.substring("line", F.lit(1), comma - 1)).otherwise(F.col("line")))
    body = F.when(F.col("open"), F.when(comma > 0, F.expr("substring(line, instr(line, ',') + 1)")).otherwise(F.lit(""))).otherwise(F.col("line"))
    parts = numbered.select("file", "gid", "line_no", name.alias("name"), body.alias("body"))
    docs = parts.groupBy("file", "gid").agg(F.max("name").alias("doc_filename"), F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("b"))
    text = docs.select("file", "gid", F.trim(F.col("doc_filename")).alias("doc_filename"), tx.stripped(F.array_join("b.body", "\n")).alias("text")).where("text != ''")
    last = text.withColumn("n", F.row_number().over(W.partitionBy("doc_filename").orderBy(F.desc("file"), F.desc("gid")))).where("n = 1")
    return last.select("doc_filename", "text", F.when(F.contains("doc_filename", F.lit("IMAGE")), "IMAGE").otherwise("TEXT").alias("doc_type"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """parse_records of whole text files; each file is read as one split, in line order."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = files.select("file", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))
    return parse_records(lines)


def read_through(spark: SparkSession, cache: str, build, fmt: str = "parquet") -> DataFrame:
    """What is cached at a path, or else built, written there and read back."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.format(fmt).save(cache)
    return spark.read.format(fmt).load(cache)


def get_document(docs: DataFrame, name, key: str = "doc_filename") -> DataFrame:
    return docs.where(F.col(key) == name)


def page(docs: DataFrame, number: int, size: int, doc_type: str | None = None, key: str = "id") -> DataFrame:
    """A page of documents by key: preview, length, total and total_pages. Only (key, type, length) is sorted."""
    if doc_type:
        docs = docs.where(F.upper("doc_type") == doc_type.upper())
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    rows = docs.select(key, "doc_type", F.substring("text", 1, PREVIEW).alias("preview"), F.length("text").alias("length")).orderBy(key).offset((number - 1) * size).limit(size)
    return rows.crossJoin(total).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))  # total is one row


def substring_search(docs: DataFrame, query: str, number: int, size: int, key: str = "id") -> DataFrame:
    """Documents that contain the query, any case: hits and a snippet, most hits first."""
    hit = docs.where(F.contains(F.lower("text"), F.lit(query.lower())))
    found = hit.select(key, tx.occurrences(F.col("text"), query).alias("hits"), tx.snippet(F.col("text"), query).alias("snippet"))
    return found.orderBy(F.desc("hits"), key).offset((number - 1) * size).limit(size)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, by type, characters, MB and the average length rounded down."""
    n = F.count(F.lit(1))
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return docs.agg(
        n.alias("total_documents"),
        F.count_if(F.col("doc_type") == "TEXT").alias("text_documents"),
        F.count_if(F.col("doc_type") == "IMAGE").alias("image_documents"),
        chars.alias("total_chars"),
        F.format_string("%.1f MB", chars / F.lit(1024.0 * 1024.0)).alias("size"),
        F.floor(F.coalesce(F.try_divide(chars, n), F.lit(0))).alias("avg_chars"),
    )


def cache_key(text):
    return F.sha2(text, 256)


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose text has no cached embedding (text_hash, embedding)."""
    return chunks.withColumn("text_hash", cache_key(F.col("text"))).join(cache.select("text_hash"), "text_hash", "left_anti")


def with_cached(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.withColumn("text_hash", cache_key(F.col("text"))).join(cache, "text_hash", "left")


def cache_put(path: str, rows: DataFrame) -> None:
    """Adds rows (text_hash, embedding) to the cache at path; of hashes that it has, or that come twice, one row stays."""
    spark = rows.sparkSession
    new = rows.select("text_hash", "embedding").dropDuplicates(["text_hash"])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        new = new.join(cache_load(spark, path).select("text_hash"), "text_hash", "left_anti")
    new.write.mode("append").parquet(path)


def cache_load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text_hash string, embedding array<float>").parquet(path)


def embedded(chunks: DataFrame, path: str, embed) -> DataFrame:
    """chunks with embeddings from the cache at path; what it lacks is embedded by embed (rows with text -> rows with
    embedding) and added to it first, each text once."""
    spark = chunks.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], "text_hash string, embedding array<float>").write.parquet(path)
    missing = cache_misses(chunks, cache_load(spark, path)).select("text_hash", "text").dropDuplicates(["text_hash"])
    cache_put(path, embed(missing).where("embedding is not null"))
    return with_cached(chunks, cache_load(spark, path))
