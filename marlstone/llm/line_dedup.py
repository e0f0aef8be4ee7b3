"""Removal of boilerplate lines that many sites share.

A line's spread is the number of distinct sites (``source``) it stands on. Each
line hash gets a HyperLogLog sketch of its sites; tasks sketch the lines that they
read and the sketches merge by aggregation. Lines whose estimate is certain, by BAND
relative errors, to lie above or below the threshold are decided by it; lines
near the threshold get an exact count of distinct sites. Lines with a spread of
at least ``min_sites`` are removed wherever they stand.

Lines are what newlines separate. They are compared without leading and trailing
white space (``[\\x20\\x09-\\x0D]``), by 128 bits of hash; blank lines are kept and
have no spread. A null source is a site of its own. A null text stays null and
has no lines; a text that loses all its lines becomes empty. Rows that agree in
doc_id and text are treated alike. An empty table gives no rows; other columns
are kept by ``remove_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read, split_by, stored

MIN_SITES = 5
#: A sketch of 2**LOG_K registers has a relative error of about 0.83 / 2**(LOG_K / 2).
LOG_K = 10
BAND = 5 * 0.83 / 2 ** (LOG_K / 2)
#: Fixed value: white space around a line.
BLANK = " \t\n\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, a, b): the hash (a, b) of every line that isn't blank."""
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("site"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return each.withColumn("line", _trimmed(F.col("line"))).where("line != ''").select("doc_id", "text_hash", "site", *_hashes(F.col("line")))


def spreads(each: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, exact) of the lines (site, a, b) that stand on at least min_sites sites; exact: decided by counting."""
    sketched = each.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"))
    estimated = stored(sketched.select("a", "b", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - BAND)))
    sure = estimated.where(F.col("estimate") >= min_sites * (1 + BAND)).select("a", "b", F.lit(False).alias("exact"))
    near = estimated.where(F.col("estimate") < min_sites * (1 + BAND)).select("a", "b")
    counted = each.select("a", "b", "site").join(near, ["a", "b"]).distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return sure.unionByName(counted.where(F.col("n") >= min_sites).select("a", "b", F.lit(True).alias("exact")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, text_hash, gone): for each text, the hashes of its boilerplate lines.

    Lines and chosen lines are stored, so that a join of both comes straight from
    exchanges and Spark can split the partition of a frequent line.
    """
    each = stored(lines(docs))
    chosen = stored(spreads(each, min_sites).select("a", "b"))
    hit = each.select("doc_id", "text_hash", "a", "b").join(chosen, ["a", "b"])
    return hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with ``text`` less its boilerplate lines, and n_lines and n_removed (such columns of docs are replaced).

    Only texts that may have such a line meet the lists of them; the others stay where they are.
    """
    docs = docs.drop("n_lines", "n_removed")
    columns = [f"`{c}`" for c in docs.columns]
    hash_, d, h, gone, left = (fresh(docs, x) for x in ("hash", "d", "h", "gone", "left"))
    found = stored(boilerplate(docs, min_sites))
    some, rest = split_by(docs.withColumn(hash_, F.xxhash64("text")), hash_, found, "text_hash")
    joined = some.join(found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("gone").alias(gone)), (F.col(hash_) == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(d)), "left")
    split = F.split("text", "\n", -1)

    def stays(line: Column) -> Column:
        t = _trimmed(line)
        return (t == "") | ~F.array_contains(gone, F.struct(*_hashes(t)))

    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    kept = joined.withColumn(left, F.when(F.col(gone).isNull(), split).otherwise(F.filter(split, stays))).withColumn("n_lines", n)
    kept = kept.withColumn("n_removed", F.when(F.col("text").isNull(), 0).otherwise(n - F.size(left)).cast("long"))
    kept = kept.withColumn("text", F.array_join(left, "\n")).select(*columns, "n_lines", "n_removed")
    return kept.unionByName(rest.withColumn("n_lines", n).withColumn("n_removed", F.lit(0).cast("long")).select(*columns, "n_lines", "n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", "text")
