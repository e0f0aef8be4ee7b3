"""Evidence chains from traversal paths: supporting chunks, confidence, temporal range, description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Chains kept, supporting chunks of a chain, characters of a snippet.
MAX_CHAINS, MAX_CHUNKS, SNIPPET = 5, 10, 300


def describe(path="path", types="types"):
    """a --[type]--> b --[type]--> c"""
    steps = F.zip_with(types, F.slice(path, F.lit(2), F.size(types)), lambda t, n: F.concat(F.lit(" --["), t, F.lit("]--> "), n))
    return F.concat(F.get(path, F.lit(0)), F.array_join(steps, ""))


def path_chunks(paths: DataFrame, edges: DataFrame, per_edge: int = 5, most: int = 20) -> DataFrame:
    """paths (start, path, ...) with ``evidence_chunks`` (first of each edge's chunks, sorted) and ``types``."""
    keyed = paths.withColumn("pid", F.xxhash64("start", "path"))
    steps = keyed.select("pid", F.posexplode(F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")))).alias("i", "e"))
    met = steps.select("pid", "i", "e.src", "e.dst").join(edges.select("src", "dst", "type", F.slice(F.sort_array("chunks"), 1, per_edge).alias("c")), ["src", "dst"])
    lists = met.groupBy("pid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))), 1, most).alias("evidence_chunks"), F.array_sort(F.collect_list(F.struct("i", "type")))["type"].alias("types"))
    return keyed.join(lists, "pid", "left").drop("pid").withColumn("evidence_chunks", F.coalesce("evidence_chunks", F.array()))


def chains(paths: DataFrame, mentions: DataFrame, chunks: DataFrame, top: int = MAX_CHAINS) -> DataFrame:
    """(chain, entities, confidence, date_from, date_to, n_chunks, snippets, description) of the best paths.

    Paths with equal entity sets are one chain, the most confident stays; twice
    the number wanted is looked at before that.
    """
    best = paths.where("score > 0").orderBy(F.desc(F.round("score", 9)), "path").limit(2 * top)
    w = W.partitionBy(F.array_sort("path")).orderBy(F.desc(F.round("score", 9)), "path")
    one = best.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").orderBy(F.desc(F.round("score", 9)), "path").limit(top)
    # At most ``top`` rows from here.
    numbered = one.withColumn("chain", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "path")))
    dates = numbered.select("chain", F.explode("path").alias("name")).join(mentions.select("name", "year"), "name").groupBy("chain").agg(F.min("year").alias("date_from"), F.max("year").alias("date_to"))
    used = numbered.select("chain", F.explode(F.slice("evidence_chunks", 1, MAX_CHUNKS)).alias("id")).join(chunks, "id")
    support = used.groupBy("chain").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.struct("id", F.substring("text", 1, SNIPPET).alias("snippet"))))["snippet"].alias("snippets"))
    rows = numbered.join(dates, "chain", "left").join(support, "chain", "left")
    return rows.select("chain", F.col("path").alias("entities"), F.col("score").alias("confidence"), "date_from", "date_to", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "snippets", describe().alias("description"))


def discovered(paths: DataFrame, asked: DataFrame) -> DataFrame:
    """(name): entities on paths that were not asked for (name), any case."""
    on = paths.select(F.explode("path").alias("name")).distinct().withColumn("low", F.lower("name"))
    return on.join(asked.select(F.lower("name").alias("low")).distinct(), "low", "left_anti").select("name")
