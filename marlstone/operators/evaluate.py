"""Retrieval metrics and the query log: ranks are positions of a list, from 1; relevance is a number."""

from __future__ import annotations

import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Stages of a query, the ring sizes and the cost model in USD.
STAGES = ("parse", "rewrite", "embed", "retrieve", "filter", "score", "rerank", "compress", "graph", "generation")
#: Ranges of values that a percentile's search counts at once.
CELLS = 1024
RING, RECENT, FAILURE_RING, RECENT_FAILURES = 1000, 20, 50, 10
EMBED_COST, RERANK_COST, GENERATION_COST = 0.05 * 0.003, 0.002, 2.5 * 0.0005
LOW_QUALITY = 0.3

_log2 = lambda c: F.log(c) / F.log(F.lit(2.0))


def at_k(ranked: DataFrame, k: int, totals: DataFrame | None = None) -> DataFrame:
    """(qid, precision, recall, recall_retrieved, mrr, ndcg) of (qid, rank, rel).

    Precision divides by the rows within k, not by k. nDCG's ideal is the same
    top k sorted anew. totals (qid, total): all relevant items, for recall;
    recall_retrieved counts relevant items among the list itself.
    """
    best = ranked.withColumn("ideal", F.row_number().over(W.partitionBy("qid", F.col("rank") <= k).orderBy(F.desc("rel"), "rank")))
    hit, within = F.col("rel") > 0, F.col("rank") <= k
    dcg = F.sum(F.when(within, F.col("rel") / _log2(F.col("rank") + 1)))
    ideal = F.sum(F.when(within, F.col("rel") / _log2(F.col("ideal") + 1)))
    out = best.groupBy("qid").agg(
        F.avg(F.when(within, hit.cast("int"))).alias("precision"),
        F.sum((within & hit).cast("int")).alias("n_hit"),
        F.sum(hit.cast("int")).alias("n_rel"),
        F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide(dcg, ideal), F.lit(0.0)).alias("ndcg"),
    )
    out = out.join(totals, "qid", "left") if totals is not None else out.withColumn("total", F.lit(None).cast("long"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select("qid", "precision", ratio("n_hit", "total").alias("recall"), ratio("n_hit", "n_rel").alias("recall_retrieved"), "mrr", "ndcg")


def approximate(scored: DataFrame, k: int = 10) -> DataFrame:
    """(qid, approx_ndcg, approx_mrr, approx_recall) from scores alone, (qid, rank, score): scores between the list's
    least and largest count as relevance; MRR is that of the first score over 0.5, or 1 for a list without one."""
    w = W.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    rel = F.when(high > low, (F.coalesce("score", F.lit(0.0)) - low) / (high - low)).otherwise(1.0)
    ndcg = at_k(scored.withColumn("rel", rel), k).select("qid", F.col("ndcg").alias("approx_ndcg"))
    rest = scored.groupBy("qid").agg(F.coalesce(1 / F.min(F.when(F.col("score") > 0.5, F.col("rank"))), F.lit(1.0)).alias("approx_mrr"), (F.count("score") / F.count(F.lit(1))).alias("approx_recall"))
    return ndcg.join(rest, "qid")


def by_category(metrics: DataFrame) -> DataFrame:
    """(category, n, precision, recall, mrr, ndcg): means of each category and, with a null category, of all."""
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "mrr", "ndcg")]
    return metrics.rollup("category").agg(F.count(F.lit(1)).alias("n"), *means)


def keyword_relevance(results: DataFrame) -> DataFrame:
    """results (text, expected_keywords) with rel: 1 if any keyword is in the text, any case."""
    return results.withColumn("rel", F.exists("expected_keywords", lambda w: F.contains(F.lower("text"), F.lower(w))).cast("int"))


def entity_recall(expected, found):
    """Share of the expected names (arrays) that were found, any case."""
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(low(expected), low(found))), F.size(low(expected))), F.lit(0.0))


def failure_mode(failed, n_results, ndcg):
    return F.when(failed, "error").when(n_results == 0, "no_results").when(ndcg < LOW_QUALITY, "low_quality").otherwise("")


def cost(rerank_ms, generation_ms):
    return F.round(F.lit(EMBED_COST) + F.when(rerank_ms > 0, RERANK_COST).otherwise(0.0) + F.when(generation_ms > 0, GENERATION_COST).otherwise(0.0), 6)


def last(log: DataFrame, n: int) -> DataFrame:
    """The n records that came last."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def path_coverage(expected, found):
    """Share of the expected paths (arrays of arrays of names) that were found, each as it is."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_distinct(expected), found)), F.size(F.array_distinct(expected))), F.lit(0.0))


LOG = "id long, ts timestamp_ntz, query string, latency double, failed boolean, error string, quality double, rerank_ms double, generation_ms double, n_results long, failure_mode string"
#: Characters of a query and of an error that a record holds.
QUERY_CHARS, ERROR_CHARS = 200, 500


def record(queries: DataFrame) -> DataFrame:
    """Log rows of successes (id, ts, query, latency, quality, rerank_ms, generation_ms, n_results)."""
    mode = failure_mode(F.lit(False), F.col("n_results"), F.col("quality"))
    return _logged(queries.withColumns({"failed": F.lit(False), "error": F.lit(None).cast("string"), "failure_mode": mode}))


def record_failure(queries: DataFrame) -> DataFrame:
    """Log rows of failures (id, ts, query, error)."""
    none = {c: F.lit(None) for c in ("latency", "quality", "rerank_ms", "generation_ms", "n_results")}
    return _logged(queries.withColumns({**none, "failed": F.lit(True), "error": F.substring("error", 1, ERROR_CHARS), "failure_mode": F.lit("error")}))


def _logged(rows: DataFrame) -> DataFrame:
    cut = rows.withColumn("query", F.substring("query", 1, QUERY_CHARS))
    return cut.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(LOG).fields))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def recent_failures(log: DataFrame, ring: int = FAILURE_RING, n: int = RECENT_FAILURES) -> DataFrame:
    """The last n of the last ``ring`` failures."""
    return last(last(log.where("failed"), ring), n)


def summary(log: DataFrame, ring: int = RING) -> DataFrame:
    """One row over the log (id, ts, latency, failed, quality, rerank_ms, generation_ms): totals over all of it,
    means over the last ``ring`` records, quality over successes only."""
    spent = cost(F.col("rerank_ms"), F.col("generation_ms"))
    whole = log.agg(F.count(F.lit(1)).alias("total_queries"), F.round(F.sum(spent), 6).alias("total_cost"))
    held = last(log, ring)
    means = held.agg(
        F.avg("latency").alias("avg_latency"),
        F.avg(F.when(~F.col("failed"), F.col("quality"))).alias("avg_quality"),
        F.avg(F.col("failed").cast("int")).alias("failure_rate"),
    )
    return whole.crossJoin(means).crossJoin(p95(held))  # one row each


def p95(log: DataFrame, value: str = "latency") -> DataFrame:
    """One row: the value at place min(floor(.95 n), n - 1) of the sorted values, from 0.

    Only the values are sorted, over all tasks; the place is looked up by counts of ranges of values, of which there
    are as many as partitions.
    """
    held = log.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    n = F.least(F.floor(F.lit(0.95) * F.count("v")), F.count("v") - 1)
    place, low, high = held.agg(n, F.min("v"), F.max("v")).first()
    if low is None:
        return held.agg(F.max("v").alias("p95"))
    for _ in range(64):  # narrow the values down to those around the place
        if low == high:
            break
        width = (float(high) - float(low)) / CELLS
        cell = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(CELLS - 1)) if width > 0 else F.lit(0)
        cells = sorted(held.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        for c in cells:
            if place < c.n:
                break
            place -= c.n
        if (c.low, c.high) == (low, high):
            break
        low, high = c.low, c.high
        held = held.where(F.col("v").between(F.lit(low), F.lit(high)))
    if low != high:  # ranges of floats too narrow to be cut
        for row in held.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").toLocalIterator():
            low = row.v
            if place < row.n:
                break
            place -= row.n
    return log.sparkSession.createDataFrame([(low,)], T.StructType([T.StructField("p95", log.schema[value].dataType)]))


def stage_means(log: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(stage, avg_ms) of columns <stage>_ms."""
    means = log.agg(*(F.avg(f"{s}_ms").alias(s) for s in stages))
    return means.unpivot([], list(stages), "stage", "avg_ms")


def failure_modes(log: DataFrame) -> DataFrame:
    return log.where("failure_mode != ''").groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n"))


def unique_entities(results: DataFrame) -> DataFrame:
    """(qid, n): distinct matched entities over a query's results."""
    return results.select("qid", F.explode("matched_entities").alias("e")).groupBy("qid").agg(F.count_distinct("e").alias("n"))
