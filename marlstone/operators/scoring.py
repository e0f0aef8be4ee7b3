"""Composite scores of retrieval hits from semantic, keyword, entity and graph evidence, with boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx

# Component weights, the fused score that counts as full, and boost factors.
SEMANTIC, KEYWORD, ENTITY, GRAPH = 0.35, 0.20, 0.25, 0.20
FULL_RRF = 0.05
TEMPORAL_MATCH, TEMPORAL_MISS = 1.10, 0.95
MANY_SOURCES, SOME_SOURCES, COMMUNITY = 1.20, 1.10, 1.10


def clip(score: Column, full: float) -> Column:
    return F.least(F.greatest(score / full, F.lit(0.0)), F.lit(1.0))


def keyword_score(sources: Column) -> Column:
    sparse, dense = F.array_contains(sources, "sparse"), F.array_contains(sources, "dense")
    return F.when(sparse & dense, 0.8).when(sparse, 0.5).otherwise(0.0)


def temporal_boost(text: Column, dates: Column) -> Column:
    """Of query dates (array) and the text's years; no boost if either has none."""
    found = tx.years(text)
    return F.when((F.size(dates) == 0) | (F.size(found) == 0), 1.0).when(F.arrays_overlap(found, dates), TEMPORAL_MATCH).otherwise(TEMPORAL_MISS)


def multi_source_boost(max_docs: Column) -> Column:
    return F.when(max_docs > 3, MANY_SOURCES).when(max_docs > 1, SOME_SOURCES).otherwise(1.0)


def entity_components(hits: DataFrame, mentions: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, id, entity): by the query's entities (qid, name, count) that a chunk mentions, or, where the chunk has no
    indexed entity, that its text contains."""
    q = asked.select("qid", F.lower("name").alias("low"), F.col("count").alias("n")).distinct()
    total = q.groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    m = mentions.select(F.col("chunk_id").alias("id"), F.lower("name").alias("low")).distinct()
    ids = hits.select("qid", "id", "text")
    own = ids.join(m, "id").join(q, ["qid", "low"]).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    without = ids.join(m.select("id").distinct(), "id", "left_anti")
    parts = without.join(q, "qid").where(F.contains(F.lower("text"), F.col("low"))).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    score = F.least(F.col("k") / F.col("total") * (1 + F.log(1.0 + F.col("s")) / 10), F.lit(1.0))
    return own.unionByName(parts).join(total, "qid").select("qid", "id", score.alias("entity"))


def graph_scores(paths: DataFrame) -> DataFrame:
    """(qid, id, graph): a chunk's best path, of (qid, score, evidence_chunks)."""
    return paths.select("qid", "score", F.explode("evidence_chunks").alias("id")).groupBy("qid", "id").agg(F.max("score").alias("graph"))


def score(
    hits: DataFrame,
    entity: DataFrame | None = None,
    graph: DataFrame | None = None,
    queries: DataFrame | None = None,
    communities: DataFrame | None = None,
) -> DataFrame:
    """hits (qid, id, text, rrf_score, retrieval_sources) with ``composite_score``.

    entity (qid, id, entity), or, without a store, the hits' own entity_score if they have one; graph (qid, id, graph); queries (qid, dates,
    max_docs): years asked for and the most documents an asked entity has;
    communities (qid, id): chunks with an entity of the query's communities.
    """
    none = lambda name: F.lit(None).cast("double").alias(name)
    own = F.col("entity_score").cast("double") if "entity_score" in hits.columns else F.lit(None).cast("double")
    rows = hits.join(entity, ["qid", "id"], "left") if entity is not None else hits.select("*", own.alias("entity"))
    rows = rows.join(graph, ["qid", "id"], "left") if graph is not None else rows.select("*", none("graph"))
    rows = rows.join(queries.select("qid", "dates", "max_docs"), "qid", "left") if queries is not None else rows.select("*", F.array().cast("array<string>").alias("dates"), F.lit(0).alias("max_docs"))
    rows = rows.join(communities.select("qid", "id", F.lit(True).alias("inside")).distinct(), ["qid", "id"], "left") if communities is not None else rows.select("*", F.lit(False).alias("inside"))
    zero = F.lit(0.0)
    base = SEMANTIC * clip(F.col("rrf_score"), FULL_RRF) + KEYWORD * keyword_score(F.col("retrieval_sources")) + ENTITY * F.coalesce("entity", zero) + GRAPH * F.least(F.coalesce("graph", zero), F.lit(1.0))
    boost = temporal_boost(F.col("text"), F.coalesce("dates", F.array().cast("array<string>"))) * multi_source_boost(F.coalesce("max_docs", F.lit(0))) * F.when(F.coalesce("inside", F.lit(False)), COMMUNITY).otherwise(1.0)
    return rows.withColumn("composite_score", base * boost).drop("entity", "graph", "dates", "max_docs", "inside")


def confidence(top: Column) -> Column:
    """Of a result list, by its best score."""
    return F.round(F.least(20 * top, F.lit(1.0)), 3)
