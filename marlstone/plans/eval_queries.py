"""Queries over retrieval metrics and the query log (events stand in for it)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.operators import evaluate as ev

from .registry import query, table
from .search_queries import _dense_cte, _vectors


def _ranked(spark, sf_dir):
    """Dense hits of every vector whose id is divisible by 20, relevant if the label is the same."""
    from marlstone.operators.search import dense_topk

    v = _vectors(spark, sf_dir)
    q = v.where("id % 20 = 0")
    hits = dense_topk(v, q.select(F.col("id").alias("qid"), "embedding"), 20)
    own = q.select(F.col("id").alias("qid"), F.col("label").alias("wanted"))
    rel = hits.join(own, "qid").join(v.select("id", "label"), "id").select("qid", "rank", "score", "wanted", (F.col("label") == F.col("wanted")).cast("int").alias("rel"))
    totals = own.join(v.groupBy("label").agg(F.count(F.lit(1)).alias("total")), F.col("wanted") == F.col("label")).select("qid", "total")
    return rel, totals


_RANKED = f"""WITH qv AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0), {_dense_cte('d', 20)},
r AS (SELECT qid, rank, score, q.label AS wanted, (v.label = q.label)::INT AS rel FROM d JOIN embeddings v ON v.vec_id = d.id JOIN embeddings q ON q.vec_id = d.qid),
tot AS (SELECT vec_id AS qid, t.n AS total FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) t USING (label) WHERE vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS ideal FROM r WHERE rank <= 10),
m AS (SELECT qid, avg(rel) AS precision, sum(rel) AS hit, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(ideal + 1)) AS idcg FROM k GROUP BY qid),
f AS (SELECT qid, coalesce(1.0 / min(rank) FILTER (rel > 0), 0) AS mrr, sum(rel) AS n FROM r GROUP BY qid),
met AS (SELECT qid, precision, hit / total AS recall, coalesce(hit / nullif(n, 0), 0) AS recall_retrieved, mrr, coalesce(dcg / nullif(idcg, 0), 0) AS ndcg FROM m JOIN f USING (qid) JOIN tot USING (qid))"""


@query(_RANKED + " SELECT qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(recall_retrieved, 6) AS recall_retrieved FROM met")
def precision_recall_at_k(spark, sf_dir):
    m = ev.at_k(*_at(_ranked(spark, sf_dir)))
    return m.select("qid", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "recall_retrieved")))


def _at(x, k=10):
    return x[0], k, x[1]


@query(_RANKED + " SELECT qid, round(mrr, 6) AS mrr FROM met")
def mrr(spark, sf_dir):
    return ev.at_k(*_at(_ranked(spark, sf_dir))).select("qid", F.round("mrr", 6).alias("mrr"))


@query(_RANKED + " SELECT qid, round(ndcg, 6) AS ndcg FROM met")
def ndcg_at_k(spark, sf_dir):
    return ev.at_k(*_at(_ranked(spark, sf_dir))).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(
    _RANKED
    + """, c AS (SELECT met.*, 'label ' || e.label AS category FROM met JOIN embeddings e ON e.vec_id = met.qid)
SELECT category, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM c GROUP BY GROUPING SETS ((), (category))"""
)
def eval_grouping_sets(spark, sf_dir):
    ranked, totals = _ranked(spark, sf_dir)
    category = ranked.select("qid", F.concat(F.lit("label "), F.col("wanted").cast("string")).alias("category")).distinct()
    out = ev.by_category(ev.at_k(ranked, 10, totals).join(category, "qid"))
    return out.select("category", "n", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")))


@query(
    f"""WITH qv AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0), {_dense_cte('d', 20)}, b AS (SELECT *, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS rel FROM d WINDOW w AS (PARTITION BY qid)),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS ideal FROM b WHERE rank <= 10)
SELECT k.qid, round(sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)), 6) AS approx_ndcg, round(any_value(x.m), 6) AS approx_mrr, 1.0 AS approx_recall
FROM k JOIN (SELECT qid, coalesce(1.0 / min(rank) FILTER (score > 0.5), 1.0) AS m FROM d GROUP BY qid) x ON x.qid = k.qid GROUP BY k.qid"""
)
def approximate_metrics(spark, sf_dir):
    out = ev.approximate(_ranked(spark, sf_dir)[0].select("qid", "rank", "score"))
    return out.select("qid", F.round("approx_ndcg", 6).alias("approx_ndcg"), F.round("approx_mrr", 6).alias("approx_mrr"), "approx_recall")


def query_log(spark, sf_dir):
    """Events as records: value is the latency, errors are failures, props' k times of stages."""
    k = F.get_json_object("props", "$.k").cast("double")
    failed = F.col("event_type") == "error"
    mode = ev.failure_mode(failed, F.when(F.col("event_id") % 7 == 0, 0).otherwise(3), F.col("value") / 100)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("value").alias("latency"), failed.alias("failed"), (F.col("value") % 1).alias("quality"),
        F.when(F.col("event_id") % 2 == 0, k).otherwise(0.0).alias("rerank_ms"), F.when(F.col("event_id") % 3 == 0, k + 1).otherwise(0.0).alias("generation_ms"), k.alias("parse_ms"), mode.alias("failure_mode"),
    )


_LOG = """WITH lg AS (SELECT event_id AS id, ts, value AS latency, event_type = 'error' AS failed, value % 1 AS quality, (props->>'$.k')::DOUBLE AS k,
CASE WHEN event_id % 2 = 0 THEN (props->>'$.k')::DOUBLE ELSE 0 END AS rerank_ms, CASE WHEN event_id % 3 = 0 THEN (props->>'$.k')::DOUBLE + 1 ELSE 0 END AS generation_ms,
CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 7 = 0 THEN 'no_results' WHEN value / 100 < 0.3 THEN 'low_quality' ELSE '' END AS failure_mode FROM events),
rg AS (SELECT * FROM lg ORDER BY ts DESC, id DESC LIMIT 1000),
so AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM rg)"""


@query(
    _LOG
    + """ SELECT (SELECT count(*) FROM lg) AS total_queries,
(SELECT round(sum(0.00015 + CASE WHEN rerank_ms > 0 THEN 0.002 ELSE 0 END + CASE WHEN generation_ms > 0 THEN 0.00125 ELSE 0 END), 6) FROM lg) AS total_cost,
round(avg(latency), 6) AS avg_latency, round(avg(quality) FILTER (NOT failed), 6) AS avg_quality, round(avg(failed::INT), 6) AS failure_rate, (SELECT max(latency) FROM so WHERE i = least(floor(0.95 * n), n - 1)) AS p95 FROM rg"""
)
def tracker_summary(spark, sf_dir):
    out = ev.summary(query_log(spark, sf_dir))
    return out.select("total_queries", F.round("total_cost", 6).alias("total_cost"), *(F.round(c, 6).alias(c) for c in ("avg_latency", "avg_quality", "failure_rate")), "p95")


@query(_LOG.replace("so AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM rg)", "so AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM lg)") + " SELECT max(latency) AS p95 FROM so WHERE i = least(floor(0.95 * n), n - 1)")
def tracker_p95(spark, sf_dir):
    return ev.p95(query_log(spark, sf_dir))


@query(_LOG + " SELECT id, latency FROM lg ORDER BY ts DESC, id DESC LIMIT 20")
def ring_buffer_last_n(spark, sf_dir):
    return ev.last(query_log(spark, sf_dir), ev.RECENT).select("id", "latency")


@query(_LOG + " SELECT failure_mode, count(*) AS n FROM lg WHERE failure_mode <> '' GROUP BY failure_mode")
def failure_modes(spark, sf_dir):
    return ev.failure_modes(query_log(spark, sf_dir))


@query(_LOG + " SELECT 'parse' AS stage, round(avg(k), 6) AS avg_ms FROM lg UNION ALL SELECT 'rerank', round(avg(rerank_ms), 6) FROM lg UNION ALL SELECT 'generation', round(avg(generation_ms), 6) FROM lg")
def stage_breakdown(spark, sf_dir):
    out = ev.stage_means(query_log(spark, sf_dir), ("parse", "rerank", "generation"))
    return out.select("stage", F.round("avg_ms", 6).alias("avg_ms"))


@query(_LOG + " SELECT id, latency FROM (SELECT * FROM lg WHERE failed ORDER BY ts DESC, id DESC LIMIT 50) ORDER BY ts DESC, id DESC LIMIT 10")
def recent_failures(spark, sf_dir):
    return ev.recent_failures(query_log(spark, sf_dir)).select("id", "latency")


@query(
    """SELECT event_id AS id, substr('query ' || repeat('x', (event_id % 300)::INT), 1, 200) AS query, event_type = 'error' AS failed, CASE WHEN event_type = 'error' THEN 'broken ' || event_id END AS error,
CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 7 = 0 THEN 'no_results' WHEN value / 100 < 0.3 THEN 'low_quality' ELSE '' END AS failure_mode FROM events"""
)
def query_log_saved(spark, sf_dir):
    """Successes and failures recorded, appended to a log and read back."""
    from marlstone.sources.shared import new_folder

    path = new_folder(spark)
    e = table(spark, sf_dir, "events").withColumn("query", F.concat(F.lit("query "), F.repeat(F.lit("x"), (F.col("event_id") % 300).cast("int"))))
    rows = e.select(F.col("event_id").alias("id"), "ts", "query", F.col("value").alias("latency"), (F.col("value") / 100).alias("quality"), F.lit(0.0).alias("rerank_ms"), F.lit(0.0).alias("generation_ms"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(3).alias("n_results"), "event_type")
    ev.append_log(ev.record(rows.where("event_type != 'error'")), path)
    ev.append_log(ev.record_failure(rows.where("event_type = 'error'").withColumn("error", F.concat(F.lit("broken "), F.col("id").cast("string")))), path)
    return ev.read_log(spark, path).select("id", "query", "failed", "error", "failure_mode")


@query("SELECT conv_id AS qid, round(1.0 / 3 * ((count(*) >= 1)::INT + (count(*) >= 2)::INT), 6) AS coverage, round(0.5 * (bool_or(lower(role) = 'user')::INT + bool_or(lower(role) = 'assistant')::INT), 6) AS recall FROM conversations GROUP BY conv_id")
def coverage_and_recall(spark, sf_dir):
    """Of expected paths a>b, b>c, x>y those that a conversation's turns stand for, and of expected roles."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.upper("role")).alias("roles"))
    path = lambda *x: F.array(*map(F.lit, x))
    expected = F.array(path("a", "b"), path("b", "c"), path("x", "y"), path("a", "b"))
    found = F.when(F.col("n") >= 2, F.array(path("a", "b"), path("b", "c"))).otherwise(F.array(path("a", "b")))
    return c.select("qid", F.round(ev.path_coverage(expected, found), 6).alias("coverage"), F.round(ev.entity_recall(F.array(F.lit("User"), F.lit("assistant")), F.col("roles")), 6).alias("recall"))


@query(
    """WITH r AS (SELECT conv_id AS qid, turn + 1 AS rank, turn % 3 AS rel, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3 DESC, turn) AS ideal FROM conversations WHERE turn < 10)
SELECT qid, round(coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(ideal + 1)), 0), 0), 6) AS ndcg FROM r GROUP BY qid"""
)
def ndcg_graded(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), (F.col("turn") % 3).alias("rel"))
    return ev.at_k(rows, 10).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query("SELECT conv_id AS qid, count(DISTINCT w) AS n FROM (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS w FROM conversations) GROUP BY conv_id")
def unique_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.split(F.lower("text"), " ").alias("matched_entities"))
    return ev.unique_entities(rows)


@query("SELECT item_id, (contains(lower(text), 'thn') OR contains(lower(text), 'ción'))::INT AS rel FROM benchmark")
def keyword_relevance(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("expected_keywords", F.array(F.lit("THN"), F.lit("ción")))
    return ev.keyword_relevance(rows).select("item_id", "rel")


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, count(*) AS n, sum(value) FILTER (n <= 3) AS first3 FROM o GROUP BY user_id")
def first_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n") <= 3, F.col("value"))).alias("first3"))
