"""Steps that queries reach only in part, against plain versions of them."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import extract as x
from marlstone.operators import chunk, compress, evaluate, graph, providers, search
from marlstone.plans import registry
from marlstone.streaming import query_log as q

registry.load()
SF = "/root/testdata/sf0.001"


def plain_mmr(texts, relevance):
    words = [set(re.findall(r"\b\w{3,}\b", t.lower())) for t in texts]
    like = lambda a, b: len(a & b) / max(len(a | b), 1)
    left, out = list(range(len(texts))), []
    while left:
        rated = [(round(-(0.7 * relevance[i] - 0.3 * max((like(words[i], words[j]) for j in out), default=0)), 6), i) for i in left]
        out.append(min(rated)[1])
        left.remove(out[-1])
    return out


def test_mmr_is_the_greedy_choice(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["apple", "pear", "plum", "fig", "date"]) + str(r.randrange(3)) for _ in range(r.randint(2, 9))) for _ in range(9)]
    relevance = [r.randrange(7) / 7 + i / 1000 for i in range(9)]
    rows = [(1, i, "q", t, v) for i, (t, v) in enumerate(zip(texts, relevance))] + [(2, i, "q", texts[i], relevance[i]) for i in range(3)]
    got = compress.mmr(spark.createDataFrame(rows, "qid int, chunk long, query string, text string, relevance double")).collect()
    assert [z.text for z in sorted((z for z in got if z.qid == 1), key=lambda z: z.chunk)] == [texts[i] for i in plain_mmr(texts, relevance)]
    assert [z.text for z in sorted((z for z in got if z.qid == 2), key=lambda z: z.chunk)] == texts[:3]


@pytest.mark.parametrize("seed", range(5))
def test_forced_splits(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "end. ", "x", "."]) for _ in range(r.randrange(50, 900)))
    spans = chunk.force_split(text, 200, 40)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert c == max(a + 1, b - 40) and b - a <= 200
        best = max((m.start() + 1 for m in re.finditer(r"\. ", text) if a + 100 <= m.start() and m.start() + 2 <= a + 200), default=a + 200)
        assert b == best


def test_short_unlike_hits_stay(spark):
    texts = ["the harbour was closed in the winter", "seven ships came home before noon ok", "nobody knew the captain of the third", "  THE harbour was closed in the winter"]
    rows = [(0, i, t, 1.0 - i / 10) for i, t in enumerate(texts)]
    got = search.drop_similar(spark.createDataFrame(rows, "qid int, id int, text string, rrf_score double")).collect()
    assert [z.id for z in got] == [0, 1, 2]


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_planted_communities(spark, one_task):
    r = random.Random(3)
    edges = {}
    for c in range(4):
        nodes = [f"c{c}n{i:02d}" for i in range(12)]
        for a in nodes:
            for b in nodes:
                if a < b and r.random() < 0.7:
                    edges[a, b] = 3.0
    for _ in range(12):
        a, b = sorted((f"c{r.randrange(4)}n{r.randrange(12):02d}", f"c{r.randrange(4)}n{r.randrange(12):02d}"))
        if a[:2] != b[:2]:
            edges[a, b] = 1.0
    rows = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()] + [("zz1", "zz2", 1.0)], "src string, dst string, weight double")
    got = {z.id: z.community for z in graph.communities(rows, one_task=one_task).collect()}
    assert {frozenset(k for k in got if got[k] == c) for c in set(got.values())} == {frozenset(k for k in got if k[:2] == p) for p in ("c0", "c1", "c2", "c3", "zz")}
    assert all(c == min(k for k in got if got[k] == c) for c in set(got.values()))


@pytest.mark.parametrize("n", [1, 7, 500])
def test_percentiles(spark, n):
    r = random.Random(n)
    values = [r.choice([r.random(), r.randrange(5), 1e9 * r.random(), 0.1 + 1e-16]) * 1.0 for _ in range(n)]
    log = spark.createDataFrame([(v,) for v in values] + [(None,)], "latency double")
    assert evaluate.p95(log).first()[0] == sorted(values)[min(int(0.95 * n), n - 1)]
    assert evaluate.p95(log.limit(0)).first()[0] is None


def test_failing_providers(spark):
    class Broken:
        def embed(self, texts):
            raise OSError

        score = write = entities = embed

    hits = spark.createDataFrame([(1, 1, "a query", "some text"), (1, 2, "a query", "a query here")], "qid int, rank int, query string, text string")
    assert [(z.rank, z.original_rank, z.rerank_score) for z in providers.rerank(hits, 5, Broken()).collect()] == [(1, 1, None), (2, 2, None)]
    texts = spark.createDataFrame([(1, "First sentence of it here. Second."), (2, None)], "id int, text string")
    assert [z.embedding for z in providers.embed(texts, Broken()).collect()] == [None, None]
    assert [z.summary for z in providers.summarize(texts, Broken()).collect()] == ["First sentence of it here."]
    assert providers.names(texts, provider=Broken()).count() == 0


def test_lists_hold_the_least_values(spark):
    rows = spark.createDataFrame([("a", "L", f"s{i % 3}", i, i) for i in range(50)], "name string, label string, source string, chunk_id long, ord long")
    one = x.aggregate_names(rows, 4).first()
    assert (one["count"], one.sources, one.chunk_ids) == (50, ["s0", "s1", "s2"], [0, 1, 2, 3])


def test_session_and_count_streams_equal_tables(spark, tmp_path):
    events = registry.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0] + pd.Timedelta(days=900)
    end = spark.createDataFrame([(-1, last, -1, "end", 0.0, "{}")], events.schema)
    events.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = q.sessions(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((z.user_id, z.start, z.end, z.n) for z in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(q.sessions(events))
    counts = q.entity_counts(stream.select(F.col("event_type").alias("name"))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert {z.name: z["count"] for z in spark.table("counts").collect()} == {z.event_type: z["count"] for z in events.unionByName(end).groupBy("event_type").count().collect()}


def test_unit_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<float>")
    got = {z.id: z.embedding for z in search.unit(rows).collect()}
    assert np.allclose(got[1], [0.6, 0.8]) and got[2] == [0.0, 0.0]


@pytest.mark.parametrize("bound", [0, 100_000])
def test_words_of_texts_are_not_sent_to_all_tasks(spark, monkeypatch, tmp_path, bound):
    monkeypatch.setattr(providers, "DICTIONARY", bound)
    spark.createDataFrame([(1, "A hearing, a HEARING"), (2, "none"), (3, None)], "id long, text string").write.parquet(str(tmp_path / "t"))
    known = spark.createDataFrame([("Hearing", "EVENT"), ("none", "VERB")], "name string, label string")
    got = providers.names(spark.read.parquet(str(tmp_path / "t")), dictionary=known)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (bound > 0)
    assert {(r.id, r.label, r.name, r.start, r.end) for r in got.collect()} == {(1, "EVENT", "hearing", 2, 9), (1, "EVENT", "HEARING", 13, 20)}
