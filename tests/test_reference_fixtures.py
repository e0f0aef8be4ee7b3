"""The small hand-made fixtures: four entities, a graph of five nodes, scores, questions."""

import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import extract as x
from marlstone.functions import query as qp
from marlstone.functions import text as tx
from marlstone.operators import chunk, dedup, entities, evaluate, evidence, graph, providers, scoring, search

EDGES = [("Alpha", "Beta", 120, "associated_with", ["c1", "c2"]), ("Alpha", "Delta", 80, "located_at", ["c1"]), ("Beta", "Gamma", 30, "mentioned_with", ["c3"]), ("Alpha", "Epsilon", 25, "employed_by", ["c4"])]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight long, type string, chunks array<string>")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_multi_hop_counts_and_scores(spark, edges):
    one = graph.multi_hop(edges, ids(spark, "Alpha"), 1).collect()
    assert len(one) == 3 and {r.score for r in one} == {1.0}
    two = graph.multi_hop(edges, ids(spark, "Alpha"), 2).collect()
    assert len(two) == 7
    assert math.isclose(next(r.score for r in two if r.path == ["Alpha", "Beta", "Gamma"]), 0.175)
    assert graph.multi_hop(graph.usable(edges, 50), ids(spark, "Alpha"), 1).count() == 2
    typed = graph.multi_hop(graph.usable(edges, types=["associated_with"]), ids(spark, "Alpha"), 2).collect()
    assert sorted(r.path for r in typed) == [["Alpha", "Beta"], ["Alpha", "Beta", "Alpha"]]
    assert graph.multi_hop(edges, ids(spark, "Alpha"), 2, simple=True).count() == 4
    assert graph.multi_hop(edges, ids(spark, "Nobody"), 2).count() == 0


def test_paths_between_and_relationship(spark, edges):
    assert [r.path for r in graph.simple_paths(edges, "Alpha", "Gamma").collect()] == [["Alpha", "Beta", "Gamma"]]
    assert graph.relationship(edges, "Beta", "Alpha").first()[:2] == ("direct", 120)
    assert graph.relationship(edges, "Delta", "Gamma").first()[2] == ["Delta", "Alpha", "Beta", "Gamma"]
    assert graph.relationship(edges, "Delta", "Zeta").first()[0] == "none"
    nodes, links = graph.neighborhood(edges, "Alpha", 2)
    assert {(r.id, r.depth) for r in nodes.collect()} == {("Alpha", 0), ("Beta", 1), ("Delta", 1), ("Epsilon", 1), ("Gamma", 2)}
    assert links.count() == 3 + 4


def test_components_and_communities(spark, edges):
    nodes = ids(spark, "Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta")
    got = {r.id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == dict.fromkeys(["Alpha", "Beta", "Gamma", "Delta", "Epsilon"], "Alpha") | {"Zeta": "Zeta"}
    assert graph.label_propagation(nodes, edges).count() == 6
    labels = graph.louvain(edges)
    assert graph.modularity(labels, edges).first()[0] >= 0


MENTIONS = [
    ("Alpha One", "PERSON", "c1", "doc1", 2005, 1), ("Alpha One", "PERSON", "c2", "doc2", 2008, 2), ("Alpha One", "PERSON", "c3", "doc2", 2019, 3),
    ("Beta Two", "PERSON", "c2", "doc1", 2005, 4), ("Beta Two", "PERSON", "c4", "doc1", 2019, 5), ("Beta Two", "PERSON", "c1", "doc1", 2005, 8),
    ("Delta Town", "GPE", "c1", "doc3", 2005, 6), ("Title 18", "LAW", "c6", "doc4", None, 7),
]


@pytest.fixture(scope="module")
def mentions(spark):
    return spark.createDataFrame(MENTIONS, "name string, type string, chunk_id string, doc_id string, year int, ord long")


def test_entity_store(spark, mentions):
    ix = entities.counts(mentions)
    asked = spark.createDataFrame([("alpha one",), ("Nobody",)], "asked string")
    assert [(r.name, r["count"]) for r in entities.lookup(ix, asked).collect()] == [("Alpha One", 3)]
    assert entities.by_type(ix, "person").count() == 2 and entities.by_type(ix, "LAW").count() == 1
    assert {r.name for r in entities.by_dates(mentions, "2005", "2008").collect()} >= {"Alpha One", "Delta Town"}
    assert {r.chunk_id for r in entities.chunk_ids(mentions, ["ALPHA ONE"]).collect()} == {"c1", "c2", "c3"}
    over = {r.chunk_id: r.overlap for r in entities.overlap(mentions, spark.createDataFrame([("Alpha One",), ("Delta Town",)], "name string")).collect()}
    assert over["c1"] == 1.0 and over["c2"] == 0.5
    co = {(r.name, r.partner): r.together for r in entities.cooccurrence(mentions).collect()}
    assert co == {("Alpha One", "Beta Two"): 2, ("Beta Two", "Alpha One"): 2}
    assert entities.upsert(mentions, mentions).count() == len(MENTIONS)
    nested = {r.name: r for r in entities.entity_index(mentions).collect()}
    assert nested["Alpha One"].chunk_ids == ["c1", "c2", "c3"] and nested["Alpha One"].dates == [2005, 2008, 2019]


def test_composite_scores(spark):
    hits = spark.createDataFrame([(0, "c1", "Alpha was at Delta Town.", 0.05, ["dense", "sparse"]), (0, "c2", "Beta traveled to London.", 0.03, ["dense"])], "qid int, id string, text string, rrf_score double, retrieval_sources array<string>")
    got = {r.id: r.composite_score for r in scoring.score(hits).collect()}
    assert math.isclose(got["c1"], 0.51) and math.isclose(got["c2"], 0.21)
    assert math.isclose(scoring.SEMANTIC + scoring.KEYWORD + scoring.ENTITY + scoring.GRAPH, 1.0)


def test_questions(spark):
    rows = [("Who is X?", "entity_lookup"), ("connection between A and B", "relationship"), ("timeline of events", "timeline"), ("Tell me about ships", "entity_lookup"), ("ships in the harbour at night", "search")]
    df = spark.createDataFrame(rows, "query string, wanted string").withColumn("got", qp.intent(F.col("query"), F.lit(0)))
    assert all(r.got == r.wanted for r in df.collect())
    one = spark.createDataFrame([("Title 18 Section 2255 between 1999 and 2005",)], "q string").select(qp.dates(F.col("q")).alias("d"), qp.statutes(F.col("q")).alias("s")).first()
    assert one.d == ["1999", "2005"] and one.s == ["Title 18", "Section 2255"]


def test_extraction(spark):
    df = spark.createDataFrame([("c1", "The deposition in Case 08-CJ-2343 cost $150,000 under Title 18. He took AB 123. Anna Lee met with Bo Day."), ("c2", None)], "id string, text string")
    got = {(r.label, r.name) for r in x.extract(df).collect()}
    assert got >= {("EVENT", "deposition"), ("CASE_NUMBER", "08-CJ-2343"), ("MONEY", "$150,000"), ("LAW", "Title 18"), ("FLIGHT", "AB123")}
    for r in x.with_offsets(df, labels=("MONEY", "LAW", "CASE_NUMBER")).collect():
        assert df.where("id = 'c1'").first().text[r.start : r.end] == r.name
    rec = {r.id: r for r in x.structured(df).collect()}
    assert rec["c1"].relationship_hints[0][:3] == ("Anna Lee", "Bo Day", "met_with") and rec["c2"].entity_count == 0


def test_chains(spark, edges, mentions):
    paths = evidence.path_chunks(graph.multi_hop(edges, ids(spark, "Alpha"), 2), edges)
    chunks = spark.createDataFrame([("c1", "text one"), ("c2", "text two"), ("c3", "text three")], "id string, text string")
    got = evidence.chains(paths, mentions, chunks).collect()
    assert got and all(r.confidence > 0 for r in got) and len(got) <= 5
    assert got[0].description.startswith("Alpha --[")
    assert {r.name for r in evidence.discovered(paths, spark.createDataFrame([("alpha",)], "name string")).collect()} == {"Beta", "Delta", "Epsilon", "Gamma"}


def test_metrics(spark):
    rel = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0)], "qid int, rank int, rel int")
    got = {r.qid: r for r in evaluate.at_k(rel, 2).collect()}
    assert got[1].precision == 0.5 and got[1].mrr == 0.5 and got[2].ndcg == 0.0
    assert math.isclose(got[1].ndcg, (1 / math.log2(3)) / 1)
    log = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, latency double")
    assert evaluate.p95(log).first()[0] == 19.0


def test_chunks_cover_the_text():
    for text in ("a" * 9000, "One. " * 3000, "para one\n\npara two\n\n" * 400, "short"):
        spans = chunk.pack(text, 2048)
        covered = set()
        for a, b in spans:
            covered.update(range(a, b))
        assert all(i in covered for i, c in enumerate(text) if not c.isspace())
        assert all(b - a <= 2048 * 1.5 for a, b in spans)


def test_dedup_steps(spark):
    base = "The quick brown fox jumps over the lazy dog near the river bank today, and again tomorrow."
    rows = [(1, base), (2, base), (3, base + "!"), (4, "x"), (5, None), (6, "Completely different text about ships, harbours and the long way home in winter.")]
    docs = spark.createDataFrame(rows, "id int, text string")
    assert {r.id for r in dedup.deduplicate(docs).collect()} == {1, 6}
    assert {r.step: r.removed for r in dedup.counts(docs).collect()} == {"corrupted": 2, "exact": 1, "near": 1}


def test_text_functions(spark):
    df = spark.createDataFrame([("Dr. Who met Mr. X in town today. It rained all day long! ok",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.sentences(F.col("t"))).collect()]
    assert got[0] == ["Dr. Who met Mr. X in town today.", "It rained all day long!"] and got[1] == [] and got[2] == []
    toks = [r[0] for r in df.select(tx.tokens(F.col("t"))).collect()]
    assert all(len(w) > 1 for w in toks[0]) and toks[1] == [] and toks[2] == []
    sh = df.select(tx.char_shingles(F.lit("abcdef"))).first()[0]
    assert sh == ["abcde", "bcdef"]


def test_similar_hits_are_dropped(spark):
    text = "word " * 100
    rows = [(0, 1, text, 0.9), (0, 2, text, 0.8), (0, 3, "other things entirely, told at some length and in a new way " * 6, 0.7)]
    got = search.drop_similar(spark.createDataFrame(rows, "qid int, id int, text string, rrf_score double")).collect()
    assert [r.id for r in got] == [1, 3]


def test_embedding_provider(spark):
    rows = providers.embed(spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string"), providers.HashingEmbedder(8)).collect()
    assert math.isclose(sum(v * v for v in rows[0].embedding), 1.0, rel_tol=1e-5) and sum(map(abs, rows[1].embedding)) == 0
