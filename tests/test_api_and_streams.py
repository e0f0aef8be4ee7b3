from pyspark.sql import functions as F

from marlstone.api import Engine
from marlstone.operators import graph
from marlstone.plans import registry

registry.load()
from marlstone.plans.eval_queries import query_log
from marlstone.sources import corpus
from marlstone.streaming import query_log as q

SF = "/root/testdata/sf0.001"


def test_engine(spark, tmp_path):
    from marlstone.operators.search import Bm25Index

    Bm25Index.build(registry.docs(spark, SF)).save(str(tmp_path / "ix"))
    m = graph.cut(registry.mentions(spark, SF, types=False).where("chunk_id <= 600"))
    nodes = graph.build_nodes(m)
    edges = graph.cut(graph.build_edges(m, nodes, keep_chunks=5).orderBy(F.desc("weight"), "src", "dst").limit(40))
    v = registry.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    e = Engine(spark, registry.docs(spark, SF), v, v, m, edges, query_log(spark, SF), Bm25Index.load(spark, str(tmp_path / "ix")))
    first = v.orderBy("id").first().embedding
    asked = spark.createDataFrame([(1, "the hetion of Brand#12 and Brand#13", list(first)), (2, "who is Brand#1", list(first))], "qid int, query string, embedding array<float>")
    hits = e.search(asked, 5).collect()
    assert hits and all(r.rank <= 5 for r in hits)
    chat = {r.qid: r for r in e.chat(asked).collect()}
    assert chat and all(r.confidence in ("high", "medium", "low") for r in chat.values())
    assert e.chat(asked, "evidence").count() == 1
    got = e.intelligence(asked, 5)
    assert got["confidence"].count() == 2 and got["discovered"].count() > 0
    assert e.documents(1, 5).count() == 5 and e.document_stats().count() == 1 and e.metrics().count() == 1
    assert e.status()["vectors"] and e.entity("brand#12").count() == 1 and e.traverse("Brand#12", 1).count() >= 0


def test_streams_equal_tables(spark, tmp_path):
    events = registry.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = q.windowed(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("windows")) == key(q.windowed(events))
    log = q.write_log(stream.select("event_id", "value"), str(tmp_path / "log"), str(tmp_path / "cp"), once=True)
    log.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == events.count()


def test_record_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("junk\nTEXT-001-a.txt,first line\nsecond\n\nIMAGES-002-b.tif,\n  \nTEXT-003-c.txt,old\nTEXT-003-c.txt,new\n")
    got = {r.doc_filename: (r.text, r.doc_type) for r in corpus.read_records(spark, str(tmp_path / "a.txt")).collect()}
    assert got == {"TEXT-001-a.txt": ("first line\nsecond", "TEXT"), "TEXT-003-c.txt": ("new", "TEXT")}
    made = corpus.read_through(spark, str(tmp_path / "cache"), lambda: corpus.read_records(spark, str(tmp_path / "a.txt")))
    again = corpus.read_through(spark, str(tmp_path / "cache"), lambda: 1 / 0)
    assert made.count() == again.count() == 2


def test_index_round_trip(spark, tmp_path):
    from marlstone.operators.search import Bm25Index

    ix = Bm25Index.build(registry.docs(spark, SF))
    ix.save(str(tmp_path / "ix"))
    asked = spark.createDataFrame([(0, "the of and"), (1, ""), (2, "zzzz")], "qid int, query string")
    rows = lambda i: sorted((r.qid, r.id, round(r.score, 9)) for r in i.search(asked, 5).collect())
    assert rows(Bm25Index.load(spark, str(tmp_path / "ix"))) == rows(ix)


def test_every_query_has_a_unique_name_and_oracles_belong_to_queries():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
