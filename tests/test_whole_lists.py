"""Lists of an entity index are whole, whatever their length; both JSON layouts are read."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.operators import entities as e
from marlstone.operators import scoring
from marlstone.plans import registry

registry.load()
MANY = 100_003


@pytest.fixture(scope="module")
def mentions(spark):
    kind = F.when(F.col("id") < 2, "Beta").otherwise("Alpha")
    return spark.range(MANY).select(kind.alias("name"), F.lit("PERSON").alias("type"), (F.col("id") + 5).alias("chunk_id"), (F.col("id") + 7).alias("doc_id"), F.lit(1999).alias("year"), F.col("id").alias("ord"))


def test_index_lists_are_whole(mentions):
    got = {r.name: r for r in e.entity_index(mentions).where("name = 'Alpha'").collect()}["Alpha"]
    assert list(got.chunk_ids) == list(range(7, MANY + 5)) and list(got.source_docs) == list(range(9, MANY + 7))
    assert list(e.entity_index(mentions, 3).where("name = 'Alpha'").first().chunk_ids) == [7, 8, 9]


def test_chunk_matrix_is_whole(spark, mentions):
    asked = spark.createDataFrame([("ALPHA",), ("none",)], "asked string")
    got = {r.asked: r.chunk_ids for r in e.chunk_matrix(mentions, asked).collect()}
    assert list(got["ALPHA"]) == list(range(7, MANY + 5)) and list(got["none"]) == []


def test_records_lists_are_whole(mentions):
    r = mentions.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.lit("d").alias("doc_filename"), F.create_map("type", F.array("name")).alias("entities"), F.array(F.lit("1999")).alias("dates_in_chunk"))
    assert e.index_of_records(r).where("name = 'Alpha'").select(F.size("chunk_ids")).first()[0] == MANY - 2


@pytest.mark.parametrize("layout", ["lines", "one line", "indented"])
@pytest.mark.parametrize("form", ["{}", "[]"])
def test_json_layouts(spark, tmp_path, form, layout):
    names = ["Al, \"x\"}", "Beta"]
    entry = lambda i: {"type": "P", "count": i + 1, "chunk_ids": ["a", "]"], "source_docs": ["{"], "dates_associated": ["1999"], "co_occurring": []}
    each = [{n: entry(i)} for i, n in enumerate(names)] if form == "{}" else [{"chunk_id": str(i), "doc_filename": "f", "entities": {"P": [n]}, "dates_in_chunk": ["1999"]} for i, n in enumerate(names)]
    path = str(tmp_path / "x")
    if layout == "lines":
        e.save_index_json(spark.createDataFrame([(json.dumps(v), i) for i, v in enumerate(each)], "value string, key long"), path, form)
        text = "".join(p.read_text() for p in (tmp_path / "x").glob("*.txt"))
        assert json.loads(text) == ({k: v for x in each for k, v in x.items()} if form == "{}" else each)
    else:
        whole = {k: v for x in each for k, v in x.items()} if form == "{}" else each
        (tmp_path / "x").write_text(json.dumps(whole, indent=1 if layout == "indented" else None))
    got = {r.name: r for r in e.read_index_json(spark, path + "-none", path).collect()}
    assert set(got) == set(names) and got["Beta"]["count"] == (2 if form == "{}" else 1)


def test_composite_score_is_its_sql_for_texts_with_years(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("lineitem", "part", "orders"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    rows = [(i, f"in {1990 + i} it was so", "en", "s", 20) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(registry.ORACLE["composite_score"]).fetchall())
    assert {r.id: r.composite_score for r in registry.QUERIES["composite_score"](spark, str(tmp_path)).collect()} == want


def test_years_asked_for_still_count(spark):
    hits = spark.createDataFrame([(0, i, t, 0.05, ["dense"]) for i, t in enumerate(["in 1997", "in 1998", "no year"])], "qid int, id long, text string, rrf_score double, retrieval_sources array<string>")
    asked = spark.createDataFrame([(0, ["1997"], 0)], "qid int, dates array<string>, max_docs int")
    got = {r.id: r.composite_score for r in scoring.score(hits, queries=asked).collect()}
    assert got == pytest.approx({0: 0.35 * 1.10, 1: 0.35 * 0.95, 2: 0.35})
