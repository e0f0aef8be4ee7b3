"""Queries over the entity store."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import entities as e

from .registry import BRANDS, MENTIONS, docs, mentions, query, table

NAME = "Brand#12"

_COUNTS = "ix AS (SELECT name, arg_min(type, ord) AS type, count(*) AS count, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM mentions GROUP BY name)"


@query(f"WITH {MENTIONS}, {_COUNTS} SELECT * FROM ix")
def entity_index(spark, sf_dir):
    return e.counts(mentions(spark, sf_dir))


@query(f"WITH {BRANDS} SELECT name, min(type) AS type, count(*) AS count, md5(string_agg(DISTINCT year::VARCHAR, '|' ORDER BY year::VARCHAR)) AS dates, count(DISTINCT chunk_id) AS n_chunks FROM mentions GROUP BY name")
def entity_index_nested(spark, sf_dir):
    ix = e.entity_index(mentions(spark, sf_dir, types=False))
    return ix.select("name", "type", "count", F.md5(F.array_join(F.transform("dates", lambda d: d.cast("string")), "|").cast("binary")).alias("dates"), F.size("chunk_ids").cast("long").alias("n_chunks"))


_PAIRS = """m AS (SELECT DISTINCT name, chunk_id FROM mentions WHERE name IN (SELECT name FROM mentions GROUP BY name HAVING count(*) >= 3)),
co AS (SELECT a.name, b.name AS partner, count(*) AS together FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.name <> b.name GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY together DESC, partner) AS rank FROM co QUALIFY rank <= 20)"""


@query(f"WITH {BRANDS}, {_PAIRS} SELECT name, partner, together, rank::INT AS rank FROM top")
def entity_cooccurrence_top(spark, sf_dir):
    return e.cooccurrence(mentions(spark, sf_dir, types=False))


@query(f"WITH {MENTIONS}, {_COUNTS} SELECT name, type, count FROM ix WHERE contains(lower(name), 'brand#2') ORDER BY count DESC, name LIMIT 20")
def entity_search(spark, sf_dir):
    return e.search(e.counts(mentions(spark, sf_dir)), "BRAND#2").select("name", "type", "count")


@query(
    f"""WITH {MENTIONS}, {_COUNTS}, f AS (SELECT *, len(list_intersect(['small', 'plated', 'br'], string_split_regex(lower(name), '\\s+'))) AS k,
(contains(lower(name), 'small') OR contains(lower(name), 'plated') OR contains(lower(name), 'br'))::INT AS p FROM ix)
SELECT name, round(2 * k + p + count / 10000.0, 6) AS score FROM f WHERE k > 0 OR p > 0 ORDER BY 2 * k + p + count / 10000.0 DESC, name LIMIT 10"""
)
def entity_fuzzy(spark, sf_dir):
    return e.search_fuzzy(e.counts(mentions(spark, sf_dir)), "small plated BR").select("name", F.round("score", 6).alias("score"))


@query(f"WITH {MENTIONS}, {_COUNTS} SELECT name, count FROM ix WHERE type = 'BRAND' ORDER BY count DESC, name LIMIT 10")
def entity_by_type(spark, sf_dir):
    return e.by_type(e.counts(mentions(spark, sf_dir)), "brand", 10).select("name", "count")


@query(f"WITH {MENTIONS} SELECT name, count(*) AS count FROM mentions GROUP BY name HAVING bool_or(year::VARCHAR BETWEEN '1996' AND '1997') ORDER BY count DESC, name LIMIT 25")
def entity_by_date_range(spark, sf_dir):
    return e.by_dates(mentions(spark, sf_dir), "1996", "1997", 25)


_NEAR = f"""own AS (SELECT * FROM mentions WHERE lower(name) = lower('{NAME}')), oc AS (SELECT DISTINCT chunk_id FROM own),
near AS (SELECT name, count(*) AS together FROM (SELECT DISTINCT name, chunk_id FROM mentions WHERE lower(name) <> lower('{NAME}')) JOIN oc USING (chunk_id)
  WHERE name IN (SELECT name FROM mentions GROUP BY name HAVING count(*) >= 3) GROUP BY name)"""


@query(
    f"""WITH {BRANDS}, {_NEAR} SELECT name, min(type) AS type, count(*) AS count, count(DISTINCT doc_id) AS n_docs, min(year) AS first_year, max(year) AS last_year,
(SELECT string_agg(name, '|' ORDER BY together DESC, name) FROM (SELECT * FROM near ORDER BY together DESC, name LIMIT 5)) AS partners FROM own GROUP BY name"""
)
def entity_profile(spark, sf_dir):
    return e.profile(mentions(spark, sf_dir, types=False), NAME.upper())


@query(
    f"""WITH {BRANDS}, own AS (SELECT * FROM mentions WHERE name = '{NAME}'), py AS (SELECT year, count(*) AS mentions FROM own GROUP BY year),
n AS (SELECT o.year, m.name, count(*) AS c FROM (SELECT DISTINCT year, chunk_id FROM own) o JOIN (SELECT DISTINCT name, chunk_id FROM mentions WHERE name <> '{NAME}') m USING (chunk_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY c DESC, name) AS k FROM n QUALIFY k <= 5)
SELECT py.year, mentions, coalesce(string_agg(name, '|' ORDER BY k), '') AS partners FROM py LEFT JOIN r ON py.year = r.year GROUP BY py.year, mentions"""
)
def entity_timeline(spark, sf_dir):
    return e.timeline(mentions(spark, sf_dir, types=False), NAME)


@query(f"WITH {MENTIONS} SELECT type, count(*) AS entities, sum(count)::BIGINT AS mentions FROM (SELECT name, arg_min(type, ord) AS type, count(*) AS count FROM mentions GROUP BY name) GROUP BY ROLLUP (type)")
def entity_stats(spark, sf_dir):
    return e.stats(mentions(spark, sf_dir))


@query(f"WITH {BRANDS} SELECT DISTINCT chunk_id FROM mentions WHERE name IN ('Brand#12', 'Brand#34')")
def entity_chunks(spark, sf_dir):
    return e.chunk_ids(mentions(spark, sf_dir, types=False), ["brand#12", "BRAND#34"])


_ASKED = ["Brand#11", "Brand#12", "Brand#13"]


@query(f"WITH {BRANDS} SELECT chunk_id, round(count(DISTINCT name) / 3.0, 6) AS overlap FROM mentions WHERE name IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY chunk_id")
def entity_overlap(spark, sf_dir):
    asked = spark.createDataFrame([(n.lower(),) for n in _ASKED], "name string")
    return e.overlap(mentions(spark, sf_dir, types=False), asked).select("chunk_id", F.round("overlap", 6).alias("overlap"))


@query(f"WITH {MENTIONS}, asked(asked) AS (VALUES ('brand#12'), ('Brand#13'), ('no such')) SELECT asked, name, count(*) AS count FROM mentions JOIN asked ON lower(name) = lower(asked) GROUP BY ALL")
def entity_lookup(spark, sf_dir):
    names = spark.createDataFrame([("brand#12",), ("Brand#13",), ("no such",)], "asked string")
    return e.lookup(e.counts(mentions(spark, sf_dir)), names).select("asked", "name", "count")


@query("WITH n AS (SELECT lower(n_name) AS low FROM nation UNION SELECT 'anst' UNION SELECT 'bleha' UNION SELECT 'inea') SELECT doc_id AS id, low AS name FROM documents JOIN n ON contains(lower(text), low)")
def dictionary_match(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).unionByName(spark.createDataFrame([("anst",), ("bleha",), ("inea",)], "name string"))
    return e.dictionary_match(docs(spark, sf_dir), names.withColumn("count", F.lit(3)))


@query(
    f"""WITH {BRANDS}, {_PAIRS}, q AS (SELECT unnest(['Brand#11', 'Brand#23']) AS name), near AS (SELECT DISTINCT partner AS name FROM top JOIN q ON top.name = q.name WHERE rank <= 5 AND partner NOT IN (SELECT name FROM q)),
w AS (SELECT name, 1 AS p FROM q UNION ALL SELECT name, 0 FROM near), dm AS (SELECT DISTINCT name, chunk_id FROM mentions),
h AS (SELECT chunk_id, sum(p) AS asked, max(p) AS pr FROM dm JOIN w USING (name) GROUP BY chunk_id), z AS (SELECT chunk_id, count(*) AS n FROM dm GROUP BY chunk_id),
s AS (SELECT chunk_id AS id, (0.6 * asked / 2 + 0.4 * ln(1 + n) / 3) * CASE WHEN pr = 1 THEN 1.5 ELSE 1 END AS score, n FROM h JOIN z USING (chunk_id))
SELECT id, round(score, 6) AS entity_score, n AS n_entities, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s QUALIFY rank <= 20"""
)
def entity_retrieval(spark, sf_dir):
    asked = spark.createDataFrame([(0, "Brand#11"), (0, "brand#23")], "qid long, name string")
    return e.retrieve(mentions(spark, sf_dir, types=False), asked).select("id", F.round("entity_score", 6).alias("entity_score"), "n_entities", "rank")


@query(f"WITH {BRANDS} SELECT (SELECT count(*) FROM (SELECT DISTINCT name, chunk_id, type FROM mentions WHERE doc_id % 10 = 0 EXCEPT SELECT name, chunk_id, type FROM mentions WHERE doc_id % 10 <> 0)) AS added")
def entity_upsert(spark, sf_dir):
    m = mentions(spark, sf_dir, types=False)
    old, new = m.where("doc_id % 10 != 0"), m.where("doc_id % 10 = 0").dropDuplicates(["name", "chunk_id", "type"])
    return e.upsert(old, new).agg(F.count_if(F.col("doc_id") % 10 == 0).alias("added"))


@query(f"WITH {BRANDS}, a(asked) AS (VALUES ('brand#12'), ('Brand#13'), ('no such')) SELECT asked, count(DISTINCT chunk_id) AS n, coalesce(md5(string_agg(DISTINCT chunk_id, '|' ORDER BY chunk_id)), md5('')) AS chunks FROM a LEFT JOIN mentions ON lower(name) = lower(asked) GROUP BY asked")
def entity_chunk_matrix(spark, sf_dir):
    names = spark.createDataFrame([("brand#12",), ("Brand#13",), ("no such",)], "asked string")
    out = e.chunk_matrix(mentions(spark, sf_dir, types=False), names)
    return out.select("asked", F.size("chunk_ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), "|").cast("binary")).alias("chunks"))


_SAVED = f"""WITH {BRANDS}, {_PAIRS}, pa AS (SELECT name, string_agg(partner || ':' || together, '|' ORDER BY rank) AS partners FROM top GROUP BY name)
SELECT m.name, min(type) AS type, count(*) AS count, md5(string_agg(DISTINCT chunk_id::VARCHAR, '|' ORDER BY chunk_id::VARCHAR)) AS chunks, string_agg(DISTINCT year::VARCHAR, '|' ORDER BY year::VARCHAR) AS dates, any_value(partners) AS partners
FROM mentions m LEFT JOIN pa ON pa.name = m.name GROUP BY m.name"""


def _shown(index):
    listed = lambda c: F.array_join(F.array_sort(c), "|")
    partners = F.array_join(F.transform("co_occurring", lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string"))), "|")
    return index.select("name", "type", "count", F.md5(listed("chunk_ids").cast("binary")).alias("chunks"), listed("dates_associated").alias("dates"), partners.alias("partners"))


@query(_SAVED)
def entity_index_saved(spark, sf_dir):
    """The index with its strongest partners, saved as JSON lines and loaded."""
    from marlstone.sources.shared import new_folder

    path, m = new_folder(spark), mentions(spark, sf_dir, types=False)
    e.save_index(e.with_partners(e.entity_index(m), m), path)
    return _shown(e.load_index(spark, path))


@query(_SAVED)
def entity_index_from_object(spark, sf_dir):
    """The same from one JSON object keyed by name."""
    from marlstone.sources.shared import new_folder

    path, m = new_folder(spark), mentions(spark, sf_dir, types=False)
    ix = e.with_partners(e.entity_index(m), m)
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    entry = F.struct("type", "count", text("chunk_ids").alias("chunk_ids"), text("source_docs").alias("source_docs"), text("dates").alias("dates_associated"), "co_occurring")
    e.save_index_json(ix.select(F.to_json(F.create_map("name", entry)).alias("value"), F.col("name").alias("key")), path, "{}")
    return _shown(e.read_index_json(spark, f"{path}/none", path))


@query(_SAVED)
def entity_index_from_records(spark, sf_dir):
    """The same from a JSON list of chunk records."""
    from marlstone.sources.shared import new_folder

    path, m = new_folder(spark), mentions(spark, sf_dir, types=False)
    chunks = m.groupBy("chunk_id").agg(F.first("doc_id").alias("doc"), F.first("year").cast("string").alias("year"), F.collect_list("name").alias("names"))
    record = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc").cast("string").alias("doc_filename"), F.create_map(F.lit("BRAND"), "names").alias("entities"), F.array("year").alias("dates_in_chunk"))
    e.save_index_json(chunks.select(F.to_json(record).alias("value"), F.col("chunk_id").alias("key")), path, "[]")
    return _shown(e.read_index_json(spark, path))


@query("SELECT o_orderkey AS id, o_orderpriority AS kind, o_totalprice AS price FROM orders")
def json_round_trip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"))
    return e.from_json_records(o.select(e.json_records(o).alias("value")), "id long, kind string, price double")


@query(
    f"""WITH {MENTIONS}, {_COUNTS}, q(qid, query) AS (VALUES (1, 'small brand#12 and BRAND#13'), (2, 'economy promo'), (3, 'nothing')),
f AS (SELECT qid, name, count, row_number() OVER (PARTITION BY qid, lower(name) ORDER BY count DESC, name) AS r FROM q JOIN ix ON contains(lower(query), lower(name)) WHERE count >= 3 AND length(name) >= 2)
SELECT qid, name, count FROM f WHERE r = 1"""
)
def query_entities(spark, sf_dir):
    """Entities of questions by the dictionary, one of each name."""
    q = spark.createDataFrame([(1, "small brand#12 and BRAND#13"), (2, "economy promo"), (3, "nothing")], "qid int, text string")
    names = e.counts(mentions(spark, sf_dir)).select("name", "count")
    return e.best_by_name(e.dictionary_match(q, names, "qid").join(names, "name")).select("qid", "name", "count")


@query(f"WITH {BRANDS}, {_NEAR.replace(NAME, 'Brand#12')} SELECT name, count(*) AS count, count(DISTINCT doc_id) AS n_docs FROM own GROUP BY name")
def entity_profile_fuzzy(spark, sf_dir):
    """A name that isn't known finds the one most like it."""
    m = mentions(spark, sf_dir, types=False).where("name = 'Brand#12' or name like 'Brand#5%'")
    return e.profile(m, e.resolved(m, "brand#12 ltd")).select("name", "count", "n_docs")


@query(f"WITH {BRANDS}, c AS (SELECT name AS id, substr(name, 1, 7) AS community FROM (SELECT DISTINCT name FROM mentions)) SELECT c.id, min(type) AS type, count(*) AS count, count(DISTINCT doc_id) AS n_docs FROM c JOIN mentions ON name = id WHERE community = substr('{NAME}', 1, 7) GROUP BY c.id")
def entity_cluster(spark, sf_dir):
    from marlstone.api import Engine
    from marlstone.operators.search import Bm25Index

    m = mentions(spark, sf_dir, types=False)
    labels = m.select(F.col("name").alias("id")).distinct().withColumn("community", F.substring("id", 1, 7))
    return Engine(spark, docs(spark, sf_dir), mentions=m, index=Bm25Index(None, None, None)).cluster(labels, NAME.lower())


@query(f"WITH {MENTIONS}, o AS (SELECT * FROM mentions WHERE doc_id % 10 <> 0), n AS (SELECT name, chunk_id, type, min(ord) AS ord FROM mentions WHERE doc_id % 10 = 0 GROUP BY ALL) SELECT name, count(*) AS count, sum(chunk_id)::BIGINT AS chunks FROM (SELECT name, chunk_id FROM o UNION ALL SELECT name, chunk_id FROM n WHERE (name, chunk_id, type) NOT IN (SELECT (name, chunk_id, type) FROM o)) GROUP BY name")
def entity_upsert_rows(spark, sf_dir):
    m = mentions(spark, sf_dir)
    old, new = m.where("doc_id % 10 != 0"), m.where("doc_id % 10 = 0").dropDuplicates(["name", "chunk_id", "type"])
    return e.upsert(old, new).groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.sum("chunk_id").alias("chunks"))
