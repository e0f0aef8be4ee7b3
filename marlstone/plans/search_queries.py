"""Queries over scans and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import entities as e
from marlstone.operators import search as s
from marlstone.sources import corpus

from .registry import _LINES, DOCS, docs, mentions, query, table

TEXT_QUERY = "the bleha anstin of hetion"


def _tok(text: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 1)"


def bm25_sql(queries: str, k: int, final: str) -> str:
    """DuckDB SQL: final over hits(qid, id, score, rank)."""
    return f"""
WITH {DOCS}, q AS ({queries}),
toks AS MATERIALIZED (SELECT id, {_tok('text')} AS t FROM docs), dl AS (SELECT id, len(t) AS dl FROM toks),
st AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st), me AS MATERIALIZED (SELECT avg(r) AS mean FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * mean ELSE r END AS idf FROM raw, me),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_tok('query')}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT qid, post.id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM qt JOIN idf ON qt.term = idf.term JOIN post ON post.term = qt.term JOIN dl ON dl.id = post.id, st GROUP BY qid, post.id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})
{final}"""


def one_query(spark):
    return spark.createDataFrame([(0, TEXT_QUERY)], "qid long, query string")


_ONE = f"SELECT 0::BIGINT AS qid, '{TEXT_QUERY}' AS query"


@query(bm25_sql(_ONE, 10, "SELECT id, round(score, 6) AS score, rank::INT AS rank FROM hits"))
def bm25_search(spark, sf_dir):
    hits = s.Bm25Index.build(docs(spark, sf_dir)).search(one_query(spark), 10)
    return hits.select("id", F.round("score", 6).alias("score"), "rank")


@query(bm25_sql("SELECT item_id AS qid, text AS query FROM benchmark", 5, "SELECT qid, id, round(score, 5) AS score, rank::INT AS rank FROM hits"))
def bm25_batch(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = s.Bm25Index.build(docs(spark, sf_dir)).search(asked, 5)
    return hits.select("qid", "id", F.round("score", 5).alias("score"), "rank")


@query(bm25_sql(_ONE, 10, "SELECT term, df, round(idf, 6) AS idf FROM idf"))
def bm25_term_stats(spark, sf_dir):
    return s.Bm25Index.build(docs(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {DOCS} SELECT id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT id, {_tok('text')} AS t FROM docs)")
def token_stats(spark, sf_dir):
    t = docs(spark, sf_dir).select("id", tx.tokens(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _dense_cte(name: str, k: int, dims: str = "") -> str:
    e, q = (f"list_transform(v.embedding{dims}, lambda x: x::DOUBLE)", f"list_transform(z.embedding{dims}, lambda x: x::DOUBLE)")
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (
  SELECT z.vec_id AS qid, v.vec_id AS id, list_cosine_similarity({e}, {q}) AS score FROM embeddings v, embeddings z WHERE z.vec_id IN (SELECT qid FROM qv)) QUALIFY rank <= {k})"""


@query(f"WITH qv AS (SELECT 0 AS qid), {_dense_cte('d', 50)} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM d")
def dense_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return s.dense_topk(v, v.where("id = 0").select(F.col("id").alias("qid"), "embedding"), 50).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH qv AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0), {_dense_cte('d', 10)} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM d")
def dense_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return s.dense_topk(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding"), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH qv AS (SELECT 0 AS qid), {_dense_cte('d', 30, '[1:32]')} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM d")
def summary_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return s.dense_topk(v, v.where("id = 0").select(F.col("id").alias("qid"), "embedding"), 30, dims=32).select("id", F.round("score", 6).alias("score"), "rank")


_NAMED = ("Brand#11", "Brand#23")


def _lists(spark, sf_dir) -> dict:
    """The four lists of one query: documents stand in for chunks, orders of the same number carry the entities."""
    v = _vectors(spark, sf_dir)
    q = v.where("id = 0").select(F.col("id").alias("qid"), "embedding")
    rows = docs(spark, sf_dir)
    sparse = s.long_hits(s.Bm25Index.build(rows).search(one_query(spark), 50), rows)
    asked = spark.createDataFrame([(0, n) for n in _NAMED], "qid long, name string")
    entity = e.retrieve(mentions(spark, sf_dir, types=False), asked).select("qid", "id", "rank")
    return {"dense": s.dense_topk(v, q, 50), "sparse": sparse, "summary": s.dense_topk(v, q, 30, dims=32), "entity": entity}


_ENTITY_LIST = f"""{_LINES}, mentions AS (SELECT p_brand AS name, 'BRAND' AS type, chunk_id, doc_id, year, ord FROM lines),
xm AS (SELECT DISTINCT name, chunk_id FROM mentions WHERE name IN (SELECT name FROM mentions GROUP BY name HAVING count(*) >= 3)),
xc AS (SELECT a.name, b.name AS partner, count(*) AS together FROM xm a JOIN xm b ON a.chunk_id = b.chunk_id AND a.name <> b.name GROUP BY 1, 2),
xt AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY together DESC, partner) AS rank FROM xc QUALIFY rank <= 5),
xq AS (SELECT unnest(['{_NAMED[0]}', '{_NAMED[1]}']) AS name), xn AS (SELECT DISTINCT partner AS name FROM xt JOIN xq ON xt.name = xq.name WHERE partner NOT IN (SELECT name FROM xq)),
xw AS (SELECT name, 1 AS p FROM xq UNION ALL SELECT name, 0 FROM xn), xd AS (SELECT DISTINCT name, chunk_id FROM mentions),
xh AS (SELECT chunk_id, sum(p) AS asked, max(p) AS pr FROM xd JOIN xw USING (name) GROUP BY chunk_id), xz AS (SELECT chunk_id, count(*) AS n FROM xd GROUP BY chunk_id),
xs AS (SELECT chunk_id AS id, (0.6 * asked / 2 + 0.4 * ln(1 + n) / 3) * CASE WHEN pr = 1 THEN 1.5 ELSE 1 END AS score FROM xh JOIN xz USING (chunk_id)),
en AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM xs QUALIFY rank <= 20)"""

_FUSED = bm25_sql(
    _ONE,
    50,
    f""", lh AS (SELECT id, row_number() OVER (ORDER BY rank) AS rank FROM hits JOIN docs USING (id) WHERE length(text) > 50),
qv AS (SELECT 0 AS qid), {_dense_cte('d', 50)}, {_dense_cte('m', 30, '[1:32]')}, {_ENTITY_LIST},
parts AS (SELECT id, 1.0 / (60 + rank) AS p, 0 AS i, 'dense' AS n FROM d UNION ALL SELECT id, 1.0 / (60 + rank), 1, 'sparse' FROM lh
  UNION ALL SELECT id, 0.8 / (60 + rank), 2, 'summary' FROM m UNION ALL SELECT id, 1.2 / (60 + rank), 3, 'entity' FROM en),
fused AS (SELECT id, sum(p) AS rrf, string_agg(n, ',' ORDER BY i) AS sources FROM parts GROUP BY id)
""",
)


@query(_FUSED + "SELECT id, round(rrf, 9) AS rrf_score, sources FROM fused")
def rrf_fusion(spark, sf_dir):
    f = s.fuse(_lists(spark, sf_dir))
    return f.select("id", F.round("rrf_score", 9).alias("rrf_score"), F.array_join("retrieval_sources", ",").alias("sources"))


@query(_FUSED + "SELECT id, round(rrf * CASE WHEN contains(lower(text), 'anstin') THEN 1.3 ELSE 1 END, 9) AS rrf_score FROM fused JOIN docs USING (id)")
def rrf_keyword_boost(spark, sf_dir):
    rows = s.fuse(_lists(spark, sf_dir)).join(docs(spark, sf_dir), "id")
    return s.keyword_boost(rows, "anstin").select("id", F.round("rrf_score", 9).alias("rrf_score"))


@query(
    _FUSED
    + """SELECT id, round(s, 9) AS rrf_score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM
  (SELECT id, rrf * CASE WHEN contains(lower(text), 'anstin') THEN 1.3 ELSE 1 END AS s FROM fused JOIN docs USING (id) WHERE length(text) >= 30 AND doc_type = 'TEXT')) WHERE rank <= 20"""
)
def hybrid_search(spark, sf_dir):
    out = s.hybrid(_lists(spark, sf_dir), docs(spark, sf_dir), 20, keyword="anstin", doc_type="text")
    return out.select("id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


_STRIPPED = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_GRAMS3 = "list_distinct(list_transform(generate_series(1, greatest(length({0}) - 2, 0)), lambda i: substr({0}, i, 3)))"


def similar_sql(rows: str) -> str:
    """DuckDB SQL: kept(id) of rows(id, text, o), o being the order from 1: the greedy removal of texts that repeat."""
    return f"""sg AS MATERIALIZED (SELECT id, o, {_STRIPPED.format("substr(text, length(text) // 4 + 1, 300)")} AS mid, {_STRIPPED.format("CASE WHEN length(text) > 250 THEN substr(text, 51, 200) ELSE text END")} AS beg FROM {rows}),
sh AS MATERIALIZED (SELECT *, {_GRAMS3.format('mid')} AS gm, {_GRAMS3.format('beg')} AS gb FROM sg),
al AS MATERIALIZED (SELECT b.o, list(a.o) FILTER (a.mid = b.mid OR len(list_intersect(a.gm, b.gm)) / greatest(len(a.gm), len(b.gm), 1)::DOUBLE > 0.6 OR len(list_intersect(a.gb, b.gb)) / greatest(len(a.gb), len(b.gb), 1)::DOUBLE > 0.7) AS earlier
       FROM sh b LEFT JOIN sh a ON a.o < b.o GROUP BY b.o),
gr AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS held UNION ALL SELECT al.o, CASE WHEN list_has_any(held, coalesce(earlier, []::BIGINT[])) THEN held ELSE list_append(held, al.o) END FROM gr JOIN al ON al.o = gr.o + 1),
kept AS (SELECT id, o FROM sg WHERE list_contains((SELECT held FROM gr ORDER BY o DESC LIMIT 1), o))"""


@query(
    _FUSED.replace("\nWITH docs", "\nWITH RECURSIVE docs", 1)
    + f""", cd AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(rrf, 9) DESC, id)::BIGINT AS o FROM fused JOIN docs USING (id) WHERE length(text) >= 30 QUALIFY o <= 60), {similar_sql('cd')}
SELECT id, round(rrf, 9) AS rrf_score, row_number() OVER (ORDER BY o)::INT AS rank FROM cd JOIN kept USING (id, o) QUALIFY rank <= 20"""
)
def hybrid_distinct(spark, sf_dir):
    return s.hybrid(_lists(spark, sf_dir), docs(spark, sf_dir), 20, similar=True).select("id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


# Texts of 35 to some hundred characters, a third of which repeat another but for case and space.
_SHORT_SQL = """st AS (SELECT conv_id AS qid, turn AS id, CASE WHEN turn % 3 = 2 THEN ' ' || upper(substr(text, 1, 35 + conv_id % 300)) ELSE substr(text, 1, 35 + (conv_id + turn) % 300) END AS text FROM conversations WHERE length(text) >= 35)"""


@query(
    f"""WITH RECURSIVE {_SHORT_SQL}, rk AS (SELECT qid * 1000 + id AS id, qid, text, row_number() OVER (PARTITION BY qid ORDER BY id)::BIGINT AS o FROM st),
sg AS MATERIALIZED (SELECT qid, id, o, {_STRIPPED.format("substr(text, length(text) // 4 + 1, 300)")} AS mid, {_STRIPPED.format("CASE WHEN length(text) > 250 THEN substr(text, 51, 200) ELSE text END")} AS beg FROM rk),
sh AS MATERIALIZED (SELECT *, {_GRAMS3.format('mid')} AS gm, {_GRAMS3.format('beg')} AS gb FROM sg),
al AS MATERIALIZED (SELECT b.qid, b.o, list(a.o) FILTER (a.mid = b.mid OR len(list_intersect(a.gm, b.gm)) / greatest(len(a.gm), len(b.gm), 1)::DOUBLE > 0.6 OR len(list_intersect(a.gb, b.gb)) / greatest(len(a.gb), len(b.gb), 1)::DOUBLE > 0.7) AS earlier
       FROM sh b LEFT JOIN sh a ON a.qid = b.qid AND a.o < b.o GROUP BY b.qid, b.o),
gr AS (SELECT DISTINCT qid, 0::BIGINT AS o, []::BIGINT[] AS held FROM rk UNION ALL SELECT al.qid, al.o, CASE WHEN list_has_any(held, coalesce(earlier, []::BIGINT[])) THEN held ELSE list_append(held, al.o) END FROM gr JOIN al ON al.qid = gr.qid AND al.o = gr.o + 1),
fin AS (SELECT qid, held FROM gr QUALIFY row_number() OVER (PARTITION BY qid ORDER BY o DESC) = 1)
SELECT sg.qid, sg.id % 1000 AS id FROM sg JOIN fin USING (qid) WHERE list_contains(held, sg.o)"""
)
def similar_hits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("length(text) >= 35")
    cut = F.when(F.col("turn") % 3 == 2, F.concat(F.lit(" "), F.upper(F.substring("text", F.lit(1), (35 + F.col("conv_id") % 300).cast("int"))))).otherwise(F.substring("text", F.lit(1), (35 + (F.col("conv_id") + F.col("turn")) % 300).cast("int")))
    rows = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), cut.alias("text"), (-F.col("turn")).cast("double").alias("rrf_score"))
    return s.drop_similar(rows).select("qid", "id")


@query(f"WITH qv AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0), {_dense_cte('d', 5)} SELECT qid, id, round(score, 5) AS score, rank::INT AS rank FROM d")
def vectors_saved(spark, sf_dir):
    from marlstone.sources.shared import new_folder

    path = new_folder(spark)
    v = _vectors(spark, sf_dir)
    s.save_vectors(v.where("id % 3 != 0"), path)
    s.append_vectors(v, path)
    read = s.load_vectors(spark, path)
    return s.dense_topk(read, read.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding"), 5).select("qid", "id", F.round("score", 5).alias("score"), "rank")


@query(bm25_sql("SELECT item_id AS qid, text AS query FROM benchmark", 5, "SELECT qid, id, round(score, 5) AS score, rank::INT AS rank FROM hits"))
def bm25_saved(spark, sf_dir):
    from marlstone.sources.shared import new_folder

    first, second = new_folder(spark), new_folder(spark)
    s.Bm25Index.build(docs(spark, sf_dir), first).save(second)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return s.Bm25Index.load(spark, second).search(asked, 5).select("qid", "id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH qv AS (SELECT 0 AS qid), {_dense_cte('m', 30, '[1:32]')} SELECT m.id, rank::INT AS rank, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 40) END AS summary FROM m LEFT JOIN documents ON doc_id = m.id AND doc_id % 2 = 0")
def summary_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = s.dense_topk(v, v.where("id = 0").select(F.col("id").alias("qid"), "embedding"), 30, dims=32)
    texts = docs(spark, sf_dir).where("id % 2 = 0").select("id", F.substring("text", 1, 40).alias("summary"))
    return s.with_summaries(hits, texts).select("id", "rank", "summary")


@query("WITH d AS (SELECT vec_id AS id, sha256(vec_id::VARCHAR) AS h, list_transform(embedding, lambda x: round(x, 4)) AS e FROM embeddings) SELECT id, h AS text_hash, array_to_string(list_transform(e, lambda x: printf('%.4f', x)), ',') AS e, id % 3 = 0 AS was_cached FROM d")
def embedding_cache(spark, sf_dir):
    """A cache with a third of the vectors answers for these; the rest is embedded by lookup and added, then all come from the cache."""
    from marlstone.sources.shared import new_folder

    path = new_folder(spark)
    rows = _vectors(spark, sf_dir).select("id", F.col("id").cast("string").alias("text"), "embedding")
    corpus.cache_put(path, rows.where("id % 3 = 0").select(corpus.cache_key(F.col("text")).alias("text_hash"), "embedding"))
    known = corpus.cache_load(spark, path).select("text_hash", F.lit(True).alias("was_cached"))
    held = s.kept(known)
    out = corpus.embedded(rows.select("id", "text"), path, lambda missing: missing.join(rows.select("text", "embedding"), "text"))
    shown = F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double"))), ",")
    return out.join(held, "text_hash", "left").select("id", "text_hash", shown.alias("e"), F.coalesce("was_cached", F.lit(False)).alias("was_cached"))


@query(f"WITH {DOCS} SELECT id, doc_type, substr(text, 1, 200) AS preview, length(text) AS length, (SELECT count(*) FROM docs WHERE doc_type = 'TEXT') AS total, ceil((SELECT count(*) FROM docs WHERE doc_type = 'TEXT') / 20.0)::BIGINT AS total_pages FROM docs WHERE doc_type = 'TEXT' ORDER BY id LIMIT 20 OFFSET 40")
def doc_page(spark, sf_dir):
    return corpus.page(docs(spark, sf_dir), 3, 20, "text")


@query(
    f"""WITH {DOCS}, h AS (SELECT id, text, (length(lower(text)) - length(replace(lower(text), 'anstin', ''))) // 6 AS hits, instr(lower(text), 'anstin') AS p FROM docs WHERE contains(lower(text), 'anstin'))
SELECT id, hits::INT AS hits, substr(text, greatest(p - 100, 1), p - greatest(p - 100, 1) + 206) AS snippet FROM h ORDER BY hits DESC, id LIMIT 10"""
)
def doc_substring_search(spark, sf_dir):
    return corpus.substring_search(docs(spark, sf_dir), "Anstin", 1, 10)


@query(
    f"""WITH {DOCS} SELECT count(*) AS total_documents, count(*) FILTER (doc_type = 'TEXT') AS text_documents, count(*) FILTER (doc_type = 'IMAGE') AS image_documents,
sum(length(text))::BIGINT AS total_chars, format('{{:.1f}} MB', sum(length(text)) / 1048576.0) AS size, (sum(length(text)) // count(*))::BIGINT AS avg_chars FROM docs"""
)
def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(docs(spark, sf_dir))


@query(f"WITH {DOCS} SELECT * FROM docs WHERE id = 17")
def get_document(spark, sf_dir):
    return corpus.get_document(docs(spark, sf_dir), 17, "id")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE doc_type = 'TEXT' AND (contains(lower(text), 'bleha') OR contains(lower(text), 'anst')) AND lower(doc_filename) IN ('src1', 'src3', 'src5', 'src7') AND length(text) >= 400 AND NOT contains(lower(text), 'license')")
def filter_metadata(spark, sf_dir):
    return s.filter_metadata(docs(spark, sf_dir), doc_type="text", entities=["Bleha", "ANST"], source_files=["SRC1", "src3", "src5", "src7"], min_length=400, exclude_keywords=["License"]).select("id")


_ORDER_TEXT_SQL = "rt AS (SELECT o_orderkey AS id, 'Case ' || substr(year(o_orderdate)::VARCHAR, 3, 2) || '-OR-' || lpad(o_orderkey::VARCHAR, 7, '0') || '. Paid $' || (floor(o_totalprice)::BIGINT)::VARCHAR || '.00 under Section ' || (o_custkey % 90 + 1)::VARCHAR || ' at the hearing' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' in ' || year(o_orderdate)::VARCHAR END || '. Anna Weber met with Paul Stone.' AS text FROM orders)"


def order_texts(spark, sf_dir):
    """Order records as sentences with a case number, an amount, a statute, an event, a year and a relation."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("string")
    money = F.floor("o_totalprice").cast("string")
    text = F.concat(
        F.lit("Case "), F.substring(year, 3, 2), F.lit("-OR-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit(". Paid $"), money, F.lit(".00 under Section "),
        (F.col("o_custkey") % 90 + 1).cast("string"), F.lit(" at the hearing"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(" in "), year)), F.lit(". Anna Weber met with Paul Stone."),
    )
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query(f"WITH {_ORDER_TEXT_SQL} SELECT id FROM rt WHERE len(regexp_extract_all(text, '\\b(19[5-9]\\d|20[0-2]\\d)\\b', 1)) = 0 OR len(list_filter(regexp_extract_all(text, '\\b(19[5-9]\\d|20[0-2]\\d)\\b', 1), lambda y: y::INT BETWEEN 1996 AND 1998)) > 0")
def filter_year_range(spark, sf_dir):
    return s.filter_metadata(order_texts(spark, sf_dir), date_from="1996", date_to="1998").select("id")


@query("WITH c AS (SELECT doc_id AS id, sha256(text) AS h FROM documents), known AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT id FROM c WHERE h NOT IN (SELECT h FROM known)")
def embedding_cache_misses(spark, sf_dir):
    rows = docs(spark, sf_dir)
    cache = rows.where("id % 3 = 0").select(corpus.cache_key(F.col("text")).alias("text_hash"))
    return corpus.cache_misses(rows, cache).select("id")
