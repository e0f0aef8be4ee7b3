"""Queries over text functions: deduplication, chunks, extraction, query parsing, compression, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import extract as x
from marlstone.functions import query as qp
from marlstone.functions import text as tx
from marlstone.operators import chunk, compress, dedup, generation, providers, search

from .registry import DOCS, docs, query, table
from .search_queries import _ORDER_TEXT_SQL, bm25_sql, order_texts

_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_BAD = """(length(s) < 50 OR length(regexp_replace(s, '[^\\p{L}\\p{N}\\s]', '', 'g')) / length(s)::DOUBLE < 0.3
OR len(list_distinct(list_filter(string_split(s, ''), lambda c: NOT regexp_full_match(c, '\\s*')))) < 3)"""


@query(f"WITH s AS (SELECT doc_id AS id, {_STRIP} AS s FROM documents WHERE text IS NOT NULL) SELECT id FROM s WHERE {_BAD}")
def corrupted_docs(spark, sf_dir):
    return dedup.corrupted(docs(spark, sf_dir)).select("id")


@query("SELECT min(doc_id) AS id FROM documents GROUP BY coalesce(text, '')")
def exact_dedup(spark, sf_dir):
    return dedup.exact(docs(spark, sf_dir)).select("id")


_SH = """b AS (SELECT doc_id AS id, length(text) // 200 AS bucket, regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY id) AS rn, CASE WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(generate_series(1, length(t) - 4), lambda i: substr(t, i, 5))) END AS g FROM b),
c AS (SELECT x.id AS a, y.id AS b, x.bucket, len(list_intersect(x.g, y.g)) AS k, len(x.g) AS nx, len(y.g) AS ny FROM s x JOIN s y ON x.bucket = y.bucket AND y.rn BETWEEN x.rn + 1 AND x.rn + 19),
p AS (SELECT a, b, bucket, k / (nx + ny - k)::DOUBLE AS jaccard FROM c WHERE k / (nx + ny - k)::DOUBLE >= 0.85)"""


@query(f"WITH {_SH} SELECT a, b, round(jaccard, 6) AS jaccard FROM p")
def near_dup_pairs(spark, sf_dir):
    return dedup.near_pairs(docs(spark, sf_dir)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


# Greedy in key order: a row goes if an earlier one that itself stays is like it; a row that goes takes no other along.
_GREEDY = """pn AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY a, b) AS k FROM p),
sweep AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT pn.k, CASE WHEN list_contains(gone, a) THEN gone ELSE list_append(gone, b) END FROM sweep JOIN pn ON pn.k = sweep.k + 1),
gone AS (SELECT DISTINCT unnest(gone) AS id FROM (SELECT gone FROM sweep ORDER BY k DESC LIMIT 1))"""


@query(f"WITH RECURSIVE {_SH}, {_GREEDY} SELECT id FROM gone")
def near_dups(spark, sf_dir):
    return dedup.near_dups(docs(spark, sf_dir))


_SOUND = f"""sd AS (SELECT doc_id, text FROM (SELECT doc_id, text, {_STRIP} AS s FROM documents WHERE text IS NOT NULL) WHERE NOT {_BAD}),
fd AS (SELECT * FROM sd WHERE doc_id IN (SELECT min(doc_id) FROM sd GROUP BY text))"""


@query(f"WITH RECURSIVE {_SOUND}, {_SH.replace('FROM documents', 'FROM fd')}, {_GREEDY} SELECT doc_id AS id FROM fd WHERE doc_id NOT IN (SELECT id FROM gone)")
def deduplicate(spark, sf_dir):
    return dedup.deduplicate(docs(spark, sf_dir)).select("id")


@query(f"WITH RECURSIVE {_SOUND}, {_SH.replace('FROM documents', 'FROM fd')}, {_GREEDY}, n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM sd) AS s, (SELECT count(*) FROM fd) AS f, (SELECT count(*) FROM gone) AS g) SELECT 'corrupted' AS step, d - s AS removed FROM n UNION ALL SELECT 'exact', s - f FROM n UNION ALL SELECT 'near', g FROM n")
def dedup_counts(spark, sf_dir):
    return dedup.counts(docs(spark, sf_dir))


@query(
    """WITH a AS (SELECT doc_id AS id, lower(text) AS t FROM documents), z AS (SELECT text AS q FROM documents WHERE doc_id = 11),
g AS (SELECT id, list_distinct(list_transform(generate_series(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i, 3))) AS x, list_distinct(list_transform(generate_series(1, greatest(length(q) - 2, 1)), lambda i: substr(lower(q), i, 3))) AS y FROM a, z)
SELECT id, round(len(list_intersect(x, y)) / greatest(len(x), len(y))::DOUBLE, 6) AS overlap FROM g"""
)
def trigram_overlap(spark, sf_dir):
    d = docs(spark, sf_dir)
    one = d.where("id = 11").select(F.col("text").alias("q"))
    pairs = d.crossJoin(one)  # one row
    return pairs.select("id", F.round(tx.trigram_overlap(F.col("text"), F.col("q")), 6).alias("overlap"))


@query(
    """WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) < 3000 THEN 2048 ELSE 4096 END AS size FROM documents WHERE text <> ''),
c AS (SELECT *, CASE WHEN n <= size THEN 0 ELSE greatest(ceil((n - 400) / (size - 400)::DOUBLE) - 1, 0)::INT END AS last FROM d),
e AS (SELECT *, unnest(generate_series(0, last)) AS i FROM c)
SELECT doc_id, i::INT AS chunk_index, (last + 1)::INT AS total_chunks, (i * (size - 400))::INT AS char_start, md5(substr(text, i * (size - 400) + 1, size)) AS h, sha256(doc_id || '|' || i) AS id FROM e"""
)
def stride_chunks(spark, sf_dir):
    c = chunk.stride_chunks(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "chunk_index", "total_chunks", "char_start", F.md5(F.col("text").cast("binary")).alias("h"), "id")


@query()
def paragraph_chunks(spark, sf_dir):
    return chunk.chunk_corpus(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "total_chunks", "char_start", "char_end")


_NOISY = "n AS (SELECT o_orderkey AS id, repeat('a', 1 + o_orderkey % 9) || ' ____________ x' || chr(12) || '  y' || chr(9) || 'z ------- foo-' || chr(10) || 'bar, ' || chr(10) || 'baz' || chr(10) || chr(10) || chr(10) || chr(10) || '======.' || '......' || o_orderkey || '  ' AS text FROM orders)"


_REPEATS = "t"
for _c in "a0123456789":  # RE2 has no back references
    _REPEATS = f"regexp_replace({_REPEATS}, '{_c}{{5,}}', '{_c * 3}', 'g')"


@query(
    f"""WITH {_NOISY}, s1 AS (SELECT id, replace(text, chr(12), '') AS t FROM n), s2 AS (SELECT id, {_REPEATS} AS t FROM s1),
s3 AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '_{{5,}}', '___', 'g'), '-{{5,}}', '---', 'g'), '={{5,}}', '', 'g'), '\\.{{5,}}', '...', 'g') AS t FROM s2),
s4 AS (SELECT id, regexp_replace(regexp_replace(replace(t, chr(9), '    '), '[ ]+' || chr(10), chr(10), 'g'), ' {{2,}}', ' ', 'g') AS t FROM s3),
s5 AS (SELECT id, regexp_replace(regexp_replace(t, '(\\w)-' || chr(10) || '(\\w)', '\\1\\2', 'g'), '([a-z,;])' || chr(10) || '([a-z])', '\\1 \\2', 'g') AS t FROM s4)
SELECT id, regexp_replace(regexp_replace(t, chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM s5"""
)
def clean_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    noisy = F.concat(F.expr("repeat('a', cast(1 + id % 9 as int))"), F.lit(" ____________ x\f  y\tz ------- foo-\nbar, \nbaz\n\n\n\n======......."), F.col("id").cast("string"), F.lit("  "))
    return o.select("id", tx.cleaned(noisy).alias("text"))


@query(
    r"""WITH s AS (SELECT doc_id AS id, string_split_regex(regexp_replace(regexp_replace(text, '(Mr|Mrs|Ms|Dr|Prof|Jr|Sr|vs|etc)\.\s', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) AS p FROM documents),
u AS (SELECT id, unnest(list_transform(p, lambda x: regexp_replace(replace(x, chr(1), '. '), '^\s+|\s+$', '', 'g'))) AS sentence FROM s) SELECT id, sentence FROM u WHERE length(sentence) > 15"""
)
def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("id", F.explode(tx.sentences(F.col("text"))).alias("sentence"))


def _context(spark, sf_dir):
    """Benchmark items as queries over the best documents."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = search.Bm25Index.build(docs(spark, sf_dir)).search(asked, 5)
    return hits.join(asked, "qid").join(docs(spark, sf_dir), "id").select("qid", F.col("rank").cast("long").alias("chunk"), "query", "text", "id")


_W3L = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+', 0), lambda w: length(w) >= 3))"
_CONTEXT = bm25_sql(
    "SELECT item_id AS qid, text AS query FROM benchmark",
    5,
    """, cx AS MATERIALIZED (SELECT hits.qid, rank AS chunk, query, text, hits.id FROM hits JOIN q USING (qid) JOIN docs USING (id)) """,
)
_SPLIT = r"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({}, '(Mr|Mrs|Ms|Dr|Prof|Jr|Sr|vs|etc)\.\s', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: regexp_replace(replace(x, chr(1), '. '), '^\s+|\s+$', '', 'g')), lambda x: length(x) > 15)"""


@query(
    _CONTEXT
    + f""", se AS (SELECT qid, chunk, query, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT qid, chunk, query, {_SPLIT.format('text')} AS s FROM cx)),
sc2 AS (SELECT qid, chunk, pos, len(list_intersect({_W3L.format('query')}, {_W3L.format('s')})) / greatest(len({_W3L.format('query')}), 1)::DOUBLE
  + 0.05 * len(regexp_extract_all(s, '(^|\\s)\\p{{Lu}}')) + CASE WHEN regexp_matches(s, '\\d{{4}}') THEN 0.1 ELSE 0 END AS score FROM se WHERE len({_W3L.format('s')}) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk ORDER BY round(score, 9) DESC, pos) AS r, count(*) OVER (PARTITION BY qid, chunk) AS n FROM sc2)
SELECT qid, chunk::BIGINT AS chunk, pos::INT AS pos, round(score, 6) AS score FROM rk WHERE r <= greatest(3, n * 6 // 10)"""
)
def sentence_topk(spark, sf_dir):
    s = compress.best_sentences(compress.scored_sentences(_context(spark, sf_dir)))
    return s.select("qid", "chunk", "pos", F.round("score", 6).alias("score"))


@query()
def compress_context(spark, sf_dir):
    return compress.compress(_context(spark, sf_dir), 3000)


@query(
    """WITH c AS (SELECT item_id // 8 AS qid, item_id AS chunk, text, 500 - coalesce(sum(length(text)) OVER (PARTITION BY item_id // 8 ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM benchmark)
SELECT qid, chunk, CASE WHEN length(text) <= l THEN text ELSE substr(text, 1, l::BIGINT) || '...' END AS text FROM c WHERE length(text) <= l OR l > 100"""
)
def budget_trim(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 8).alias("qid"), F.col("item_id").alias("chunk"), "text")
    return compress.trim(b, 500).select("qid", "chunk", "text")


_ENT = "".join(
    f" UNION ALL SELECT id, '{label}' AS label, unnest(regexp_extract_all(text, '{p}', 0)) AS name FROM rt"
    for label, p in (
        ("MONEY", r"\$[\d,]+(?:\.\d{2})?"),
        ("CASE_NUMBER", r"\b\d{2}-[A-Z]{2,3}-\d{4,}\b"),
        ("LAW", r"(?i)\bTitle\s+\d+\b"),
        ("LAW", r"(?i)\bSection\s+\d+[a-z]?\b"),
        ("EVENT", r"(?i)\b(?:deposition|hearing|trial|arraignment|sentencing|arrest|indictment)\b"),
    )
)


@query(f"WITH {_ORDER_TEXT_SQL} SELECT id, 'FLIGHT' AS label, replace(unnest(regexp_extract_all(text, '\\b[A-Z]{{2,3}}\\s?\\d{{3,4}}\\b', 0)), ' ', '') AS name FROM rt{_ENT}")
def extract_entities(spark, sf_dir):
    return x.extract(order_texts(spark, sf_dir))


@query(f"WITH {_ORDER_TEXT_SQL}, m AS (SELECT id, text, regexp_extract(text, '\\$[\\d,]+(?:\\.\\d{{2}})?', 0) AS name FROM rt) SELECT id, 'MONEY' AS label, name, (instr(text, name) - 1)::INT AS start, (instr(text, name) - 1 + length(name))::INT AS \"end\" FROM m WHERE name <> ''")
def entity_offsets(spark, sf_dir):
    return x.with_offsets(order_texts(spark, sf_dir), labels=("MONEY",))


@query(f"WITH {_ORDER_TEXT_SQL} SELECT id, 'Anna Weber' AS entity1, 'Paul Stone' AS entity2, 'met_with' AS type, substr(text, instr(text, 'Anna Weber') - 20, 51) AS evidence FROM rt")
def relation_hints(spark, sf_dir):
    rows = order_texts(spark, sf_dir).select("id", F.explode(x.relation_hints(F.col("text"))).alias("h"))
    return rows.select("id", "h.entity1", "h.entity2", "h.type", "h.evidence")


@query(f"WITH {_ORDER_TEXT_SQL} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(19[5-9]\\d|20[0-2]\\d)\\b', 1))), '|') AS dates, 2 AS n_entities FROM rt")
def structured_records(spark, sf_dir):
    return x.structured(order_texts(spark, sf_dir)).select("id", F.array_join("dates_in_chunk", "|").alias("dates"), F.col("entity_count").alias("n_entities"))


_PATTERN_SQL = """pt AS (SELECT o_orderkey AS id, 'On Jan 5, ' || (1950 + o_orderkey % 70) || ' § ' || (o_orderkey % 90) || ' and 18 U.S.C. § 22' || (o_orderkey % 10) || ', a Plea Agreement: subpoena, grand jury, telephone call 555-01' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-4321. Flight AA ' || (100 + o_orderkey % 900) || ' and a trip.' AS text FROM orders)"""


def _pattern_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("On Jan 5, "), s(1950 + k % 70), F.lit(" § "), s(k % 90), F.lit(" and 18 U.S.C. § 22"), s(k % 10), F.lit(", a Plea Agreement: subpoena, grand jury, telephone call 555-01"), F.lpad(s(k % 100), 2, "0"), F.lit("-4321. Flight AA "), s(100 + k % 900), F.lit(" and a trip."))
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text"))


_ALL_PATTERNS = " UNION ALL ".join(
    f"SELECT id, '{label}' AS label, unnest(regexp_extract_all({t}, '{p}', 0)) AS name FROM pt"
    for label, t, p in (
        ("MONEY", "text", r"\$[\d,]+(?:\.\d{2})?"), ("CASE_NUMBER", "text", r"\b\d{2}-[A-Z]{2,3}-\d{4,}\b"), ("LAW", "text", r"(?i)\bTitle\s+\d+\b"), ("LAW", "text", r"(?i)\bSection\s+\d+[a-z]?\b"), ("LAW", "text", r"§\s*\d+"),
        ("LAW", "text", r"(?i)\b\d+\s+U\.?S\.?C\.?\s*§?\s*\d+"), ("LAW", "text", r"(?i)\b(?:Non-Prosecution|Plea)\s+Agreement\b"), ("PHONE", "text", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
        ("EVENT", "lower(text)", r"\b(?:deposition|hearing|trial|arraignment|sentencing|arrest|indictment|plea\s+(?:deal|agreement))\b"), ("EVENT", "lower(text)", r"\b(?:grand\s+jury|search\s+warrant|subpoena)\b"), ("EVENT", "lower(text)", r"\b(?:meeting|telephone\s+call|flight|visit|trip)\b"),
        ("DATE", "text", r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"),
    )
)


@query(f"WITH {_PATTERN_SQL} SELECT id, 'FLIGHT' AS label, replace(unnest(regexp_extract_all(text, '\\b[A-Z]{{2,3}}\\s?\\d{{3,4}}\\b', 0)), ' ', '') AS name FROM pt UNION ALL {_ALL_PATTERNS}")
def extract_patterns(spark, sf_dir):
    return x.extract(_pattern_texts(spark, sf_dir), labels=(*x.DEFAULT_LABELS, "PHONE", "DATE"))


@query(f"WITH {_PATTERN_SQL}, e AS (SELECT id, text, {', '.join(f'{n} AS {c}' for n, c in (('instr(text, chr(36))', 'z'),))} FROM pt), m AS (SELECT id, label, regexp_extract(text, p, 0) AS name, text FROM pt, (VALUES ('LAW', '§\\s*\\d+'), ('LAW', '\\b\\d+\\s+U\\.?S\\.?C\\.?\\s*§?\\s*\\d+'), ('FLIGHT', 'AA \\d+')) v(label, p)) SELECT id, label, name, (instr(text, name) - 1)::INT AS start, (instr(text, name) - 1 + length(name))::INT AS \"end\" FROM m UNION ALL SELECT id, 'LAW', 'Plea Agreement', (instr(text, 'Plea Agreement') - 1)::INT, (instr(text, 'Plea Agreement') + 13)::INT FROM pt UNION ALL SELECT id, 'LAW', substr(text, strpos(text, 'U.S.C. ') + 7, 5), (strpos(text, 'U.S.C. ') + 6)::INT, (strpos(text, 'U.S.C. ') + 11)::INT FROM pt")
def extract_offsets(spark, sf_dir):
    return x.with_offsets(_pattern_texts(spark, sf_dir), labels=("LAW", "FLIGHT"))


_TWICE_SQL = """tw AS (SELECT o_orderkey AS id, 'In ' || year(o_orderdate) || ' Anna Weber met with Paul Stone' || repeat('.', 1 + (o_orderkey % 7)::INT) || ' later Anna Weber met with Paul Stone, and Anna Weber visited Port Royal too' AS text FROM orders),
f AS (SELECT id, text, instr(text, 'Anna Weber met') AS p1, instr(text, 'later') + 6 AS p2, instr(text, 'Anna Weber visited') AS p3 FROM tw)"""


@query(f"WITH {_TWICE_SQL} SELECT id, 'Paul Stone' AS entity2, 'met_with' AS type, substr(text, greatest(p1 - 20, 1), p1 - greatest(p1 - 20, 1) + 50) AS evidence FROM f UNION ALL SELECT id, 'Paul Stone', 'met_with', substr(text, p2 - 20, 70) FROM f UNION ALL SELECT id, 'Port Royal', 'traveled_to', substr(text, p3 - 20, 69) FROM f")
def relation_repeats(spark, sf_dir):
    year = F.year("o_orderdate").cast("string")
    text = F.concat(F.lit("In "), year, F.lit(" Anna Weber met with Paul Stone"), F.repeat(F.lit("."), (1 + F.col("o_orderkey") % 7).cast("int")), F.lit(" later Anna Weber met with Paul Stone, and Anna Weber visited Port Royal too"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(x.relation_hints(text)).alias("h"))
    return rows.select("id", "h.entity2", "h.type", "h.evidence")


@query("WITH m AS (SELECT lower(p_name) AS name, p_type AS label, p_brand AS source, p_partkey AS chunk_id FROM part) SELECT name, arg_min(label, chunk_id) AS label, count(*) AS count, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, md5(string_agg(chunk_id, '|' ORDER BY chunk_id)) AS chunk_ids FROM m GROUP BY name")
def aggregate_names(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), F.col("p_type").alias("label"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("ord"))
    out = x.aggregate_names(m, 100_000)
    return out.select("name", "label", "count", F.array_join("sources", "|").alias("sources"), F.md5(F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), "|").cast("binary")).alias("chunk_ids"))


_QUESTIONS = [
    (1, "Who is Anna Weber?"),
    (2, "What is the connection between Anna Weber and Paul Stone from 1999 to 2005?"),
    (3, "timeline of events in 1998"),
    (4, "Anna Weber"),
    (5, "payments under Title 18 Section 2255 during 2001 and 1997"),
    (6, "text documents about ships"),
    (7, "photo scans of the harbour? of the pier? from 2003"),
    (8, "Anna Weber Paul Stone harbour letters of spring and autumn"),
]
_QSQL = "q(qid, query) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _QUESTIONS) + ")"
_QE = "e AS (SELECT qid, query, list_filter(['Anna Weber', 'Paul Stone'], lambda n: contains(lower(query), lower(n))) AS names FROM q)"


def _questions(spark):
    q = spark.createDataFrame(_QUESTIONS, "qid int, query string")
    known = F.array(F.lit("Anna Weber"), F.lit("Paul Stone"))
    return q.withColumn("names", F.filter(known, lambda n: F.contains(F.lower("query"), F.lower(n))))


@query(
    f"""WITH {_QSQL}, {_QE} SELECT qid, CASE WHEN regexp_matches(lower(query), 'who is|tell me about|what do we know about|profile|details on') THEN 'entity_lookup'
WHEN regexp_matches(lower(query), 'connection|relationship|linked|connected|between|path') THEN 'relationship' WHEN regexp_matches(lower(query), 'timeline|chronolog|when did|history of|over time') THEN 'timeline'
WHEN len(names) = 1 AND len(string_split(query, ' ')) <= 4 THEN 'entity_lookup' WHEN len(names) >= 2 THEN 'relationship' ELSE 'search' END AS intent,
len(string_split(query, ' ')) > 12 OR contains(lower(query), ' and ') OR contains(lower(query), ' or ') OR length(query) - length(replace(query, '?', '')) > 1 AS complex FROM e"""
)
def query_intent(spark, sf_dir):
    return _questions(spark).select("qid", qp.intent(F.col("query"), F.size("names")).alias("intent"), qp.is_complex(F.col("query")).alias("complex"))


@query(f"WITH {_QSQL} SELECT qid, array_to_string(list_sort(list_distinct(regexp_extract_all(query, '\\b(19[5-9]\\d|20[0-2]\\d)\\b', 1))), '|') AS dates, array_to_string(regexp_extract_all(query, '(?i)\\b(?:Title\\s+\\d+|Section\\s+\\d+[a-z]?)\\b', 0), '|') AS acts FROM q")
def query_dates(spark, sf_dir):
    return _questions(spark).select("qid", F.array_join(qp.dates(F.col("query")), "|").alias("dates"), F.array_join(qp.statutes(F.col("query")), "|").alias("acts"))


@query(
    f"""WITH {_QSQL}, h AS (SELECT *, nullif(regexp_extract(query, '(?i)\\b(?:from|in|during|year)\\s*(\\d{{4}})\\b', 1), '') AS one, nullif(regexp_extract(query, '\\b(\\d{{4}})\\s*(?:to|-)\\s*(\\d{{4}})\\b', 1), '') AS a,
nullif(regexp_extract(query, '\\b(\\d{{4}})\\s*(?:to|-)\\s*(\\d{{4}})\\b', 2), '') AS b FROM q)
SELECT qid, coalesce(a, one) AS date_from, coalesce(b, one) AS date_to, CASE WHEN regexp_matches(query, '(?i)\\btext\\s+doc') THEN 'TEXT' WHEN regexp_matches(query, '(?i)\\b(?:image|ocr|photo|scan)') THEN 'IMAGE' END AS doc_type FROM h"""
)
def query_filters(spark, sf_dir):
    return _questions(spark).select("qid", qp.filters(F.col("query")).alias("f")).select("qid", "f.*")


@query(
    f"""WITH {_QSQL}, {_QE}, w AS (SELECT qid, string_split_regex(regexp_replace(lower(query), '[^\\w\\s]', ' ', 'g'), '\\s+') AS ws, list_transform(names, lambda n: string_split(lower(n), ' ')) AS hs, regexp_extract_all(query, '\\b(19[5-9]\\d|20[0-2]\\d)\\b', 1) AS ds FROM e)
SELECT qid, array_to_string(list_filter(ws, lambda t: length(t) > 1 AND NOT list_contains(flatten(hs), t) AND NOT list_contains(ds, t) AND NOT list_contains(string_split('{" ".join(qp.STOPWORDS)}', ' '), t)), '|') AS keywords FROM w"""
)
def query_keywords(spark, sf_dir):
    return _questions(spark).select("qid", F.array_join(qp.keywords(F.col("query"), F.col("names")), "|").alias("keywords"))


@query(f"WITH {_QSQL}, {_QE}, d AS (SELECT qid, names, list_sort(regexp_extract_all(query, '\\b(19[5-9]\\d|20[0-2]\\d)\\b', 1)) AS ds FROM e) SELECT qid, ds[1] AS date_from, ds[-1] AS date_to, CASE WHEN len(names) > 0 THEN array_to_string(names, '|') END AS entities FROM d")
def query_structured_filters(spark, sf_dir):
    q = _questions(spark).select("qid", qp.structured_filters(qp.dates(F.col("query")), F.col("names"), qp.statutes(F.col("query"))).alias("f"))
    return q.select("qid", "f.date_from", "f.date_to", F.when(F.col("f.entities").isNotNull(), F.array_join("f.entities", "|")).alias("entities"))


def _answers(spark, sf_dir):
    """Answers that cite some of three sources each: documents qid, qid + 1 and qid + 2."""
    d = docs(spark, sf_dir)
    base = d.where("id % 20 = 0").select(F.col("id").alias("qid"), "text")
    cite = F.when(F.col("qid") % 4 == 0, " [Source 1] and [source 3] [Source 9].").when(F.col("qid") % 4 == 1, " [Source 2].").when(F.col("qid") % 4 == 2, " The date could not find a place.").otherwise(".")
    answers = base.select("qid", F.concat(F.substring("text", 1, 200), cite).alias("answer"))
    hits = base.select("qid", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")).withColumn("id", F.col("qid") + F.col("rank") - 1).join(d.select("id", "text"), "id")
    return answers, hits


_ANS = """b AS (SELECT doc_id AS qid, substr(text, 1, 200) || CASE doc_id % 4 WHEN 0 THEN ' [Source 1] and [source 3] [Source 9].' WHEN 1 THEN ' [Source 2].' WHEN 2 THEN ' The date could not find a place.' ELSE '.' END AS answer FROM documents WHERE doc_id % 20 = 0),
h AS (SELECT qid, r AS n, doc_id AS id, text FROM b, (SELECT unnest([1, 2, 3]) AS r), documents WHERE doc_id = qid + r - 1),
c AS (SELECT b.qid, h.n, h.id, h.text FROM (SELECT DISTINCT qid, unnest(regexp_extract_all(answer, '(?i)\\[Source\\s*(\\d+)\\]', 1))::INT AS n FROM b) b JOIN h ON h.qid = b.qid AND h.n = b.n)"""
_W3 = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+', 0), lambda w: length(w) >= 3))"


@query(f"WITH {_ANS} SELECT qid, n, id FROM c")
def citation_map(spark, sf_dir):
    return generation.citations(*_answers(spark, sf_dir)).select("qid", "n", "id")


@query(
    f"""WITH {_ANS}, w AS (SELECT qid, count(*) AS n, list_distinct(flatten(list({_W3.format('text')}))) AS w FROM c GROUP BY qid),
a AS (SELECT b.qid, answer, coalesce(n, 0) AS n, len(list_intersect({_W3.format('answer')}, w)) / len({_W3.format('answer')})::DOUBLE AS s, contains(lower(answer), 'could not find') AS honest FROM b LEFT JOIN w USING (qid))
SELECT qid, CASE WHEN honest THEN 'high' WHEN n = 0 THEN 'low' WHEN s > 0.4 AND n >= 2 THEN 'high' ELSE 'medium' END AS confidence, honest OR n > 0 AS is_grounded, n::BIGINT AS n_citations FROM a"""
)
def grounding(spark, sf_dir):
    return generation.grounding(*_answers(spark, sf_dir)).select("qid", "confidence", "is_grounded", "n_citations")


@query("WITH h AS (SELECT item_id // 5 AS qid, item_id, text, row_number() OVER (PARTITION BY item_id // 5 ORDER BY item_id) AS rank FROM benchmark) SELECT qid, string_agg('[Source ' || rank || '] (File: item' || item_id || ' [via: dense, sparse])' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS sources FROM h GROUP BY qid")
def format_sources(spark, sf_dir):
    from pyspark.sql import Window as W

    b = table(spark, sf_dir, "benchmark").withColumn("qid", F.floor(F.col("item_id") / 5))
    h = b.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("item_id"))).withColumn("doc_filename", F.concat(F.lit("item"), F.col("item_id").cast("string")))
    return generation.sources_text(h.withColumn("retrieval_sources", F.array(F.lit("dense"), F.lit("sparse"))))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'GM_' || o_orderkey WHEN o_orderkey % 3 = 1 AND o_orderkey >= 100 THEN 'AB_C_' || o_orderkey ELSE 'Document' END AS ref FROM orders")
def doc_references(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("see GM_"), key, F.lit(" x"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("see AB_C_"), key)).otherwise("nothing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tx.doc_reference(text).alias("ref"))


@query("SELECT item_id AS id, 'One more question?|Another of them?' AS questions, text AS body FROM benchmark")
def follow_ups(spark, sf_dir):
    answer = F.concat("text", F.lit("\nFOLLOW_UP_QUESTIONS:\n- One more question?\n-  Another of them? \n- no\n"))
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.array_join(generation.follow_ups(answer), "|").alias("questions"), generation.answer_body(answer).alias("body"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'The Alias' WHEN 1 THEN 'Mary-Ann O''Neil' ELSE 'John Van Der Berg' END AS name FROM orders")
def title_names(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.lit("J. DOE ")).when(k == 1, F.lit("Dr. mary-ann o'neil")).otherwise(F.lit("mr JOHN van der berg"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tx.title_name(raw, {"j. doe": "The Alias"}).alias("name"))


@query(
    _CONTEXT
    + f""", sx AS (SELECT qid, id, chunk, len(list_intersect({_W3L.format('query')}, {_W3L.format('substr(text, 1, 4096)')})) / greatest(len({_W3L.format('query')}), 1)::DOUBLE AS score FROM cx)
SELECT qid, id, chunk::BIGINT AS original_rank, round(score, 6) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk)::INT AS rank FROM sx QUALIFY rank <= 3"""
)
def rerank(spark, sf_dir):
    c = _context(spark, sf_dir).select("qid", F.col("chunk").alias("rank"), "query", "text", "id")
    return providers.rerank(c, 3).select("qid", "id", "original_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank")


class _Lengths:
    """Scores a text by its length; fails for one query."""

    def score(self, queries, texts):
        if any(q.startswith("Q3 ") for q in queries):
            raise ConnectionError("no answer")
        return [float(len(t)) for t in texts]


@query("WITH h AS (SELECT conv_id % 7 AS qid, conv_id * 100 + turn AS id, text, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn) AS rank FROM conversations) SELECT qid, id, rank::INT AS original_rank, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN qid = 3 THEN 0 ELSE length(substr(text, 1, 4096)) END DESC, rank)::INT AS rank FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN qid = 3 THEN 0 ELSE length(substr(text, 1, 4096)) END DESC, rank) <= 10")
def rerank_provider(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations").withColumn("qid", F.col("conv_id") % 7)
    h = c.select("qid", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", F.row_number().over(W.partitionBy("qid").orderBy("conv_id", "turn")).alias("rank"), F.concat(F.lit("Q"), F.col("qid").cast("string"), F.lit(" text")).alias("query"))
    # A call is made for each query, so that only the one that fails goes without scores.
    parts = [providers.rerank(h.where(F.col("qid") == q), 10, _Lengths()) for q in range(7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("qid", "id", "original_rank", "rank")


class _Echo:
    """Writes the prompt's last line back, nothing for some, and fails for others."""

    def write(self, prompts):
        if any("fails" in p for p in prompts):
            raise TimeoutError
        return ["  " if "blank" in p else "Re: " + p.strip().splitlines()[-1] for p in prompts]


@query("SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 THEN 'nothing found' ELSE 'Re: item ' || item_id END AS answer FROM benchmark")
def answers_provider(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    prompt = F.concat(F.lit("Question:\n"), F.when(F.col("item_id") % 5 == 0, "blank ").otherwise(""), F.lit("item "), F.col("item_id").cast("string"))
    return providers.answers(b.select(F.col("item_id").alias("qid"), prompt.alias("prompt")), b.select(F.col("item_id").alias("qid"), F.lit("nothing found").alias("answer")), _Echo())


@query(f"WITH s AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(substr(text, 1, 1500), '(Mr|Mrs|Ms|Dr|Prof|Jr|Sr|vs|etc)\\.\\s', '\\1' || chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda x: regexp_replace(replace(x, chr(1), '. '), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10)[1] AS summary FROM documents) SELECT id, summary FROM s WHERE length(summary) > 10")
def summaries(spark, sf_dir):
    return providers.summarize(docs(spark, sf_dir).select("id", "text")).select("id", "summary")


@query(f"WITH {_QSQL} SELECT qid, CASE WHEN length(query) > 5 THEN 'Re: Write this search query out in full, in one line: ' || query ELSE query END AS expanded, 'Re: Write a short passage of a document that would answer: ' || query AS hyde, CASE WHEN len(string_split(query, ' ')) > 12 OR contains(lower(query), ' and ') OR contains(lower(query), ' or ') OR length(query) - length(replace(query, '?', '')) > 1 THEN 3 ELSE 2 END AS n_queries FROM q")
def query_rewrite(spark, sf_dir):
    q = spark.createDataFrame(_QUESTIONS, "qid int, query string")
    return providers.rewrite(q, _Echo()).select("qid", "expanded", "hyde", F.size("all_queries").alias("n_queries"))


@query(f"WITH {_QSQL} SELECT qid, query AS expanded, NULL::VARCHAR AS hyde, 1 AS n_queries FROM q")
def query_rewrite_identity(spark, sf_dir):
    q = spark.createDataFrame(_QUESTIONS, "qid int, query string")
    return providers.rewrite(q).select("qid", "expanded", "hyde", F.size("all_queries").alias("n_queries"))


@query(f"WITH {_QSQL} SELECT qid, upper(query) || '|' || query || ' x' AS variants FROM q")
def query_variants(spark, sf_dir):
    q = spark.createDataFrame(_QUESTIONS, "qid int, query string")
    v = F.array(F.upper("query"), "query", F.concat("query", F.lit(" x")), F.concat(F.lit("  "), F.lower("query"), F.lit("\n")), F.concat("query", F.lit(" X ")))
    return q.select("qid", F.array_join(qp.distinct_variants(v), "|").alias("variants"))


@query(f"WITH {_ORDER_TEXT_SQL} SELECT id, 'PERSON' AS label, name, (instr(text, name) - 1)::INT AS start, (instr(text, name) - 1 + length(name))::INT AS \"end\" FROM rt, (VALUES ('Anna Weber'), ('Paul Stone')) n(name) UNION ALL SELECT id, 'EVENT', 'hearing', (instr(text, 'hearing') - 1)::INT, (instr(text, 'hearing') + 6)::INT FROM rt")
def names_by_rule(spark, sf_dir):
    known = spark.createDataFrame([("Hearing", "EVENT"), ("07", "PERSON"), ("paid", "VERB")], "name string, label string")
    return providers.names(order_texts(spark, sf_dir), dictionary=known)


class _Money:
    """Recognises amounts; labels that don't count, and single characters, are to be left out."""

    def entities(self, texts):
        import re

        found = []
        for t in texts:
            m = re.search(r"\$[\d.]+\d", t)
            found.append([("MONEY", m[0], m.start(), m.end()), ("COLOUR", "red", 0, 3), ("ORG", "x", 0, 1), ("ORG", "123", 0, 3)])
        return found


@query(f"WITH {_ORDER_TEXT_SQL}, m AS (SELECT id, text, regexp_extract(text, '\\$[\\d.]+\\d', 0) AS name FROM rt) SELECT id, 'MONEY' AS label, name, (instr(text, name) - 1)::INT AS start, (instr(text, name) - 1 + length(name))::INT AS \"end\" FROM m")
def names_provider(spark, sf_dir):
    return providers.names(order_texts(spark, sf_dir), provider=_Money())


@query("SELECT item_id AS id, 'Answer from the sources below and cite each as [Source N].' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Question: who?' || chr(10) || chr(10) || 'Then write FOLLOW_UP_QUESTIONS: and three further questions, each on a line that starts with ''- ''.' || chr(10) || chr(10) || 'Answer:' AS qa, 'List the entities in the sources below with their roles, links, dates and places, and cite each as [Source N].' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Question: who?' || chr(10) || chr(10) || 'Answer:' AS entities FROM benchmark")
def prompts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), generation.qa_prompt(F.col("text"), F.lit("who?")).alias("qa"), generation.entity_prompt(F.col("text"), F.lit("who?")).alias("entities"))


@query("WITH h AS (SELECT item_id // 5 AS qid, text, row_number() OVER (PARTITION BY item_id // 5 ORDER BY item_id) AS rank FROM benchmark) SELECT qid, string_agg('[Source ' || rank || '] ' || substr(text, 1, 300), chr(10) || chr(10) ORDER BY rank) AS answer FROM h WHERE rank <= 3 GROUP BY qid")
def extractive_answer(spark, sf_dir):
    from pyspark.sql import Window as W

    b = table(spark, sf_dir, "benchmark").withColumn("qid", F.floor(F.col("item_id") / 5))
    return generation.extractive_answer(b.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("item_id"))), 3)


@query("WITH h AS (SELECT item_id // 5 AS qid, 'GM_' || (100 + item_id) || ' ' || regexp_replace(text, '\\s+', ' ', 'g') AS text, row_number() OVER (PARTITION BY item_id // 5 ORDER BY item_id) AS rank FROM benchmark) SELECT qid, string_agg('**[' || split_part(text, ' ', 1) || ']**' || chr(10) || regexp_replace(text, '^ | $', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS answer FROM h GROUP BY qid")
def raw_answer(spark, sf_dir):
    from pyspark.sql import Window as W

    b = table(spark, sf_dir, "benchmark").withColumn("qid", F.floor(F.col("item_id") / 5))
    text = F.concat(F.lit("GM_"), (100 + F.col("item_id")).cast("string"), F.lit(" "), F.regexp_replace("text", r"\s+", " "))
    return generation.raw_answer(b.select("qid", text.alias("text"), F.row_number().over(W.partitionBy("qid").orderBy("item_id")).alias("rank")))


@query()
def hashed_embeddings(spark, sf_dir):
    e = providers.embed(docs(spark, sf_dir).select("id", "text"), providers.HashingEmbedder(32))
    return e.select("id", F.transform("embedding", lambda v: F.round(v, 5)).alias("embedding"))


class _Sizes:
    """Two numbers a text; fails for texts of a mark."""

    dim = 2

    def embed(self, texts):
        import numpy as np

        return np.array([[len(t), t.startswith("query: ")] for t in texts], np.float32)


@query("SELECT doc_id AS id, 7 + least(length(coalesce(text, '')), 8192) AS n, 1 AS prefixed FROM documents")
def embed_prefixed(spark, sf_dir):
    e = providers.embed(docs(spark, sf_dir).select("id", "text"), _Sizes(), prefix="query: ")
    return e.select("id", F.col("embedding")[0].cast("long").alias("n"), F.col("embedding")[1].cast("int").alias("prefixed"))


_RAW_HEAD = "12:30:45 \n 7 \n12 Then Oo O DN OO FF WwW NY =| On Oa bh x 9 and oR1234 5 rough draft only, esquire deposition solutions 954 331-4400\nPage 1 to 2 of 30 and 4 of 9 sheets https://x.example/y http:/z\n 123 \n"
_RAW_TAIL = "\n  GM_12 \n"


def _raw_sql() -> str:
    """The steps of a raw view in RE2, which has no look-ahead: what follows is kept by a group."""
    steps = [(p.replace("(?md)", "(?m)").replace("(?d)", ""), "") for p in tx.RAW_NOISE]
    steps = [(p.replace("(?=[A-Z])", "([A-Z])"), "\\1") if "(?=" in p else (p, to) for p, to in steps]
    steps += [(r"\n{3,}", "\n\n"), (" {2,}", " "), (r"(?m)^[^\S\n]+|[^\S\n]+$", ""), (r"^\s+|\s+$", "")]
    out = "t"
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for p, to in steps:
        out = f"regexp_replace({out}, {quoted(p)}, {quoted(to)}, 'g')"
    head, tail = quoted(_RAW_HEAD), quoted(_RAW_TAIL)
    return f"WITH n AS (SELECT doc_id AS id, {head} || text || {tail} AS t FROM documents) SELECT id, {out} AS text FROM n"


@query(_raw_sql())
def raw_view(spark, sf_dir):
    """Whole documents between lines that the rules are for."""
    return docs(spark, sf_dir).select("id", tx.raw_view(F.concat(F.lit(_RAW_HEAD), "text", F.lit(_RAW_TAIL))).alias("text"))


@query("WITH c AS (SELECT doc_id AS id, length(coalesce(text, '')) AS original_length FROM documents) SELECT id, original_length FROM c JOIN documents ON doc_id = id WHERE regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\s]', '', 'g') <> ''")
def clean_batch(spark, sf_dir):
    """Documents whose text is empty once cleaned go."""
    return tx.clean_batch(docs(spark, sf_dir)).where("cleaned_length > 0").select("id", "original_length")
