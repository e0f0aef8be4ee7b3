"""Retrieval: BM25, exact dense top-k, rank fusion, metadata filters.

Every operator takes a DataFrame of queries (with ``qid``), so a batch is one
plan; ranks and limits are per query and ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.sources.shared import kept, new_folder

# BM25 parameters; a negative idf becomes EPSILON times the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
# Rank fusion constant, list weights, keyword boost.
RRF_K = 60
WEIGHTS = {"dense": 1.0, "sparse": 1.0, "summary": 0.8, "entity": 1.2}
KEYWORD_BOOST = 1.3
#: Query vectors that are held by each task at once; more are searched in blocks.
QUERY_BLOCK, MAX_QUERIES = 4096, 1_000_000
#: Folders of postings, and query terms that are looked up as conditions of the scan.
TERM_BUCKETS, PRUNED = 16, 10_000
STATS = "n long, avgdl double, mean_idf double, buckets int"


def top_k(scored: DataFrame, k: int, score: str = "score", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best rows of each query with ``rank`` from 1; scores that differ only by rounding are ties."""
    w = W.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bucket_of(buckets: int, term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Bm25Index:
    """postings(id, term, tf, dl, bucket), terms(term, df, idf), stats(n, avgdl, mean_idf, buckets): stored tables.

    Postings are laid out by a hash of their term, in folders of a bucket and sorted within, so that a search reads
    the lists of its own terms.
    """

    NAMES = ("postings", "terms", "stats")

    def __init__(self, postings: DataFrame, terms: DataFrame, stats: DataFrame):
        self.postings, self.terms, self.stats = postings, terms, stats

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, buckets: int = TERM_BUCKETS) -> Bm25Index:
        """From (id, text). The texts are tokenised once; the tables are kept at path, or in the shared folder."""
        spark = docs.sparkSession
        path = path or new_folder(spark)
        rows = docs.select("id", tx.tokens(F.col("text")).alias("toks")).select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
        counted = rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")).withColumn("bucket", bucket_of(buckets))
        # The list of a frequent term is dealt over as many tasks as there are to each bucket.
        deal = F.pmod(F.xxhash64("id"), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)))
        counted.repartition("bucket", deal).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        schema = T.StructType([docs.schema["id"], *T.StructType.fromDDL("term string, tf long, dl int, bucket int").fields])
        postings = spark.read.schema(schema).parquet(f"{path}/postings")
        n = docs.count()
        df = kept(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")))
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean, total = df.agg(F.avg(raw), F.sum("tf")).first()
        idf = F.when(raw < 0, EPSILON * (mean or 0.0)).otherwise(raw)
        df.select("term", "df", idf.alias("idf")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        stats = spark.createDataFrame([(n, (total or 0) / max(n, 1), mean, buckets)], STATS)
        stats.write.mode("overwrite").parquet(f"{path}/stats")
        return cls(postings, spark.read.schema("term string, df long, idf double").parquet(f"{path}/terms"), spark.read.schema(STATS).parquet(f"{path}/stats"))

    def save(self, path: str) -> None:
        for name in self.NAMES:
            table = getattr(self, name)
            (table.write.partitionBy("bucket") if name == "postings" else table.write).mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in cls.NAMES))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, rank) for queries (qid, query); rows with a score of 0 or less are no hits."""
        asked = queries.select("qid", F.explode(tx.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
        buckets = self.stats.first().buckets
        words = asked.select("term").distinct().select("term", bucket_of(buckets).alias("b")).limit(PRUNED + 1).collect()
        postings, terms = self.postings, self.terms
        if len(words) <= PRUNED:  # few enough to be conditions of the scan; beyond, the join alone selects
            names = [r.term for r in words]
            postings = postings.where(F.col("bucket").isin(sorted({r.b for r in words})) & F.col("term").isin(names))
            terms = terms.where(F.col("term").isin(names))
        hits = postings.join(asked.join(terms, "term"), "term").crossJoin(F.broadcast(self.stats.select("avgdl")))  # stats is one row
        tf = F.col("tf")
        part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = hits.groupBy("qid", "id").agg(F.sum(part).alias("score")).where("score > 0")
        return top_k(scored, k)


def unit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors divided by their length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(F.col(column), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return vectors.withColumn(column, F.when(norm > 0, F.transform(column, lambda x: (x / norm).cast("float"))).otherwise(F.col(column)))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, dims: int | None = None) -> DataFrame:
    """(qid, id, score, rank): exact cosine search of queries (qid, embedding) over vectors (id, embedding).

    Queries come to the driver and are broadcast in blocks; at most MAX_QUERIES of them, as a table of more is better
    split. Each task keeps k candidates a query, so what shuffles does not grow with the vectors of a partition.
    dims: use the first dimensions only.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if queries.count() > MAX_QUERIES:
        raise ValueError(f"over {MAX_QUERIES} queries: search them in parts")
    wanted = queries.select("qid", "embedding").toArrow()
    qids, matrix = wanted.column("qid").to_pylist(), _matrix(wanted.column("embedding").combine_chunks(), dims)
    kind, id_kind = queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    qid_type, id_type = wanted.schema.field("qid").type, to_arrow_type(vectors.schema["id"].dataType)
    parts = None
    for at in range(0, max(len(qids), 1), QUERY_BLOCK):
        shared = vectors.sparkSession.sparkContext.broadcast((qids[at : at + QUERY_BLOCK], matrix[at : at + QUERY_BLOCK]))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, block = shared.value
            held: list[list[tuple[float, object]]] = [[] for _ in names]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                if not ids or not names:
                    continue
                scores = block @ _matrix(batch.column(1), dims).T
                for q, row in enumerate(scores):
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    held[q] += [(row[i], ids[i]) for i in np.flatnonzero(row >= least)]
                    held[q] = sorted(held[q], key=lambda x: (-x[0], x[1]))[:k]
            flat = [(names[q], i, float(s)) for q, h in enumerate(held) for s, i in h]
            cols = list(zip(*flat)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], qid_type), pa.array(cols[1], id_type), pa.array(cols[2], pa.float64())], ["qid", "id", "score"])

        one = vectors.select("id", "embedding").mapInArrow(best, f"qid {kind}, id {id_kind}, score double")
        parts = one if parts is None else parts.unionByName(one)
    return top_k(parts, k)


def _matrix(lists: pa.Array, dims: int | None) -> np.ndarray:
    """Rows of unit length."""
    if not len(lists):
        return np.zeros((0, dims or 1))
    m = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(lists), -1)[:, :dims]
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists (qid, id, rank from 1): (qid, id, rrf_score, retrieval_sources in the order of lists)."""
    weights = weights or WEIGHTS
    parts = None
    for i, (name, df) in enumerate(lists.items()):
        part = df.select("qid", "id", (F.lit(weights[name]) / (RRF_K + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("src"))
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("qid", "id").agg(F.sum("part").alias("rrf_score"), F.array_sort(F.collect_set("src")).alias("srcs"))
    return merged.select("qid", "id", "rrf_score", F.col("srcs.name").alias("retrieval_sources"))


def keyword_boost(fused: DataFrame, keyword: Column | str, text: str = "text", score: str = "rrf_score") -> DataFrame:
    """Scores of rows whose text contains the keyword, any case, times KEYWORD_BOOST."""
    word = F.lit(keyword) if isinstance(keyword, str) else keyword
    return fused.withColumn(score, F.when(F.contains(F.lower(text), F.lower(word)), F.col(score) * KEYWORD_BOOST).otherwise(F.col(score)))


def drop_similar(ranked: DataFrame, order: str = "rrf_score") -> DataFrame:
    """Rows of each query in score order without those whose text repeats a kept one's.

    A text's middle is 300 characters from its first quarter on, its start characters 51 to 250, or all of a text of
    at most 250; both stripped, any case. Texts repeat if their middles are equal, or share over 0.6 of the larger
    set of trigrams, or if their starts share over 0.7. A query has at most some hundred candidates, so each query's
    greedy pass is one group.
    """
    import pandas as pd

    def grams(s: str) -> set[str]:
        return {s[i : i + 3] for i in range(len(s) - 2)}

    def share(a: set[str], b: set[str]) -> float:
        return len(a & b) / max(len(a), len(b), 1)

    def extracts(text: str) -> tuple[str, set[str], set[str]]:
        quarter = len(text) // 4
        middle = text[quarter : quarter + 300].strip().lower()
        start = (text if len(text) <= 250 else text[50:250]).strip().lower()
        return middle, grams(middle), grams(start)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "id"], ascending=[False, True])
        held, rows = [], []
        for i, text in enumerate(pdf["text"].fillna("")):
            new = extracts(text)
            if not any(new[0] == old[0] or share(new[1], old[1]) > 0.6 or share(new[2], old[2]) > 0.7 for old in held):
                held.append(new)
                rows.append(i)
        return pdf.iloc[rows]

    return ranked.groupBy("qid").applyInPandas(run, ranked.schema)


def long_hits(hits: DataFrame, chunks: DataFrame, over: int = 50) -> DataFrame:
    """hits (qid, id, score, rank) of texts with more than ``over`` characters, ranked anew."""
    held = hits.join(chunks.where(F.length("text") > over).select("id"), "id", "left_semi")
    return held.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank")))


def with_summaries(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    """hits with the summary text of their chunk (id, summary), null where there is none."""
    return hits.join(summaries.select("id", "summary"), "id", "left")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """An index of (id, embedding, ...): unit vectors, as a dense search needs them."""
    unit(vectors).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Adds vectors to a saved index; of ids that it has, nothing is added."""
    known = vectors.sparkSession.read.parquet(path).select("id")
    unit(vectors).join(known, "id", "left_anti").write.mode("append").parquet(path)


def hybrid(lists: dict[str, DataFrame], chunks: DataFrame, k: int, keyword: str | None = None, doc_type: str | None = None, similar: bool = False) -> DataFrame:
    """Fused hits with their chunk's columns, filtered and limited: the first 3k candidates are looked at.

    A doc_type filter comes before the removal of similar texts, so a row that
    is filtered out suppresses none.
    """
    rows = fuse(lists).join(chunks, "id")
    if keyword:
        rows = keyword_boost(rows, keyword)
    rows = rows.where(F.length("text") >= 30)
    if doc_type:
        rows = rows.where(F.upper("doc_type") == doc_type.upper())
    rows = top_k(rows, 3 * k, "rrf_score").drop("rank")
    return top_k(drop_similar(rows) if similar else rows, k, "rrf_score")


def filter_metadata(
    rows: DataFrame,
    doc_type: str | None = None,
    entities: list[str] | None = None,
    source_files: list[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    min_length: int | None = None,
    exclude_keywords: list[str] | None = None,
) -> DataFrame:
    """Conjunction of metadata predicates over (text, doc_type, doc_filename); a bound that is no number filters nothing."""
    low = F.lower("text")
    if doc_type:
        rows = rows.where(F.upper("doc_type") == doc_type.upper())
    if entities:
        rows = rows.where(_any(F.contains(low, F.lit(e.lower())) for e in entities))
    if source_files:
        rows = rows.where(F.lower("doc_filename").isin([s.lower() for s in source_files]))
    if date_from or date_to:
        rows = rows.where(in_years(F.col("text"), date_from, date_to))
    if min_length:
        rows = rows.where(F.length("text") >= min_length)
    if exclude_keywords:
        rows = rows.where(~_any(F.contains(low, F.lit(x.lower())) for x in exclude_keywords))
    return rows


def in_years(text: Column, date_from: str | None, date_to: str | None) -> Column:
    """No year in the text, or any within the bounds."""
    try:
        low, high = int(date_from or 0), int(date_to or 9999)
    except ValueError:
        return F.lit(True)
    found = tx.years(text)
    return (F.size(found) == 0) | F.exists(found, lambda y: y.cast("int").between(low, high))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
