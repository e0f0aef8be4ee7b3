"""The engine's surface: documents, search, chat, intelligence, graph, evaluation and metrics as methods.

An Engine holds tables, not results; every method returns a DataFrame, or a
dict of DataFrames. Absent parts (no vectors, no mentions) switch off what needs
them, as an engine without that artefact would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import query as qp
from marlstone.operators import compress, entities, evaluate, evidence, generation, graph, providers, scoring, search
from marlstone.sources import corpus

# Hits of each list, of a result, and factors by which a search looks further than it returns.
DENSE_K, SPARSE_K, SUMMARY_K, ENTITY_K, TOP_K = 50, 50, 30, 20, 10
OVERFETCH, RAW_OVERFETCH = 5, 3


class Engine:
    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame | None = None, summaries: DataFrame | None = None, mentions: DataFrame | None = None, edges: DataFrame | None = None, log: DataFrame | None = None, index: search.Bm25Index | None = None, reranker: providers.Reranker | None = None, writer: providers.Writer | None = None):
        """chunks (id, text, doc_type, doc_filename); vectors and summaries (id, embedding); mentions as in
        operators.entities; edges (src, dst, weight, type, chunks); log as in operators.evaluate; index: a
        saved BM25 index, built here otherwise; reranker and writer (a language model) have offline defaults."""
        self.spark, self.chunks, self.vectors, self.summaries, self.mentions, self.edges, self.log = spark, chunks, vectors, summaries, mentions, edges, log
        self.index = index or search.Bm25Index.build(chunks)
        self.reranker, self.writer = reranker, writer

    def status(self) -> dict[str, bool]:
        return {name: getattr(self, name) is not None for name in ("chunks", "vectors", "summaries", "mentions", "edges", "log")}

    # Documents
    def documents(self, page: int = 1, per_page: int = 20, doc_type: str | None = None) -> DataFrame:
        return corpus.page(self.chunks, page, per_page, doc_type)

    def document(self, name: str) -> DataFrame:
        return corpus.get_document(self.chunks, name)

    def document_search(self, query: str, page: int = 1, per_page: int = 20) -> DataFrame:
        return corpus.substring_search(self.chunks, query, page, per_page)

    def document_stats(self) -> DataFrame:
        return corpus.corpus_stats(self.chunks)

    # Search and chat
    def parse(self, queries: DataFrame) -> DataFrame:
        """queries (qid, query) with entities, dates, acts, intent, keywords and filters."""
        q = queries
        if self.mentions is not None:
            names = entities.counts(self.mentions).select("name", "count")
            found = entities.best_by_name(entities.dictionary_match(q.select("qid", F.col("query").alias("text")), names, "qid").join(names, "name"))
            q = q.join(found.groupBy("qid").agg(F.array_sort(F.collect_list("name")).alias("names")), "qid", "left")
        else:
            q = q.withColumn("names", F.lit(None).cast("array<string>"))
        q = q.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
        query = F.col("query")
        return q.select("*", qp.dates(query).alias("dates"), qp.statutes(query).alias("legal_acts"), qp.intent(query, F.size("names")).alias("intent"), qp.keywords(query, F.col("names")).alias("keywords"), qp.filters(query).alias("filters"))

    def retrieve(self, queries: DataFrame, k: int, keyword: str | None = None, doc_type: str | None = None) -> DataFrame:
        """Fused hits of queries (qid, query[, embedding[, hyde]]); hyde, the vector of a hypothetical passage, stands in
        for the query's in the dense list where it is given."""
        lists = {"sparse": search.long_hits(self.index.search(queries.select("qid", "query"), SPARSE_K), self.chunks)}
        if self.vectors is not None and "embedding" in queries.columns:
            asked = queries.withColumn("embedding", F.coalesce("hyde", "embedding")) if "hyde" in queries.columns else queries
            lists = {"dense": search.dense_topk(self.vectors, asked, DENSE_K)} | lists
        if self.summaries is not None and "embedding" in queries.columns:
            lists["summary"] = search.dense_topk(self.summaries, queries, SUMMARY_K)
        if self.mentions is not None:
            asked = self.parse(queries.select("qid", "query")).select("qid", F.explode("names").alias("name"))
            lists["entity"] = entities.retrieve(self.mentions, asked, ENTITY_K).select("qid", "id", "rank")
        return search.hybrid(lists, self.chunks, k, keyword=keyword, doc_type=doc_type, similar=True)

    def search(self, queries: DataFrame, k: int = TOP_K, keyword: str | None = None, raw: bool = False, **filters) -> DataFrame:
        """Retrieval, metadata filters, composite scores if entities are known, reranking."""
        hits = search.filter_metadata(self.retrieve(queries, k * (RAW_OVERFETCH if raw else OVERFETCH), keyword), **filters).drop("rank")
        score = "rrf_score"
        if self.mentions is not None:
            parsed = self.parse(queries.select("qid", "query"))
            counts = entities.counts(self.mentions)
            asked = parsed.select("qid", F.explode("names").alias("name")).join(counts, "name")
            more = parsed.join(asked.groupBy("qid").agg(F.max("n_docs").alias("max_docs")), "qid", "left").select("qid", "dates", "max_docs")
            hits = scoring.score(hits, scoring.entity_components(hits, self.mentions, asked), None, more)
            score = "composite_score"
        ranked = search.top_k(hits, k * OVERFETCH, score)
        return providers.rerank(ranked.join(queries.select("qid", "query"), "qid"), k, self.reranker)

    def chat(self, queries: DataFrame, mode: str = "answer", k: int = TOP_K) -> DataFrame:
        """(qid, answer, confidence, is_grounded, warning, n_citations); mode: answer, raw or evidence."""
        hits = self.search(queries, k, raw=mode == "raw")
        if mode == "raw":
            return generation.raw_answer(hits)
        if mode == "evidence":
            return generation.evidence_answer(self.chains(self.parse(queries.select("qid", "query")).select(F.explode("names").alias("id")).distinct()))
        context = compress.compress(hits.select("qid", F.col("rank").cast("long").alias("chunk"), "query", "text"))
        numbered = context.select("qid", (F.col("chunk") + 1).cast("int").alias("rank"), "text", F.col("chunk").alias("id"))
        answers = generation.extractive_answer(numbered)
        if self.writer is not None:
            named = numbered.withColumns({"doc_filename": F.concat(F.lit("source "), F.col("rank").cast("string")), "retrieval_sources": F.array().cast("array<string>")})
            asked = generation.sources_text(named).join(queries.select("qid", "query"), "qid")
            answers = providers.answers(asked.select("qid", generation.qa_prompt(F.col("sources"), F.col("query")).alias("prompt")), answers, self.writer)
        return answers.join(generation.grounding(answers, numbered), "qid")

    # Intelligence
    def chains(self, starts: DataFrame, hops: int = 2) -> DataFrame:
        """Evidence chains from nodes (id)."""
        paths = evidence.path_chunks(graph.multi_hop(self.edges, starts, hops), self.edges)
        return evidence.chains(paths, self.mentions, self.chunks)

    def entity(self, name: str) -> DataFrame:
        """The profile of the name, or of the one most like it."""
        return entities.profile(self.mentions, entities.resolved(self.mentions, name) or name)

    def path(self, a: str, b: str, cutoff: int = graph.MAX_HOPS) -> DataFrame:
        return graph.simple_paths(self.edges, a, b, cutoff, 10)

    def timeline(self, name: str) -> DataFrame:
        return entities.timeline(self.mentions, name)

    def cluster(self, labels: DataFrame, name: str) -> DataFrame:
        """Members of an entity's community with type and count, most mentioned first."""
        own = labels.where(F.lower("id") == name.lower()).select("community")
        return labels.join(own, "community").join(entities.counts(self.mentions), F.col("id") == F.col("name")).select("id", "type", "count", "n_docs").orderBy(F.desc("count"), "id")

    def intelligence(self, queries: DataFrame, k: int = TOP_K) -> dict[str, DataFrame]:
        """hits, chains and discovered entities of one set of questions; the traversal is made once."""
        hits = self.retrieve(queries, RAW_OVERFETCH * k)
        asked = self.parse(queries.select("qid", "query")).select(F.explode("names").alias("name")).distinct()
        paths = graph.cut(evidence.path_chunks(graph.multi_hop(self.edges, asked.select(F.col("name").alias("id"))), self.edges))
        best = scoring.graph_scores(paths.withColumn("qid", F.lit(0))).select("id", "graph")
        graphed = hits.select("qid", "id").distinct().join(best, "id").select("qid", "id", "graph")
        scored = search.top_k(scoring.score(hits.drop("rank"), None, graphed), k, "composite_score")
        confidence = scored.groupBy("qid").agg(scoring.confidence(F.max("composite_score")).alias("confidence"))
        return {"hits": scored, "chains": evidence.chains(paths, self.mentions, self.chunks), "discovered": evidence.discovered(paths, asked), "confidence": confidence}

    # Graph
    def graph_entities(self, query: str, limit: int = 50) -> DataFrame:
        return entities.search(entities.counts(self.mentions), query, limit)

    def graph_entity(self, name: str) -> DataFrame:
        return graph.node_detail(graph.build_nodes(self.mentions), self.edges, name)

    def relationship(self, a: str, b: str) -> DataFrame:
        return graph.relationship(self.edges, a, b)

    def traverse(self, name: str, hops: int = graph.MAX_HOPS, min_weight: int = 0, types: list[str] | None = None) -> DataFrame:
        start = self.spark.createDataFrame([(name,)], "id string")
        return graph.multi_hop(graph.usable(self.edges, min_weight, types), start, hops)

    def neighborhood(self, name: str, depth: int = 2, min_weight: int = 0) -> tuple[DataFrame, DataFrame]:
        return graph.neighborhood(self.edges, name, depth, min_weight)

    def graph_data(self) -> tuple[DataFrame, DataFrame]:
        return graph.export(graph.build_nodes(self.mentions), self.edges)

    def communities(self, resolution: float = 1.0) -> DataFrame:
        return graph.communities(self.edges, resolution)

    # Evaluation and metrics
    def evaluate(self, benchmark: DataFrame, k: int = TOP_K) -> DataFrame:
        """Means by category and over all, of benchmark (qid, query, category, expected_keywords)."""
        hits = self.search(benchmark.select("qid", "query"), k).join(benchmark.select("qid", "expected_keywords"), "qid")
        metrics = evaluate.at_k(evaluate.keyword_relevance(hits), k)
        return evaluate.by_category(metrics.join(benchmark.select("qid", "category"), "qid"))

    def metrics(self) -> DataFrame:
        return evaluate.summary(self.log)

    def reset_metrics(self) -> None:
        self.log = self.log.limit(0)
