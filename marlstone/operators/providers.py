"""Model-dependent steps behind small protocols, each with a deterministic default that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import query as qp
from marlstone.functions import text as tx
from marlstone.functions.extract import places

# Characters that go into an embedding, a reranking and a summary, and texts of one call.
EMBED_CHARS, RERANK_CHARS, SUMMARY_CHARS, BATCH = 8192, 4096, 1500, 96


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashed word counts, of unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(rows: DataFrame, provider: Embedder, text: str = "text", prefix: str = "", times: int = 5) -> DataFrame:
    """rows with ``embedding``, null where the provider fails that often; calls of BATCH texts. prefix: stands before
    each text, as some models want it for queries."""
    cut = rows.withColumn("embed__", F.concat(F.lit(prefix), F.substring(F.coalesce(text, F.lit("")), 1, EMBED_CHARS)))
    return called(cut, lambda t: [[float(x) for x in v] for v in provider.embed(t)], ["embed__"], "embedding", "array<float>", times=times).drop("embed__")


class Reranker(Protocol):
    """Scores of pairs of a query and a text."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class Writer(Protocol):
    """Answers of a language model to prompts."""

    def write(self, prompts: list[str]) -> list[str]: ...


class Recogniser(Protocol):
    """Entities (label, name, start, end) of each text."""

    def entities(self, texts: list[str]) -> list[list[tuple[str, str, int, int]]]: ...


def tried(call, *args, times: int = 3):
    """The call's result, or None where it fails that many times."""
    for _ in range(times):
        try:
            return call(*args)
        except Exception:  # a provider may fail in any way; its caller has a result without it
            continue
    return None


def called(rows: DataFrame, call, columns: list[str], to: str, kind: str, batch: int = BATCH, times: int = 3) -> DataFrame:
    """rows with ``to``: what call gives for lists of the columns' values, ``batch`` rows at a time; null where it fails."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for i in range(0, len(pdf), batch):
                part = [pdf[c].iloc[i : i + batch].tolist() for c in columns]
                got = tried(call, *part, times=times)
                out += list(got) if got is not None else [None] * len(part[0])
            yield pdf.assign(**{to: pd.Series(out, index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, f"{fields}, `{to}` {kind}")


def lexical(query: Column, text: Column) -> Column:
    """The share of the query's words in the text."""
    q = tx.words3(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tx.words3(F.substring(text, 1, RERANK_CHARS)))), F.size(q)), F.lit(0.0))


def rerank(hits: DataFrame, k: int = 10, provider: Reranker | None = None) -> DataFrame:
    """hits (qid, rank, query, text) with original_rank and rerank_score, best k first. Without a provider the score is
    the share of the query's words in the text. Equal scores keep their order, and so does a query for which the
    provider fails (three times for a batch): its scores are null."""
    if provider is None:
        scored = hits.withColumn("rerank_score", lexical(F.col("query"), F.col("text")))
    else:
        cut = hits.withColumn("text__", F.substring(F.coalesce("text", F.lit("")), 1, RERANK_CHARS))
        given = called(cut, lambda q, t: [float(x) for x in provider.score(q, t)], ["query", "text__"], "rerank_score", "double").drop("text__")
        whole = F.count("rerank_score").over(W.partitionBy("qid")) == F.count(F.lit(1)).over(W.partitionBy("qid"))
        scored = given.withColumn("whole__", whole).withColumn("rerank_score", F.when(F.col("whole__"), F.col("rerank_score"))).drop("whole__")
    ranked = scored.withColumnRenamed("rank", "original_rank")
    w = W.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), "original_rank")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def answers(prompts: DataFrame, fallback: DataFrame, provider: Writer | None = None) -> DataFrame:
    """(qid, answer) of prompts (qid, prompt) by a language model; those of fallback (qid, answer) where there is no
    model, or it fails, or its answer is blank."""
    if provider is None:
        return fallback.select("qid", "answer")
    got = called(prompts.select("qid", "prompt"), provider.write, ["prompt"], "written", "string").select("qid", F.nullif(tx.stripped(F.col("written")), F.lit("")).alias("written"))
    return got.join(fallback.select("qid", "answer"), "qid", "full").select("qid", F.coalesce("written", "answer").alias("answer"))


def summarize(chunks: DataFrame, provider: Writer | None = None) -> DataFrame:
    """chunks (id, text) with a summary of over ten characters: a model's, or else the first sentence."""
    head = F.substring("text", 1, SUMMARY_CHARS)
    first = F.get(tx.sentences(head, 10), F.lit(0))
    if provider is None:
        return chunks.withColumn("summary", first).where(F.length("summary") > 10)
    asked = chunks.withColumn("prompt__", F.concat(F.lit("Summarise in one or two sentences, with names, dates and places:\n\n"), F.coalesce(head, F.lit(""))))
    got = called(asked, provider.write, ["prompt__"], "summary", "string").drop("prompt__").withColumn("summary", tx.stripped(F.col("summary")))
    return got.withColumn("summary", F.when(F.length("summary") > 10, F.col("summary")).otherwise(first)).where(F.length("summary") > 10)


def rewrite(queries: DataFrame, provider: Writer | None = None, most: int = 3) -> DataFrame:
    """queries (qid, query) with expanded, hyde (a hypothetical passage), sub_queries and all_queries.

    Without a model, the query itself. A model's expansion counts with over five characters, its passage with over
    twenty; only complex queries are cut into at most ``most`` parts, of over five characters each.
    """
    none = F.array().cast("array<string>")
    if provider is None:
        return queries.select("*", F.col("query").alias("expanded"), F.lit(None).cast("string").alias("hyde"), none.alias("sub_queries"), F.array("query").alias("all_queries"))
    complex_ = qp.is_complex(F.col("query"))
    prompts = {
        "expanded": F.concat(F.lit("Write this search query out in full, in one line: "), F.col("query")),
        "hyde": F.concat(F.lit("Write a short passage of a document that would answer: "), F.col("query")),
        "sub_queries": F.concat(F.lit("Cut this question into simpler ones, one a line: "), F.col("query")),
    }
    out = queries
    for name, prompt in prompts.items():
        out = called(out.withColumn("prompt__", prompt), provider.write, ["prompt__"], f"{name}__", "string").drop("prompt__")
    line = lambda x: tx.stripped(F.regexp_replace(tx.stripped(x), r"^(?:[-*]|\d+[.)])\s*", ""))
    plain = F.trim(tx.stripped(F.col("expanded__")), F.lit("\"'"))
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce("sub_queries__", F.lit("")), "\n"), line), lambda x: F.length(x) > 5), 1, most)
    out = out.withColumns({"expanded": F.when(F.length(plain) > 5, plain).otherwise(F.col("query")), "hyde": F.when(F.length(tx.stripped(F.col("hyde__"))) > 20, tx.stripped(F.col("hyde__"))), "sub_queries": F.when(complex_, lines).otherwise(none)})
    return out.drop(*(f"{n}__" for n in prompts)).withColumn("all_queries", qp.distinct_variants(F.concat(F.array("query", "expanded"), F.col("sub_queries"))))


# Labels that names may have, and characters of a text that are looked at.
NAME_LABELS = ("PERSON", "ORG", "GPE", "LOC", "DATE", "MONEY", "NORP", "FAC", "EVENT", "LAW")
NAME_CHARS = 80_000
#: Entries of a dictionary that is sent to all tasks; a larger one and the words are dealt by word.
DICTIONARY = 100_000
_RUN = r"(?U)\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"


def names(chunks: DataFrame, key: str = "id", text: str = "text", provider: Recogniser | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """(key, label, name, start, end) by a recogniser, or by rule: runs of two or more capitalised words, and words of
    a dictionary (name, label). Only NAME_LABELS count, and no names of one character or of digits only."""
    rows = chunks.select(key, F.substring(F.coalesce(F.col(text), F.lit("")), 1, NAME_CHARS).alias("text__"))
    kind = "array<struct<label:string,name:string,start:int,end:int>>"
    if provider is not None:
        got = called(rows, lambda t: [[{"label": a, "name": n, "start": s, "end": e} for a, n, s, e in x] for x in provider.entities(t)], ["text__"], "found__", kind)
        found = got.select(key, F.explode("found__").alias("x"))
    else:
        runs = F.transform(places(F.col("text__"), _RUN), lambda m: F.struct(F.lit("PERSON").alias("label"), m["name"].alias("name"), m["start"].alias("start"), m["end"].alias("end")))
        found = rows.select(key, F.explode(runs).alias("x"))
        if dictionary is not None:
            words = rows.select(key, F.explode(places(F.col("text__"), r"(?U)\w+")).alias("m"))
            known = dictionary.select(F.col("name").alias("n__"), F.col("label").alias("l__"))
            # Left to itself, Spark may send the words to all tasks: it doesn't know how many a text gives.
            known = F.broadcast(known) if known.limit(DICTIONARY + 1).count() <= DICTIONARY else known.hint("merge")
            met = words.join(known, F.lower("m.name") == F.lower("n__"))
            found = found.unionByName(met.select(key, F.struct(F.col("l__").alias("label"), F.col("m.name").alias("name"), F.col("m.start").alias("start"), F.col("m.end").alias("end")).alias("x")))
    out = found.select(key, "x.label", tx.stripped(F.col("x.name")).alias("name"), "x.start", "x.end")
    return out.where(F.col("label").isin(*NAME_LABELS) & (F.length("name") >= 2) & ~F.col("name").rlike(r"^\d+$"))
