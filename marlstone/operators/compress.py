"""Context compression: relevant sentences of each chunk, none twice, in a diverse order within a budget."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as tx

# Characters of the budget, share and least number of sentences kept, diversity weight,
# sentence length from which repeats go, and characters a cut chunk must have.
BUDGET, SHARE, LEAST, LAMBDA, REPEAT, CUT = 24_000, 0.6, 3, 0.7, 20, 100


def scored_sentences(chunks: DataFrame) -> DataFrame:
    """(qid, chunk, pos, sentence, score) of chunks (qid, chunk, query, text)."""
    q = tx.words3(F.col("query"))
    rows = chunks.select("qid", "chunk", q.alias("q"), F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    rows = rows.withColumn("words", tx.words3(F.col("sentence"))).where(F.size("words") > 0)
    shared = F.size(F.array_intersect("q", "words")) / F.greatest(F.size("q"), F.lit(1))
    capital = F.regexp_count("sentence", F.lit(r"(?<!\S)\p{Lu}"))
    digits = F.col("sentence").rlike(r"\d{4}").cast("int")
    return rows.select("qid", "chunk", "pos", "sentence", (shared + 0.05 * capital + 0.1 * digits).alias("score"))


def best_sentences(sentences: DataFrame) -> DataFrame:
    """The top SHARE of each chunk's sentences, LEAST at the least."""
    w = W.partitionBy("qid", "chunk")
    ranked = sentences.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "pos")))
    return ranked.where(F.col("r") <= F.greatest(F.lit(LEAST), F.floor(F.col("n") * 6 / 10))).drop("n", "r")


def first_occurrences(sentences: DataFrame) -> DataFrame:
    """Sentences that did not occur in a chunk before, by lower-cased words; short ones always stay."""
    norm = F.lower(F.regexp_replace(tx.stripped(F.col("sentence")), r"\s+", " "))
    w = W.partitionBy("qid", norm).orderBy("chunk", "pos")
    return sentences.withColumn("r", F.row_number().over(w)).where((F.col("r") == 1) | (F.length("sentence") < REPEAT)).drop("r")


def joined(sentences: DataFrame) -> DataFrame:
    """(qid, chunk, text): sentences in their order."""
    lists = sentences.groupBy("qid", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    return lists.select("qid", "chunk", F.array_join("s.sentence", " ").alias("text"))


def mmr(chunks: DataFrame) -> DataFrame:
    """chunks (qid, chunk, query, text, relevance) with ``chunk`` renumbered: relevance against likeness to those chosen.

    Only queries with more than three chunks change. A query has few chunks, so
    each query's greedy choice is one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk").reset_index(drop=True)
        if len(pdf) > 3:
            sets = [set(re.findall(r"\w{3,}", t.lower())) for t in pdf["text"]]
            number = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
            held = np.zeros((len(pdf), len(number) + 1), np.float32)
            for row, words in zip(held, sets):
                row[[number[w] for w in words]] = 1
            common, sizes = held @ held.T, held.sum(axis=1)
            jaccard = common / np.maximum(sizes[:, None] + sizes - common, 1)
            order, worth, nearest = [], LAMBDA * pdf["relevance"].to_numpy(float), np.zeros(len(pdf))
            for _ in range(len(pdf)):
                order.append(int(np.argmax(worth - (1 - LAMBDA) * nearest)))
                worth[order[-1]] = -np.inf
                nearest = np.maximum(nearest, jaccard[order[-1]])
            pdf = pdf.iloc[order].reset_index(drop=True)
        return pdf.assign(chunk=range(len(pdf)))

    return chunks.groupBy("qid").applyInPandas(run, chunks.schema)


def trim(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Chunks in order while they fit; the first that does not is cut if over CUT characters are left, and ends the list."""
    w = W.partitionBy("qid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    rows = chunks.withColumn("left", budget - before)
    fits = F.length("text") <= F.col("left")
    cut = F.concat(F.expr("substring(text, 1, left)"), F.lit("..."))
    return rows.where(fits | (F.col("left") > CUT)).withColumn("text", F.when(fits, F.col("text")).otherwise(cut)).drop("left")


def compress(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(qid, chunk, text) of chunks (qid, chunk, query, text) after all steps; what is left of a chunk must have over
    REPEAT characters, and its relevance is the share of the query's words in it."""
    kept = joined(first_occurrences(best_sentences(scored_sentences(chunks)))).where(F.length(tx.stripped(F.col("text"))) > REPEAT)
    asked = chunks.select("qid", "chunk", "query", tx.words3(F.col("query")).alias("q"))
    rows = kept.join(asked, ["qid", "chunk"])
    relevance = F.size(F.array_intersect("q", tx.words3(F.col("text")))) / F.greatest(F.size("q"), F.lit(1))
    return trim(mmr(rows.select("qid", F.col("chunk").cast("long").alias("chunk"), "query", "text", relevance.alias("relevance"))), budget).select("qid", "chunk", "text")
