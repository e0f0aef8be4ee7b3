"""Prompts, answers and their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx

# Citation form, phrases of an honest "not found", marker of follow-up questions, grounding bounds.
CITATION = r"(?i)\[Source\s*(\d+)\]"
NOT_FOUND = (
    "could not find",
    "not found in",
    "no information",
    "does not appear",
    "not available",
    "i don't know",
    "cannot determine",
    "no relevant information",
    "not in the provided",
    "not mentioned in",
)
FOLLOW_UP = "FOLLOW_UP_QUESTIONS:"
OVERLAP, MIN_CITATIONS = 0.4, 2
WARNING = "No source is cited, so the answer may not rest on the documents."


def sources_text(hits: DataFrame) -> DataFrame:
    """(qid, sources): numbered sources of hits (qid, rank, doc_filename, retrieval_sources, text)."""
    via = F.when(F.size("retrieval_sources") > 0, F.concat(F.lit(" [via: "), F.array_join("retrieval_sources", ", "), F.lit("]"))).otherwise("")
    one = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] (File: "), F.col("doc_filename"), via, F.lit(")\n"), F.col("text"))
    return hits.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", one.alias("t"))))["t"], "\n\n").alias("sources"))


def qa_prompt(sources: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer from the sources below and cite each as [Source N].\n\n"), sources, F.lit("\n\nQuestion: "), question, F.lit(f"\n\nThen write {FOLLOW_UP} and three further questions, each on a line that starts with '- '.\n\nAnswer:"))


def entity_prompt(sources: Column, question: Column) -> Column:
    return F.concat(F.lit("List the entities in the sources below with their roles, links, dates and places, and cite each as [Source N].\n\n"), sources, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, n, id, text) of answers (qid, answer): each cited source once, if there is one of that number."""
    n = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int")))
    return answers.select("qid", F.explode(n).alias("n")).join(hits.select("qid", F.col("rank").alias("n"), "id", "text"), ["qid", "n"])


def grounding(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, confidence, is_grounded, warning, n_citations) of answers (qid, answer)."""
    cited = citations(answers, hits)
    words = cited.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_list(tx.words3(F.col("text"))))).alias("w"))
    rows = answers.join(words, "qid", "left")
    own = tx.words3(F.col("answer"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(own, "w")), F.size(own)), F.lit(0.0))
    honest = F.lit(False)
    for p in NOT_FOUND:
        honest = honest | F.contains(F.lower("answer"), F.lit(p))
    n = F.coalesce("n", F.lit(0))
    level = F.when(honest, "high").when(n == 0, "low").when((share > OVERLAP) & (n >= MIN_CITATIONS), "high").otherwise("medium")
    return rows.select("qid", level.alias("confidence"), (honest | (n > 0)).alias("is_grounded"), F.when(~honest & (n == 0), WARNING).alias("warning"), n.cast("long").alias("n_citations"))


def follow_ups(answer: Column, most: int = 3) -> Column:
    """Questions after the marker, over five characters each."""
    rest = F.split(answer, FOLLOW_UP, 2)
    lines = F.transform(F.split(F.coalesce(F.get(rest, F.lit(1)), F.lit("")), "\n"), lambda x: tx.stripped(F.regexp_replace(tx.stripped(x), r"^[- ]+", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 5), 1, most)


def answer_body(answer: Column) -> Column:
    return tx.stripped(F.get(F.split(answer, FOLLOW_UP, 2), F.lit(0)))


def raw_answer(hits: DataFrame) -> DataFrame:
    """(qid, answer): the hits' texts with their references, for reading as they are."""
    one = F.concat(F.lit("**["), tx.doc_reference(F.col("text")), F.lit("]**\n"), tx.raw_view(F.col("text")))
    return hits.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", one.alias("t"))))["t"], "\n\n---\n\n").alias("answer"))


def evidence_answer(chains: DataFrame) -> DataFrame:
    """(answer): the chains' descriptions with confidence, one row."""
    one = F.concat(F.col("chain").cast("string"), F.lit(". "), F.col("description"), F.lit(" ("), F.format_number(F.col("confidence"), 3), F.lit(")"))
    return chains.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.struct("chain", one.alias("t"))))["t"], "\n"), F.lit("")).alias("answer"))


def extractive_answer(hits: DataFrame, most: int = 5, chars: int = 300) -> DataFrame:
    """(qid, answer) without a language model: the beginnings of the best hits."""
    one = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, chars))
    return hits.where(F.col("rank") <= most).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", one.alias("t"))))["t"], "\n\n").alias("answer"))
