"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (id, text, doc_type, doc_filename)."""
    kind = F.when(F.col("lang") == "en", "TEXT").otherwise("IMAGE")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", kind.alias("doc_type"), F.col("source").alias("doc_filename"))


DOCS = "docs AS (SELECT doc_id AS id, text, CASE WHEN lang = 'en' THEN 'TEXT' ELSE 'IMAGE' END AS doc_type, source AS doc_filename FROM documents)"


def mentions(spark: SparkSession, sf_dir: str, types: bool = True) -> DataFrame:
    """Brands (and part types) of order lines as mentions in orders: (name, type, chunk_id, doc_id, year, ord)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    rows = line.join(part, line.l_partkey == part.p_partkey).join(order, line.l_orderkey == order.o_orderkey)
    kinds = [F.struct(F.col("p_brand").alias("name"), F.lit("BRAND").alias("type"))] + ([F.struct(F.col("p_type").alias("name"), F.lit("TYPE").alias("type"))] if types else [])
    each = rows.select(F.explode(F.array(*kinds)).alias("m"), "l_orderkey", "o_custkey", "year", "l_linenumber")
    return each.select("m.name", "m.type", F.col("l_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), "year", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))


_LINES = """lines AS (SELECT p_brand, p_type, l_orderkey AS chunk_id, o_custkey AS doc_id, year(o_orderdate) AS year, l_orderkey * 100 + l_linenumber AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
BRANDS = _LINES + ", mentions AS (SELECT p_brand AS name, 'BRAND' AS type, chunk_id, doc_id, year, ord FROM lines)"
MENTIONS = _LINES + """, mentions AS (SELECT p_brand AS name, 'BRAND' AS type, chunk_id, doc_id, year, ord FROM lines
  UNION ALL SELECT p_type, 'TYPE', chunk_id, doc_id, year, ord FROM lines)"""


def load() -> None:
    """Imports every module of queries."""
    from . import entity_queries, eval_queries, graph_queries, search_queries, stream_queries, text_queries  # noqa: F401
