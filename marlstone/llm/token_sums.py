"""Sums over a document's tokens of a value that a corpus-wide table gives each token.

The table (a vocabulary) grows with the corpus, so it can't be broadcast. Its
frequent part can: at most 2**HOT_BITS tokens have a share of 2**-HOT_BITS of
all tokens. Tasks sum over these while they read a text, and only the rest of a
document's token frequencies shuffle to meet the table. This also leaves no
frequent key in that join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Tokens with a share of at least 2**-HOT_BITS are broadcast: 2**20 entries of at most HOT_CHARS characters bound it.
HOT_BITS = 20
HOT_CHARS = 32
#: Entries that a task gathers before it sends them on.
GATHER = 400_000
#: Longer tokens hardly repeat; where the value is a function of the token alone, they get it where they stand.
LONG = 256

Split = Callable[[str], Iterable[str]]


def vocabulary(docs: DataFrame, split: Split, longest: int | None = None) -> DataFrame:
    """(token, n): how often each token (of at most ``longest`` characters) occurs in the texts of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text or ""))
                if len(seen) > GATHER:
                    yield out()
        yield out()

    counted = in_arrow(docs.select("text"), count, "token string, n long")
    if longest is not None:
        counted = counted.where(F.length("token") <= longest)
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def hot(table: DataFrame, total: int, value: str) -> dict[str, float]:
    """value of the frequent tokens of a table with columns token, n and value; total: the sum of n."""
    rows = table.where((F.col("n") * F.lit(1 << HOT_BITS) >= F.lit(total)) & (F.length("token") <= HOT_CHARS)).select("token", F.col(value).cast("double"))
    got = rows.toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def sum_over_tokens(docs: DataFrame, split: Split, table: DataFrame, value: str, frequent: dict[str, float], alone: Callable[[str], float] | None, extra: Callable[[list], list[pa.Array]], extra_schema: str) -> DataFrame:
    """One row per row of docs: doc_id, the extra columns, ``value__`` (the sum over tokens with a value) and ``known__`` (how many those are).

    alone: gives tokens of over LONG characters their value; without it they
    meet the table like others. extra: the extra columns of a list of texts.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(frequent)
    rows = docs.select(F.monotonically_increasing_id().alias("row__"), "doc_id", "text")
    fields = T.StructType.fromDDL(extra_schema).fields
    schema = T.StructType([rows.schema["row__"], T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields, *T.StructType.fromDDL("value__ double, known__ long, kind__ int, token string, times__ long").fields])
    arrow = [T_to_arrow(f.dataType) for f in schema.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = given.value
        get = values.get
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sums, known, where, token, times = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for row, text in zip(ids, texts):
                tokens = list(split(text or ""))
                found = [v for v in map(get, tokens) if v is not None]
                total, n = sum(found), len(found)
                if n < len(tokens):
                    for t, k in Counter(t for t in tokens if t not in values).items():
                        if alone is not None and len(t) > LONG:
                            total += alone(t) * k
                            n += k
                        else:
                            where.append(row)
                            token.append(t)
                            times.append(k)
                sums.append(total)
                known.append(n)
            more = extra(texts)
            n, m = len(texts), len(where)
            columns = [(batch.column(0), where), (batch.column(1), None), *((x, None) for x in more), (sums, None), (known, None), ([0] * n, [1] * m), ([f"{i}" for i in ids], token), (None, times)]
            whole = [pa.concat_arrays([_array(a, t, n), _array(b, t, m)]) for (a, b), t in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(whole, [f.name for f in schema])

    walked = in_arrow(rows, walk, schema)
    # kind__ keeps the rows of documents, keyed by their own number, apart from tokens.
    joined = walked.join(table.select(F.lit(1).alias("kind__"), "token", F.col(value).cast("double").alias("v__")), ["kind__", "token"], "left")
    return joined.groupBy("row__").agg(
        F.max("doc_id").alias("doc_id"),
        *(F.max(f.name).alias(f.name) for f in fields),
        F.sum(F.coalesce("value__", F.lit(0.0)) + F.coalesce(F.col("times__") * F.col("v__"), F.lit(0.0))).alias("value__"),
        F.sum(F.coalesce("known__", F.when(F.col("v__").isNotNull(), F.col("times__")), F.lit(0))).alias("known__"),
    )


def T_to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _array(x, kind: pa.DataType, n: int) -> pa.Array:
    if x is None:
        return pa.nulls(n, kind)
    return x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind)
