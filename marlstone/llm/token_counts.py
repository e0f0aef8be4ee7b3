"""Token counts without token ids.

Texts are cut where no token of the tokenizer's merges can cross: into runs of
other characters with the space before them, and runs of white space as the
tokenizer's own pattern cuts them. The tokenizer counts each distinct such
pre-token of the corpus once. A document's count is the sum over its pre-token
frequencies, which meet the counted vocabulary in a join (token_sums).

Strings of added tokens inside a text are one token each, as the library does
by default. A null text counts as empty: 0 bytes, 0 tokens. Texts of any length
are counted whole; a pre-token of over 256 characters is counted where it
stands. Rows with equal or null doc_id are counted separately; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, read, stored
from .token_sums import LONG, hot, sum_over_tokens, vocabulary

#: Characters with Unicode's White_Space property.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def added(path: str) -> re.Pattern | None:
    tokens = tokenizer(path).get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
        raise ValueError("added tokens that take white space or need word ends aren't supported")
    strings = sorted((t.content for t in tokens), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, strings))) if strings else None


def pre_tokens(text: str, path: str) -> list[str]:
    special = added(path)
    if special is None or not special.search(text):
        return PRE_TOKEN.findall(text)
    out, at = [], 0
    for m in special.finditer(text):
        out += PRE_TOKEN.findall(text[at : m.start()])
        out.append(m[0])
        at = m.end()
    return out + PRE_TOKEN.findall(text[at:])


def count_pieces(vocab: DataFrame, path: str) -> DataFrame:
    """vocab with ``pieces``: how many tokens each of its entries has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n = [len(e) for i in range(0, len(texts), 2000) for e in t.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["token", "n", "pieces"])

    return in_arrow(vocab.select("token", "n"), count, "token string, n long, pieces long")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens."""
    path = path or tokenizer_path()
    split = functools.partial(pre_tokens, path=path)
    table = stored(count_pieces(vocabulary(docs, split, LONG), path))
    total = table.agg(F.sum("n")).first()[0] or 0

    def alone(token: str) -> float:
        return len(tokenizer(path).encode(token, add_special_tokens=False).ids)

    def extra(texts: list) -> list[pa.Array]:
        return [pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())]

    out = sum_over_tokens(docs, split, table, "pieces", hot(table, total, "pieces"), alone, extra, "n_bytes long")
    return out.select("doc_id", "n_bytes", F.col("value__").cast("long").alias("n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)
