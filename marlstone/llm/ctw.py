"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision's context is the byte's bits so
far and up to DEPTH earlier bytes. Every node of these context trees has a
Krichevsky-Trofimov estimate, and a node's probability mixes its own estimate
with the product of its children's, half and half: the mixture over all depths.
The corpus gives the counts of all windows of DEPTH+1 bytes; from these each
subtree (contexts that end in the same two bytes) is weighted by itself, and
depths 0 and 1 (at most 256 * 255 nodes) on the driver.

For scoring the trees are frozen. A node that never occurred passes on the
mixture of the depths above it. The log probability of byte y after context s is
then tabulated for each (s, y) that occurred; other bytes share what s leaves
over, in proportion to the next shorter context, so each context's probabilities
sum to 1. Nothing that was counted is left out: each subtree gives every window
that occurs in the texts to be scored its log probability, and these are stored.
Windows with at least 2**-SHARE_BITS of all bytes (at most 2**SHARE_BITS) are
broadcast and summed where a text is read; the others meet the stored table in a
join, which thus has no frequent key.

Texts are lower-cased (A-Z) and end with an end symbol (byte FF, which UTF-8
never uses). Null counts as empty; the empty text is the end alone. Beside the
score each text gets the unigram score of its words over the same training
texts (token_sums). With nothing to learn from, every byte has probability
2**-8, and the unigram model has no words. Rows with equal or null doc_id are
scored separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, in_arrow, read, stored
from .hashtable import find, hashed
from .token_sums import hot, sum_over_tokens, vocabulary

DEPTH = 5
#: Says which windows are broadcast; it has no effect on the scores.
SHARE_BITS = 22
END = 255
#: Bytes of text that are worked on at once.
CHUNK = 2 << 20
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def words(text: str) -> list[str]:
    """Lower-cased words, then the end."""
    return [*WORD.findall(text.encode().translate(LOWER).decode()), ""]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code (context << 8 | byte) of every byte and end of the texts, and each text's number of them."""
    pad = bytes([END]) * DEPTH
    flat = np.frombuffer(pad + (bytes([END]) + pad).join(texts) + bytes([END]), np.uint8)
    n = np.array([len(t) + 1 for t in texts])
    code = np.zeros(len(flat) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        code = (code << np.uint64(8)) | flat[k : len(flat) - DEPTH + k]
    ends = np.cumsum(n + DEPTH) - DEPTH
    keep = np.ones(len(code) + DEPTH, bool)
    keep[(ends[:, None] + np.arange(DEPTH)).ravel()] = False
    return code[keep[: len(code)]], n


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        b = (t or "").encode().translate(LOWER)
        part.append(b)
        size += len(b)
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def window_counts(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(code, n) over the texts of docs, and n = 0 for windows that only the texts of asked have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code = np.concatenate([c for c, _ in held])
            order = np.argsort(code, kind="stable")
            code, n = code[order], np.concatenate([n for _, n in held])[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            return code[first], np.add.reduceat(n, first)

        for batch in batches:
            for part in _chunks(batch.column(0).to_pylist()):
                held.append(np.unique(windows(part)[0], return_counts=True))
                if sum(len(c) for c, _ in held) > 1_500_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield _pairs(*held.pop())
        if held:
            yield _pairs(*merged())

    counted = in_arrow(docs.select("text"), count, "code long, n long")
    if asked is not None:
        counted = counted.union(in_arrow(asked.select("text"), count, "code long, n long").withColumn("n", F.lit(0).cast("long")))
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def _pairs(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, brought back."""
    x = np.asarray(x, float)
    back = np.zeros_like(x)
    for k in range(8):
        back += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - back


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def mixed(acc: np.ndarray, mass: np.ndarray, deepest: np.ndarray) -> np.ndarray:
    """The mixture of the depths so far; the deepest alone where their weights are too small to tell."""
    return np.where(mass > 1e-290, acc / np.maximum(mass, 1e-290), deepest)


class Level:
    """The entries (context, byte) of one depth and the binary nodes that their bits pass."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.code, self.n = code, n
        y = (code & np.uint64(255)).astype(np.int64)
        base = code & ~np.uint64(255)
        prefix = [(1 << i) | (y >> (8 - i)) for i in range(8)]
        self.bit = [((y >> (7 - i)) & 1).astype(bool) for i in range(8)]
        keys = np.concatenate([base | p.astype(np.uint64) for p in prefix])
        self.nodes, at = np.unique(keys, return_inverse=True)
        self.at = at.reshape(8, -1)
        ones = np.concatenate(self.bit)
        m = np.tile(n, 8)
        self.n1 = np.bincount(at, m * ones, len(self.nodes))
        self.n0 = np.bincount(at, m * ~ones, len(self.nodes))
        self.kt = log_kt(self.n0, self.n1)
        self.theta = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)

    def weigh(self, below: Level | None, up: np.ndarray | None) -> None:
        """log_w of each node, and the share that its own estimate has; up: for each node of below, its parent here."""
        if below is None:
            self.log_w, self.share = self.kt, np.ones(len(self.kt))
            return
        children = np.bincount(up, below.log_w, len(self.nodes))
        self.log_w = np.logaddexp(self.kt, children) - math.log(2)
        self.share = np.exp(self.kt - math.log(2) - self.log_w)

    def mix(self, acc: np.ndarray, mass: np.ndarray, rest: np.ndarray) -> None:
        """Of each node's parent: the probability of a 1 from the depths above, their weight, and the weight that is left."""
        self.acc = acc + rest * self.share * self.theta
        self.mass = mass + rest * self.share
        self.rest = rest * (1 - self.share)

    def log_p(self) -> np.ndarray:
        """log of the byte's probability for each entry, by the depths down to this one."""
        p = np.clip(mixed(self.acc, self.mass, self.theta), 1e-12, 1 - 1e-12)
        return sum(np.log(np.where(b, p[a], 1 - p[a])) for a, b in zip(self.at, self.bit))


def _shorter(code: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    code = code & np.uint64((1 << (8 * (depth + 1))) - 1)
    u, at = np.unique(code, return_inverse=True)
    return u, np.bincount(at, n, len(u))


def subtree(code: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """The weighted levels DEPTH to 2 of contexts that share their last two bytes."""
    levels: dict[int, Level] = {}
    below, up = None, None
    for depth in range(DEPTH, 1, -1):
        code, n = _shorter(code, n, depth)
        level = levels[depth] = Level(code, n)
        if below is not None:
            up = np.searchsorted(level.nodes, below.nodes & np.uint64((1 << (8 * (depth + 1))) - 1))
        level.weigh(below, up)
        below = level
    return levels


def _grouped(counts: DataFrame) -> DataFrame:
    return counts.withColumn("tail", F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF)))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(float)


class Model:
    """What scoring needs: a dense table for depths 0 and 1, a hash table for each depth from 2."""

    def __init__(self):
        self.log1 = np.full((256, 256), -math.log(256))
        self.entries: dict[int, tuple] = {}
        self.escapes: dict[int, tuple] = {}

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's probability."""
        code, n = windows(texts)
        return np.add.reduceat(self.log_p(code), np.cumsum(n) - n) / math.log(10) if len(n) else np.zeros(0)

    def log_p(self, code: np.ndarray) -> np.ndarray:
        """log of each window's last byte's probability."""
        out = np.zeros(len(code))
        left = None  # positions without a probability yet
        for depth in range(DEPTH, 1, -1):
            if depth not in self.entries:
                continue
            here = code if left is None else code[left]
            here = here & np.uint64((1 << (8 * (depth + 1))) - 1)
            value = find(self.entries[depth], here)
            got = ~np.isnan(value)
            miss = np.flatnonzero(~got)
            if left is None:
                out[got] = value[got]
                left = miss
            else:
                out[left[got]] += value[got]
                left = left[miss]
            escape = find(self.escapes[depth], here[miss] >> np.uint64(8))
            out[left] += np.nan_to_num(escape, nan=0.0)
        rest = code if left is None else code[left]
        y, x = (rest & np.uint64(255)).astype(int), ((rest >> np.uint64(8)) & np.uint64(255)).astype(int)
        out[slice(None) if left is None else left] += self.log1[x, y]
        return out


def _top(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes of depth 1: probability of a 1 from depths 0 and 1, their weight, the weight that is left; and log1."""

    def depth2(table: pa.Table) -> pa.Table:
        level = subtree(*_arrays(table))[2]
        return pa.table({"node": level.nodes.astype(np.int64) & 0xFFFF, "n0": level.n0, "n1": level.n1, "log_w": level.log_w})

    # At most 256 * 255 rows: a node of depth 1 is the last byte and the bits so far.
    top = counts.where("n > 0").groupBy("tail").applyInArrow(depth2, "node long, n0 double, n1 double, log_w double").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("log_w")).orderBy("node").toArrow()
    node, n0, n1, below = (top.column(c).to_numpy() for c in ("node", "n0", "n1", "log_w"))
    shares, thetas = np.ones((2, 256, 256)), np.full((2, 256, 256), 0.5)
    kt1 = log_kt(n0, n1)
    w1 = np.logaddexp(kt1, below) - math.log(2)
    x, v = node >> 8, node & 255
    shares[1][x, v], thetas[1][x, v] = np.exp(kt1 - math.log(2) - w1), (n1 + 0.5) / (n0 + n1 + 1)
    a0, a1, b = (np.bincount(v, z, 256) for z in (n0, n1, w1))
    kt0 = log_kt(a0, a1)
    shares[0][:] = np.exp(kt0 - math.log(2) - (np.logaddexp(kt0, b) - math.log(2)))[None, :]
    thetas[0][:] = ((a1 + 0.5) / (a0 + a1 + 1))[None, :]
    seen1 = np.zeros((256, 256), bool)
    seen1[x, v] = True
    acc0, mass0, rest0 = shares[0] * thetas[0], shares[0], 1 - shares[0]
    own = np.where(seen1, shares[1], 0)
    acc1, mass1, rest1 = acc0 + rest0 * own * thetas[1], mass0 + rest0 * own, rest0 * (1 - own)
    return acc1, mass1, rest1, _dense(mixed(acc1, mass1, np.where(seen1, thetas[1], thetas[0])))


def _entries(levels: dict[int, Level], top: tuple) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, codes, their log probabilities, contexts, their escapes) of each level from 2."""
    acc1, mass1, rest1, log1 = top
    above, above_p = None, None
    for depth in range(2, DEPTH + 1):
        level = levels[depth]
        if depth == 2:
            x, v = ((level.nodes >> np.uint64(8)) & np.uint64(255)).astype(int), (level.nodes & np.uint64(255)).astype(int)
            level.mix(acc1[x, v], mass1[x, v], rest1[x, v])
            short = log1[((level.code >> np.uint64(8)) & np.uint64(255)).astype(int), (level.code & np.uint64(255)).astype(int)]
        else:
            up = np.searchsorted(above.nodes, level.nodes & np.uint64((1 << (8 * depth)) - 1))
            level.mix(above.acc[up], above.mass[up], above.rest[up])
            short = above_p[np.searchsorted(above.code, level.code & np.uint64((1 << (8 * depth)) - 1))]
        log_p = level.log_p()
        context, at = np.unique(level.code >> np.uint64(8), return_inverse=True)
        left = np.maximum(1 - np.bincount(at, np.exp(log_p), len(context)), 1e-9)
        left_short = np.maximum(1 - np.bincount(at, np.exp(short), len(context)), 1e-9)
        yield depth, level.code, log_p, context, np.log(left) - np.log(left_short)
        above, above_p = level, log_p


def fit(docs: DataFrame) -> Model:
    """The frozen mixture learned from all texts of docs, on the driver: for small corpora; lm_scores has no need of it."""
    counts = _grouped(stored(window_counts(docs)))
    model = Model()
    if counts.isEmpty():
        return model
    top = _top(counts)
    model.log1 = top[3]
    for depth, code, log_p, context, escape in _entries(subtree(*_arrays(counts.orderBy("code").toArrow())), top):
        model.entries[depth], model.escapes[depth] = hashed(code, log_p), hashed(context, escape)
    return model


def window_values(counts: DataFrame) -> DataFrame:
    """(code, n, log_p) of all windows of counts, by the mixture learned from those with n > 0."""
    shared = counts.sparkSession.sparkContext.broadcast(_top(counts))

    def values(table: pa.Table) -> pa.Table:
        code, n = _arrays(table)
        model = Model()
        model.log1 = shared.value[3]
        out, seen = np.zeros(len(code)), n > 0
        if seen.any():
            for depth, entry, log_p, context, escape in _entries(subtree(code[seen], n[seen]), shared.value):
                if not seen.all():
                    model.entries[depth], model.escapes[depth] = hashed(entry, log_p), hashed(context, escape)
            out[seen] = log_p[np.searchsorted(entry, code[seen])]  # of the last depth, whole windows
        if not seen.all():
            out[~seen] = model.log_p(code[~seen])
        return pa.table({"code": code.astype(np.int64), "n": n.astype(np.int64), "log_p": out})

    return _grouped(counts).groupBy("tail").applyInArrow(values, "code long, n long, log_p double")


def _mark(text: str | None) -> int:
    """A 63-bit hash of the text, below 0: no code has that value."""
    return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little") - (1 << 64) >> 1


def window_sums(docs: DataFrame, train: DataFrame, asked: DataFrame) -> DataFrame:
    """(key_id, mark, score): the log10 probability of each distinct pair of doc_id and text of docs.

    asked: the rows of docs that may have texts which train doesn't have.
    """
    spark = docs.sparkSession
    counts = stored(window_counts(train, asked))
    table = stored(window_values(_grouped(counts)))
    total = table.agg(F.sum("n")).first()[0] or 0
    got = table.where((F.col("n") > 0) & (F.col("n") * F.lit(1 << SHARE_BITS) >= F.lit(total))).select("code", "log_p").toArrow()
    frequent = spark.sparkContext.broadcast(hashed(got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column(1).to_pylist(), 0
            for part in _chunks(texts):
                code, n = windows(part)
                value = find(frequent.value, code).astype(float)
                cold = np.flatnonzero(np.isnan(value))
                value[cold] = 0
                sums = np.add.reduceat(value, np.cumsum(n) - n)
                mark = np.array([_mark(t) for t in texts[start : start + len(n)]], np.int64)
                doc = np.repeat(np.arange(len(n)), n)[cold]
                at = pa.array(np.concatenate([np.arange(len(n)), doc]) + start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        pa.array(np.concatenate([mark, mark[doc]])),
                        # A text's own row has its mark for a code: it meets nothing, and isn't one key as null would be.
                        pa.array(np.concatenate([mark, code[cold].astype(np.int64)])),
                        pa.concat_arrays([pa.array(sums), pa.nulls(len(doc), pa.float64())]),
                    ],
                    ["key_id", "mark", "code", "sum__"],
                )
                start += len(n)

    schema = T.StructType([T.StructField("key_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("mark long, code long, sum__ double").fields])
    met = in_arrow(docs.select("doc_id", "text"), walk, schema).join(table.select("code", "log_p"), "code", "left")
    # Rows that agree in doc_id and text add the same, so their sum over their number is that of each.
    return met.groupBy("key_id", "mark").agg((F.sum(F.coalesce("sum__", "log_p")) / F.count("sum__") / math.log(10)).alias("score"))


def _dense(p: np.ndarray) -> np.ndarray:
    """log probabilities of all 256 bytes for each row of node probabilities of a 1."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    out = np.zeros((len(p), 256))
    y = np.arange(256)
    for i in range(8):
        q = p[:, (1 << i) | (y >> (8 - i))]
        out += np.log(np.where((y >> (7 - i)) & 1 == 1, q, 1 - q))
    return out


def lm_scores(docs: DataFrame, train: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    asked: the rows of docs that are not in train, where that is known.
    """
    table = stored(vocabulary(train, words))
    total, distinct = table.agg(F.sum("n"), F.count("n")).first()
    total = total or 0
    low = math.log10(0.1) - math.log10(total + 0.1 * (distinct + 1))
    table = table.withColumn("log_p", F.log10(F.col("n") + F.lit(0.1)) - F.lit(math.log10(total + 0.1 * (distinct + 1))) - F.lit(low))

    def extra(texts: list) -> list[pa.Array]:
        n = [len((t or "").encode().split()) + 1 for t in texts]
        return [pa.array(n, pa.int64()), pa.array([_mark(t) for t in texts], pa.int64())]

    # value__ sums what known tokens have above an unknown one's log probability.
    base = sum_over_tokens(docs, words, table, "log_p", hot(table, total, "log_p"), None, extra, "n_tokens long, mark__ long")
    scores = window_sums(docs, train, docs if asked is None else asked)
    out = base.join(scores, base.doc_id.eqNullSafe(scores.key_id) & (base.mark__ == scores.mark))
    return out.select("doc_id", "n_tokens", F.col("known__").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("value__") + F.col("n_tokens") * F.lit(low)).alias("base_score"), "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 10) == 0
    scored = lm_scores(docs, docs.where(~held_out), docs.where(held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
