"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams (blended spectrum: 2 to 4 bytes,
presence only, A-Z lower-cased) that both have, out of those that at least
MIN_LANDMARKS landmark texts have, or all those of a language with fewer, and is
normalised to 1 for a text with itself. Landmarks span the Nystroem features K(x, L) K(L, L)^-1/2, on which one
kernel ridge regression is fitted for each language against the rest. Both fold
into one matrix, so scoring a batch is two products: presence by landmark, and
landmark by language.

Fitting uses a bounded sample of the labelled rows, with the bounds as parameters
of ``train``: of each label at most ``per_language`` texts, chosen by a seeded
hash, of at most ``max_chars`` characters each and ``language_chars`` together;
a label that only has longer texts gives slices of these, from the first letter
on. No label is left out. Of these, at most ``landmarks`` in all, dealt evenly
over the labels, but one of each at the least, are landmarks. Scoring takes every
text whole.

Prediction: ``und`` with score 0 if a text is null or has no letter, or if there
is nothing to learn from; else the language of the largest output f (ties: first
label in order) with score (f + 1) / 2 cut to 0..1. Rows may repeat or share a
doc_id. An empty table gives no rows. Columns other than text are carried by
``classify`` and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, in_arrow, parts_of, read

PER_LANGUAGE = 400
MAX_CHARS = 20_000
LANGUAGE_CHARS = 2_000_000
LANDMARKS, LANDMARKS_PER_LANGUAGE = 2560, 40
MIN_LANDMARKS = 3
RIDGE = 1e-2
NONE = "und"
SLOT_BITS = 19
#: Bytes of text and rows that are worked on at once.
CHUNK = 1 << 20
ROWS = 512
#: Cells of a presence matrix that is worked on at once.
CELLS = 1 << 22
GOLD = np.uint32(0x9E37_79B1)


def has_letter(text: str) -> bool:
    """A character of Unicode's categories L, as ``\\p{L}`` has them."""
    return any(map(str.isalpha, text))


def _codes(flat: np.ndarray, n: int) -> np.ndarray:
    """The 32-bit code of the n bytes that start at each place; the first byte's bits tell lengths apart."""
    code = np.full(len(flat) - n + 1, 0, np.uint32)
    for k in range(n):
        code = (code << np.uint32(8)) | flat[k : len(flat) - n + 1 + k]
    return code


#: Each length's codes go into a space of their own by another multiplier.
TURN = {2: np.uint32(0x85EB_CA6B), 3: np.uint32(0xC2B2_AE35), 4: GOLD}


def grams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, row, code) of all n-grams of the texts; none crosses texts."""
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    for n in TURN:
        if len(flat) >= n:
            inside = row[: len(flat) - n + 1] == row[n - 1 :]
            yield n, row[: len(flat) - n + 1][inside], _codes(flat, n)[inside]


class Kernel:
    """The n-grams in use and what maps a text's n-grams to languages."""

    def __init__(self, known: dict[int, np.ndarray]):
        self.size = sum(map(len, known.values()))
        self.rows = max(1, min(ROWS, CELLS // max(self.size, 1)))
        self.slots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at = 0
        for n, codes in known.items():
            # Open addressing: code -> column, -1 for an empty slot.
            bits = max(SLOT_BITS, int(2 * len(codes)).bit_length())
            slot, keys = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint32)
            for i, c in enumerate(codes.tolist()):
                s = int(self.slot(np.array([c], np.uint32), n, bits)[0])
                while slot[s] >= 0:
                    s = (s + 1) & ((1 << bits) - 1)
                slot[s], keys[s] = at + i, c
            self.slots[n] = (slot, keys)
            at += len(codes)

    @staticmethod
    def slot(code: np.ndarray, n: int, bits: int) -> np.ndarray:
        return ((code * TURN[n]) >> np.uint32(32 - bits)).astype(np.int64)

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """Rows of 0 and 1: which n-grams a text has."""
        out = np.zeros(len(texts) * self.size, np.uint8)
        for n, row, code in grams(texts):
            slot, keys = self.slots[n]
            bits = len(slot).bit_length() - 1
            s = self.slot(code, n, bits)
            while len(s):
                column = slot[s]
                hit = (column >= 0) & (keys[s] == code)
                out[row[hit].astype(np.int64) * self.size + column[hit]] = 1
                on = (column >= 0) & ~hit
                row, code, s = row[on], code[on], (s[on] + 1) & ((1 << bits) - 1)
        return out.reshape(len(texts), self.size)

    def to_landmarks(self, texts: list[bytes]) -> np.ndarray:
        p = self.presence(texts).astype(np.float32)
        own = np.sqrt(np.maximum(p.sum(axis=1), 1))
        return (p @ self.landmarks) / own[:, None]

    def fit(self, marks: list[bytes], texts: list[bytes], labels: list[str]) -> None:
        blocks = lambda texts: (texts[i : i + self.rows] for i in range(0, len(texts), self.rows))
        self.landmarks = np.empty((self.size, len(marks)), np.float32)
        for at, block in zip(range(0, len(marks), self.rows), blocks(marks)):
            p = self.presence(block).astype(np.float32)
            self.landmarks[:, at : at + len(block)] = (p / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]).T
        within = np.concatenate([self.to_landmarks(block) for block in blocks(marks)]).astype(float)
        values, vectors = np.linalg.eigh((within + within.T) / 2)
        ok = values > 1e-6 * values[-1]
        nystroem = vectors[:, ok] / np.sqrt(values[ok])
        x = np.concatenate([self.to_landmarks(block) for block in blocks(texts)]) @ nystroem
        self.languages = sorted(set(labels))
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        middle, offset = x.mean(axis=0), y.mean(axis=0)
        x = x - middle
        w = np.linalg.solve(x.T @ x + RIDGE * len(x) * np.eye(x.shape[1]), x.T @ (y - offset))
        self.matrix = (nystroem @ w).astype(np.float32)
        self.offset = (offset - middle @ w).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [NONE] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and has_letter(t)]
        at = 0
        while at < len(some):
            part, size = [], 0
            while at < len(some) and len(part) < self.rows and size < CHUNK:
                part.append(some[at])
                size += len(texts[some[at]])
                at += 1
            f = self.to_landmarks([texts[i].encode().translate(LOWER) for i in part]) @ self.matrix + self.offset
            best = f.argmax(axis=1)
            scores[part] = np.clip((f[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for i, b in zip(part, best.tolist()):
                names[i] = self.languages[b]
        return names, scores


def train(labelled: DataFrame, seed: int = 42, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS, language_chars: int = LANGUAGE_CHARS, landmarks: int = LANDMARKS) -> Kernel | None:
    """A kernel from the rows of labelled (text, lang); None if no text has a label and a letter."""
    usable = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = usable.select("lang", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), (F.length("text") <= max_chars).alias("short"))
    short = F.count_if("short")
    per_label = rows.groupBy("lang").agg(F.when(short > 0, short).otherwise(F.count("h")).alias("n"), (short == 0).alias("long"))
    found = per_label.orderBy("lang").collect()  # a row for each label
    counts = {r.lang: r.n for r in found}
    if not counts:
        return None
    # The hash's lowest part holds somewhat more than the sample of each language.
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language + 50) / F.col("n"))
    low = F.when(share < 1, (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).cast("long")).otherwise(F.lit(2**63 - 1))
    bounds = per_label.select("lang", "long", low.alias("low"))
    slice_ = F.when(F.col("short"), F.col("text")).otherwise(F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{max_chars - 1}}}", 0)).alias("text")
    near = rows.join(F.broadcast(bounds), "lang").where((F.col("short") | F.col("long")) & (F.col("h") <= F.col("low"))).select("h", "lang", slice_).dropDuplicates(["h", "lang"])
    # A few hundred rows of each label are left, so no label makes a large partition here.
    w = W.partitionBy("lang").orderBy("h")
    before = F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1))
    held = near.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.row_number().over(w)).where((F.col("n") <= per_language) & (F.col("before") < language_chars))
    drawn = sorted((r.h, r.lang, r.text) for r in held.select("h", "lang", "text").collect())
    marks_each = max(1, min(LANDMARKS_PER_LANGUAGE, landmarks // len(counts)))
    texts, labels, marks, owners, taken = [], [], [], [], dict.fromkeys(counts, 0)
    for _, lang, text in drawn:
        taken[lang] += 1
        raw = text.encode().translate(LOWER)
        texts.append(raw)
        labels.append(lang)
        if taken[lang] <= marks_each:
            marks.append(raw)
            owners.append(lang)
    few = [np.flatnonzero(np.array(owners) == lang) for lang in counts if min(taken[lang], marks_each) < MIN_LANDMARKS]
    known = {}
    for n, row, code in grams(marks):
        pairs = np.unique(row.astype(np.uint64) << np.uint64(32) | code)
        mark, code = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFF_FFFF)).astype(np.uint32)
        codes, times = np.unique(code, return_counts=True)
        known[n] = codes[times >= min(MIN_LANDMARKS, len(marks))]
        for own in few:
            codes, times = np.unique(code[np.isin(mark, own)], return_counts=True)
            known[n] = np.union1d(known[n], codes[times >= len(own)])
    kernel = Kernel(known)
    kernel.fit(marks, texts, labels)
    return kernel


def classify(docs: DataFrame, kernel: Kernel | None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, named by label and score (such columns of docs are replaced)."""
    docs = docs.drop(label, score)
    if kernel is None:
        return docs.withColumn(label, F.lit(NONE)).withColumn(score, F.lit(0.0))
    given = docs.sparkSession.sparkContext.broadcast(kernel)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole, at, CHUNK)):
            names, scores = given.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], schema.names)

    return in_arrow(docs, run, schema)


def held_out(doc_id: str = "doc_id"):
    return crc_mod(doc_id, 5) == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kernel = train(docs.where(~held_out()))
    out = classify(docs.select("doc_id", "text"), kernel)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
