"""Sampled SentencePiece segmentation, and decoding that gives the text back.

A text becomes one leading word mark and the text with spaces as word marks.
Its lattice has an edge for every vocabulary piece that occurs in it, and byte
pieces for characters outside the vocabulary and for a literal word mark
(U+2581), so decoding can tell it from a space. An edge weighs
(1 + rank)**-ALPHA, rank being the piece's merge rank in the model, so earlier
merges are likelier, as in a Zipf law; a byte piece ranks last. Segmentations
are drawn with probability proportional to the product of their weights:
forward filtering sums the weights of all ways to reach each place, backward
sampling picks pieces from the end in proportion to these sums.

No piece has a word mark after another character, nor (but for pairs found in
the model) a letter next to what is none, so the lattice splits there and the
filtering is done once for each distinct word and kept. Draws come
from a counter-based generator over (seed, row key, place of the word, step), so
a row's segmentation does not depend on partitions, batches or retries.

A null text has null ids, an empty text has an empty array;
decoding gives null and the empty text. Rows with an equal key and text get
equal segmentations; a null key is a key of its own. Texts are encoded whole;
time and memory are linear in their length. An empty table gives no rows; other
columns are kept by ``encode`` (``ids`` is replaced) and ignored by the query.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, read
from .hashtable import find, hashed

ALPHA = 2.0
MARK = "▁"
#: Bytes of text that are worked on at once.
CHUNK = 1 << 18
#: Edges of the words' lattices, some 20 a word, beyond which a worker drops what it keeps; words longer than LONG are
#: never looked up again, but their edges count.
KEEP = 800_000
LONG = 64
#: Words up to this length are filtered many at a time; their weights' products stay in a double's range.
SHORT = 24
#: Edges, with those that no piece has, that are filtered at once.
CELLS = 1 << 18
BASE = 0x9E37_79B9_7F4A_7C15
U = np.uint64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58_476D_1CE4_E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D0_49BB_1331_11EB)
    return x ^ (x >> U(31))


def _powers(base: int) -> np.ndarray:
    return np.array([pow(base, i, 1 << 64) for i in range(LONG)], np.uint64)


UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def _key(string: str) -> int:
    """A polynomial hash, that of any part of a string follows from sums over the string."""
    code = np.frombuffer(string.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return int((_mixed(code + U(1)) * UP[: len(code)]).sum(dtype=np.uint64) + U(len(code)))


class Lattice:
    """A model's pieces, and the filtered lattices of words seen so far."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces, so not every text could be encoded")
        usable = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        set_of = set(usable)
        if any(MARK in names[i].lstrip(MARK) for i in usable):
            raise ValueError("pieces with a word mark inside are not supported")
        self.weight = {names[i]: (1.0 + abs(sp.get_score(i))) ** -ALPHA for i in usable}
        self.id = {names[i]: i for i in usable}
        self.longest = max(map(len, self.id))
        self.last = float(1 + max(abs(sp.get_score(i)) for i in usable)) ** -ALPHA
        self.text = [b"" if special[i] else bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        # A letter or digit and what is neither are cut apart, except for pairs that stand in some piece.
        glue = {p[i : i + 2] for p in self.id for i in range(len(p) - 1) if p[i].isalnum() and not p[i + 1].isalnum()}
        held = "".join(f"|(?<={re.escape(g[0])}){re.escape(g[1])}[^\\w {MARK}\n]*" for g in sorted(glue))
        self.word = re.compile(f" *[^\\W_]+(?:{held[1:]})?| *(?:[^\\w {MARK}\n]|_)+| +|\n|{MARK}" if glue else f" *[^\\W_]+| *(?:[^\\w {MARK}\n]|_)+| +|\n|{MARK}")
        if any(not self.word.fullmatch(name.replace(MARK, " ")) for name in self.id):
            raise ValueError("the model has pieces that cross these cuts")
        # Pairs of characters that some piece has next to each other; long words are cut between others.
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.weights = np.array([self.weight.get(names[i], 0.0) if i in set_of else 0.0 for i in range(n)])
        self.bytes_ = np.array([self.byte[i] for i in range(128)], np.int32)
        keys = np.array([_key(name) for name in self.id], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one key")
        self.table = hashed(keys, np.array(list(self.id.values())))  # ids are exact as 32-bit floats up to 2**24
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        # Of word w: places from start[w] to start[w] + length; of place p: edges from first[p] to first[p + 1].
        self.size, self.start, self.first, self.step, self.piece = array("i"), array("i"), array("i", [0]), array("i"), array("i")
        self.cum = array("d")

    def add(self, word: str) -> int:
        """Forward filtering of a word: for every place, the pieces that end there and their cumulative probability.

        A character outside the vocabulary is one piece of its bytes, noted as
        -1 less its code point if there are several.
        """
        get, longest = self.weight.get, self.longest
        n = len(word)
        reach = [1.0] + [0.0] * n
        self.size.append(n)
        self.start.append(len(self.first) - 1)
        cum, step, piece, first = self.cum, self.step, self.piece, self.first
        first.append(len(cum))  # place 0 has no edges
        for end in range(1, n + 1):
            total, found = 0.0, []
            for begin in range(max(0, end - longest), end):
                w = get(word[begin:end])
                if w is not None:
                    w *= reach[begin]
                    total += w
                    found.append((w, end - begin, self.id[word[begin:end]]))
            if not found:
                c = ord(word[end - 1])
                total = reach[end - 1] * self.last ** len(chr(c).encode())
                found = [(total, 1, self.byte[c] if c < 128 else -1 - c)]
            reach[end] = total
            part = 0.0
            for w, k, i in found:
                part += w
                cum.append(part / total if total else 1.0)
                step.append(k)
                piece.append(i)
            cum[-1] = 1.0
            first.append(len(cum))
            if total < 1e-200:  # scale what later places can reach back to
                low = max(0, end - longest)
                top = max(reach[low : end + 1]) or 1.0
                reach[low : end + 1] = [r / top for r in reach[low : end + 1]]
        return len(self.size) - 1


    def add_all(self, words: list[str]) -> None:
        """add() for words of one length at a time, all of them new and at most SHORT long."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, same in by_length.items():
            most = max(1, CELLS // (n * min(n, self.longest)))
            for i in range(0, len(same), most):
                self._add_same(same[i : i + most], n)

    def _add_same(self, words: list[str], n: int) -> None:
        for i, w in enumerate(words, len(self.size)):
            self.words[w.replace(MARK, " ")] = i
        m = len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n)
        sums = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(_mixed(code.astype(np.uint64) + U(1)) * UP[:n], axis=1)], axis=1)
        most = min(n, self.longest)
        ids = np.full((m, n, most), -1, np.int32)  # by place of the end and number of characters, longest first
        for k in range(1, most + 1):
            ids[:, k - 1 :, most - k] = self.lookup((sums[:, k:] - sums[:, : n - k + 1]) * DOWN[: n - k + 1] + U(k))
        weight = np.where(ids >= 0, self.weights[ids], 0.0)
        reach = np.zeros((m, n + 1))
        reach[:, 0] = 1.0
        share = np.zeros((m, n, most))
        for end in range(1, n + 1):
            k = min(end, most)
            share[:, end - 1, most - k :] = weight[:, end - 1, most - k :] * reach[:, end - k : end]
            total = share[:, end - 1].sum(axis=1)
            none = np.flatnonzero(total == 0)
            if len(none):
                c = code[none, end - 1].astype(np.int64)
                size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                share[none, end - 1, most - 1] = total[none] = reach[none, end - 1] * self.last**size
                ids[none, end - 1, most - 1] = np.where(c < 128, self.bytes_[np.minimum(c, 127)], -1 - c)
            reach[:, end] = total
            share[:, end - 1] = np.cumsum(share[:, end - 1], axis=1) / total[:, None]
        keep = (weight > 0) | (ids < -1) | ((ids >= 0) & (np.arange(most) == most - 1))
        counts = np.concatenate([np.zeros((m, 1), np.int64), keep.sum(axis=2)], axis=1)
        self.start.frombytes((len(self.first) - 1 + np.arange(m) * (n + 1)).astype(np.int32).tobytes())
        self.size.frombytes(np.full(m, n, np.int32).tobytes())
        self.first.frombytes((len(self.cum) + np.cumsum(counts)).astype(np.int32).tobytes())
        self.cum.frombytes(share[keep].tobytes())
        self.step.frombytes(np.broadcast_to(np.arange(most, 0, -1, dtype=np.int32), ids.shape)[keep].tobytes())
        self.piece.frombytes(ids[keep].tobytes())

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of the keys of strings, -1 where there is none."""
        return np.nan_to_num(find(self.table, keys.ravel()), nan=-1).astype(np.int32).reshape(keys.shape)


@functools.lru_cache(2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _words(text: str, model: Lattice) -> list[str]:
    """The words of a text, each run of spaces before what it leads; long ones cut further where no piece can cross."""
    words = model.word.findall(" " + text)
    if max(map(len, words)) <= LONG:
        return words
    out = []
    for w in words:
        if len(w) > LONG:
            m = w.replace(" ", MARK)
            at = 0
            for i in range(1, len(m)):
                if m[i - 1 : i + 1] not in model.pairs:
                    out.append(w[at:i])
                    at = i
            w = w[at:]
        out.append(w)
    return out


def sample(texts: list[str], keys: np.ndarray, model: Lattice, seed: int) -> list[np.ndarray]:
    """A segmentation of each text as piece ids; keys: a 64-bit number for each row."""
    words: list[int] = []
    counts = []
    if len(model.cum) > KEEP:
        model.clear()
    cut = [_words(text, model) if text else [] for text in texts]
    get = model.words.get
    if MARK not in model.words:  # a literal mark meets no piece
        model.words[MARK] = model.add("\0")
        model.piece[-1] = -1 - ord(MARK)
    new = {w for ws in cut for w in ws if w not in model.words}
    model.add_all([w.replace(" ", MARK) for w in new if len(w) <= SHORT])
    for ws in cut:
        for w in ws:
            i = get(w)
            if i is None:
                i = model.add(w.replace(" ", MARK))
                if len(w) <= LONG:
                    model.words[w] = i
            words.append(i)
        counts.append(len(ws))
    # Views of arrays that grow: none outlives this call.
    size, start, first, step, piece = (np.frombuffer(a, np.int32) for a in (model.size, model.start, model.first, model.step, model.piece))
    cum = np.frombuffer(model.cum, np.float64)
    if not words:
        return [np.zeros(0, np.int32)] * len(texts)
    word = np.array(words, np.int64)
    n_words = np.array(counts)
    row = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    stream = _mixed(keys[row] + _mixed(place.astype(np.uint64) + U(seed)) * U(0x9E37_79B9_7F4A_7C15))
    base = start[word].astype(np.int64)
    at = base + size[word]
    active = np.arange(len(word))
    owner, order, chosen = [], [], []
    k = 0
    while len(active):
        here = at[active]
        u = (_mixed(stream[active] + U(k * 0xD6E8_FEB8_6659_FD93 % 2**64)) >> U(11)).astype(np.float64) * 2.0**-53
        low, high = first[here], first[here + 1]
        edge = low.copy()
        more = np.flatnonzero((cum[edge] <= u) & (edge + 1 < high))
        while len(more):
            edge[more] += 1
            more = more[(cum[edge[more]] <= u[more]) & (edge[more] + 1 < high[more])]
        owner.append(active)
        order.append(np.full(len(active), k, np.int32))
        chosen.append(piece[edge])
        at[active] = here - step[edge]
        active = active[at[active] > base[active]]
        k += 1
    owner_, order_, ids = np.concatenate(owner), np.concatenate(order), np.concatenate(chosen)
    # Backward draws: a word's last draw is its first piece.
    drawn = np.bincount(owner_, minlength=len(word))
    begin = np.cumsum(drawn) - drawn
    out = np.empty(len(ids), np.int64)
    out[begin[owner_] + drawn[owner_] - 1 - order_] = ids
    per_row = np.bincount(row, drawn, len(texts)).astype(np.int64)
    parts = np.split(out, np.cumsum(per_row)[:-1])
    return [_with_bytes(p, model) for p in parts]


def _with_bytes(ids: np.ndarray, model: Lattice) -> np.ndarray:
    if not len(ids) or ids.min() >= 0:
        return ids.astype(np.int32)
    out: list[int] = []
    for i in ids.tolist():
        out.extend([i] if i >= 0 else [model.byte[b] for b in chr(-1 - i).encode()])
    return np.array(out, np.int32)


def decode_lists(ids: pa.ListArray, model: Lattice) -> pa.Array:
    """The texts of lists of ids, null for null."""
    pieces = pa.array(model.text, pa.binary()).take(ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py()))
    where = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
    data = pieces.buffers()[2].to_pybytes() if len(pieces) and pieces.buffers()[2] is not None else b""
    bounds = where[ids.offsets.to_numpy() - ids.offsets[0].as_py()].tolist()
    null = ids.is_null().to_pylist()
    # The first character is the mark that encoding put in front.
    return pa.array([None if no else data[a + 1 : b].decode() if b > a else "" for a, b, no in zip(bounds[:-1], bounds[1:], null)], pa.string())


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most CHUNK bytes or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > CHUNK:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, seed: int = 42, check: bool = False) -> DataFrame:
    """docs with ``ids``, array<int>: a sampled segmentation of the text. key: seeds the row's draws.

    check: adds ``lossless``, whether decoding the ids gives the text back.
    """
    path = path or model_path()
    docs = docs.drop("ids", *(["lossless"] if check else []))
    # Columns go by position: names may clash.
    rows = docs.select("*", F.xxhash64(key).alias("key__"))
    at_text, at_key = docs.columns.index(text), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("lossless", T.BooleanType())] if check else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            keys = batch.column(at_key).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            column = batch.column(at_text)
            for a, b in _chunks(column):
                texts = column.slice(a, b - a).to_pylist()
                ids = sample([t or "" for t in texts], keys[a:b], model, seed)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.array([t is None for t in texts] + [False])), pa.array(values))
                same = [pa.array([x == y for x, y in zip(texts, decode_lists(lists, model).to_pylist())], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + [lists, *same], schema.names)

    return in_arrow(rows, run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded, which has ``ids``, with ``decoded``: the text of its ids."""
    path = path or model_path()
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_lists(batch.column(at), model)], schema.names)

    return in_arrow(encoded, run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_pieces (null for a null text) and lossless: decoding the ids gave the text back."""
    out = encode(docs.select("doc_id", "text"), check=True)
    return out.select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), "lossless")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
