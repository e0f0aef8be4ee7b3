"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of word shingles. Texts with equal sets form a
   class, named by a 128-bit hash of the set; only classes are compared.
2. A class keeps 128 minima only as 4 bits each (8 longs), and a 64-bit key for
   each band of 4 minima.
3. Classes that share a band key are candidates. In each bucket every class is
   paired with one centre only, the class whose buckets are the largest. A
   pair's similarity is estimated from the bits that agree, corrected for the 1
   in 16 that agree by chance.
4. Pairs with an estimate of at least NEAR are compared on their full shingle
   sets; the links found give first components. A class that is near its centre
   is then known by its difference from it.
5. Links that the centres miss join classes of one bucket in different
   components. Between classes near one centre they are found from the
   differences: if x is not linked to the centre, a link of x and y means that
   they share an element that the centre lacks, or many of those that they lack
   themselves, so only pairs that meet in this way are compared.
   With a class that is not near, the estimate decides, as part of the join,
   whether a pair is compared on full sets (five standard errors of room).
   This loses no link, and no group's pairs are all made.

A pair with similarity 0.85 shares no band of 20 with probability 4e-7 (0.8 and
28 bands: the same). Counts of candidates or partners have no cap.

A null text, or one without words, has an empty set and is linked with nothing:
its component is itself. A text with fewer words than a shingle is one shingle.
Rows may repeat or share a doc_id; a null doc_id names a component only if no
member has one. An empty table gives no rows; other columns are ignored by
``near_dups`` and kept by ``dedup``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, in_arrow, parts_of, read, split_by, stored, without
from .components import components

HASHES = 128
BITS = 4
ROWS = 4
SIGMAS = 5
#: Estimated similarity to a bucket's centre from which a class is compared with it.
NEAR = 0.4
CHUNK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
U = np.uint64
BASE = U(0x9E37_79B9_7F4A_7C15)
BASE_INVERSE = U(pow(0x9E37_79B9_7F4A_7C15, -1, 1 << 64))


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, n, np.uint64)


BYTE = _random(256, 1)
STEP = _random(64, 2) | U(1)
FACTOR = (_random(HASHES, 3) >> U(32)).astype(np.uint32) | np.uint32(1)
SHIFT = (_random(HASHES, 4) >> U(32)).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58_476D_1CE4_E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D0_49BB_1331_11EB)
    return x ^ (x >> U(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, np.uint64)
    up, down = ones * BASE, ones * BASE_INVERSE
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes."""
    raw = [(t or "").encode().translate(LOWER) for t in texts]
    flat = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    size = 1 << max(19, int(len(flat)).bit_length())
    up, down = _powers(size)
    blank = SPACE[flat]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[flat] * up[: len(flat)])])
    word = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    bounds = np.searchsorted(starts, begins)  # each text's first word
    n = max(len(word) - k + 1, 0)
    joined = np.full(n, U(k))
    for i in range(k):
        joined += word[i : i + n] * STEP[i]
    joined = _mixed(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            out.append(_mixed(np.array([(word[a:b] * STEP[: b - a]).sum() + U(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES 32-bit minima for each set, none of them empty."""
    flat = np.concatenate(sets)
    x = (flat >> U(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((HASHES, len(sets)), np.uint32)
    t = np.empty_like(x)
    for j in range(HASHES):
        np.multiply(x, FACTOR[j], out=t)
        t += SHIFT[j]
        np.minimum.reduceat(t, starts, out=out[j])
    return np.ascontiguousarray(out.T)


def packed(mins: np.ndarray) -> np.ndarray:
    """Rows of 8 longs: 4 bits of each minimum."""
    low = ((mins * np.uint32(0x9E37_79B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(len(mins), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * U(BITS)), axis=2)


def band_keys(mins: np.ndarray, bands: int) -> np.ndarray:
    m = mins[:, : bands * ROWS].reshape(len(mins), bands, ROWS).astype(np.uint64)
    return _mixed((m * STEP[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * STEP[ROWS])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel().view(np.int64)))


def _node(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, node (null for an empty set), n, sig, keys."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("node binary, n long, sig array<long>, keys array<long>").fields])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 2, CHUNK):
                sets = shingle_sets(part.column(2).to_pylist(), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig, keys = np.zeros((len(sets), HASHES * BITS // 64), np.uint64), np.zeros((len(sets), bands), np.uint64)
                if full:
                    m = minima([sets[i] for i in full])
                    sig[full], keys[full] = packed(m), band_keys(m, bands)
                node = pa.array([_node(s) if len(s) else None for s in sets], pa.binary())
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), node, n, _lists(sig), _lists(keys)], schema.names)

    return in_arrow(rows, sign, schema)


def _estimate(a: str, b: str) -> Column:
    """Similarity from the bits that agree, corrected for chance."""
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111_1111_1111_1111))
        differ = differ + F.bit_count(x)
    agree = 1 - differ / HASHES
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def _plausible(threshold: int, a: str, b: str, na: str, nb: str) -> Column:
    t = threshold / 100
    chance = 1 / (1 << BITS)
    p = t * (1 - chance) + chance
    error = (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)
    sizes = 100 * F.least(na, nb) >= threshold * F.greatest(na, nb)
    return sizes & (_estimate(a, b) >= t - SIGMAS * error)


def _sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the classes in pairs (a, b), from one text of each."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = stored(classes.join(nodes, "node").select("node", "rep.doc_id", "rep.text_hash"))
    text, _ = split_by(docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text"), "h", needed, "text_hash")
    found = text.join(needed, (F.col("h") == F.col("text_hash")) & F.col("d").eqNullSafe(F.col("doc_id"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, CHUNK):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), k)], pa.binary())], ["node", "shingles"])

    # Rows that agree in doc_id and text give a class's set more than once; what is made of it is made distinct later.
    return stored(in_arrow(found, sets, "node binary, shingles binary"))


def _bits(elements: np.ndarray) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[(elements & U(255)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.int64)


def _compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """pairs (a, b) with nb (the size of b's set), na, linked, gained and lost (b's elements that a lacks and the
    reverse) and bits (a bit map of lost by 8 bits of hash)."""
    shingles = _sets(pairs, classes, docs, k)
    both = pairs.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole, 3, CHUNK)):
            rows = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (2, 3))
                gained, lost = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                common = len(x) - len(lost)
                linked = 100 * common >= threshold * (len(x) + len(y) - common)
                rows.append((len(x), len(y), linked, gained.view(np.int64), lost.view(np.int64), _bits(lost)))
            na, nb, linked, gained, lost, bits = zip(*rows) if rows else ((), (), (), (), (), ())
            more = [pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(linked, pa.bool_()), pa.array(gained, pa.list_(pa.int64())), pa.array(lost, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *more], ["a", "b", "na", "nb", "linked", "gained", "lost", "bits"])

    return in_arrow(both.select("a", "b", "sa", "sb"), compare, "a binary, b binary, na long, nb long, linked boolean, gained array<long>, lost array<long>, bits array<long>")


def near_dups(docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = 28) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component_id, first (one row of each component).

    threshold: least similarity in hundredths.
    """
    rows = stored(signatures(docs, k, bands))
    rep = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    classes = stored(rows.where("node is not null").groupBy("node").agg(F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    member = classes.select("node", F.explode("keys").alias("key"))
    sizes = member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(member.join(sizes, "key"))
    # A class that was not changed meets more others than those made from it do, so it becomes their centre.
    weight = stored(shared.groupBy("node").agg(F.sum("size").alias("weight")))
    centres = stored(shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre")))
    signed = classes.select("node", "n", "sig")
    side = lambda x: signed.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}"))
    stars = stored(shared.join(centres, "key").where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    near = stored(stars.join(side("b"), "b").join(side("a"), "a").where(_estimate("sa", "sb") >= NEAR).select("a", "b"))
    compared = stored(_compared(near, classes, docs, k, threshold).dropDuplicates(["a", "b"]))
    labels = components(compared.where("linked").select("a", "b"))
    missed = _by_difference(compared, labels, threshold).unionByName(_with_far(shared.join(centres, "key"), near, signed, labels, classes, docs, k, threshold))
    labels = _merged(labels, stored(missed))

    full, empty = rows.where("node is not null").select("doc_id", "text_hash", "node", "n"), rows.where("node is null")
    placed = stored(full.join(labels, "node", "left").select("doc_id", "text_hash", "n", F.coalesce("label", "node").alias("label")))
    least = stored(placed.groupBy("label").agg(F.min(rep).alias("least")))
    done = placed.join(least, "label").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), (rep == F.col("least")).alias("first"))
    alone = empty.select("doc_id", "text_hash", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return done.unionByName(alone)


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the label of a class, itself if it has none."""
    return rows.join(labels.select(F.col("node").alias(node), F.col("label").alias("l__")), node, "left").withColumn(name, F.coalesce("l__", node)).drop("l__")


def _by_difference(compared: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between classes near one centre that are in different components.

    Sets x, y are linked if they differ in at most H = r (|x| + |y|) elements,
    r = (100 - threshold) / (100 + threshold). Against the centre c, x has
    gained gx elements and lost lx; x and y differ where these differ, so they
    share at least o = (gx + lx + gy + ly - H) / 2 of them if linked. x is one
    that c does not link: gx + lx > r (|x| + |c|). Two cases:
    - They share a gained element, so pairs meet on those that two classes or
      more have gained.
    - They share lost elements only. Then gx + gy + |lx - ly| <= H, and
      o >= lx + gx - H and o > (gy + ly + r (|c| - |y|)) / 2 =: v, so the first
      H - gx + 1 of x's and the first ly - floor(v) of y's lost elements, in one
      order, have one in common. Where words were replaced there is no such pair.
    In both, o is at most what they can share: the gained elements of x or of y
    that others have, and lost ones whose bits agree (or collide in x's map).
    """
    t, r = threshold / 100, (100 - threshold) / (100 + threshold)
    # Only centres with a class that they do not link need this.
    open_ = stored(compared.where("not linked").groupBy("a").agg(F.count(F.lit(1)).alias("open")).select("a"))
    sorted_ = compared.join(open_, "a").withColumn("gained", F.array_sort("gained")).withColumn("lost", F.array_sort("lost"))
    rows = stored(_labelled(sorted_, labels, "b", "label").withColumns({"g": F.size("gained"), "l": F.size("lost")}))
    most = F.floor(r * F.col("nb") * (1 + 1 / t) + 1e-9)
    v = F.floor((F.col("g") + F.col("l") + r * (F.col("na") - F.col("nb"))) / 2 - 1e-9)
    first_x = F.greatest(F.least(F.col("l"), most - F.col("g") + 1), F.lit(0)).cast("int")
    first_y = F.greatest(F.least(F.col("l"), F.col("l") - v), F.lit(0)).cast("int")

    each = rows.select("a", "b", F.explode("gained").alias("e"))
    common_e = stored(each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("a", "e"))
    held = stored(each.join(common_e, ["a", "e"]))
    shared_g = held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"))
    rows = stored(rows.join(shared_g, ["a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0))))
    looked_at = ("label", "nb", "g", "l", "s", "bits")

    def side(df: DataFrame, name: str) -> DataFrame:
        """(a, e, ...): a row's elements with what the join looks at."""
        return df.select("a", "e", F.col("b").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in looked_at))

    room = r * (F.col("nb_x") + F.col("nb_y")) + 1e-9
    need = (F.col("g_x") + F.col("l_x") + F.col("g_y") + F.col("l_y") - room) / 2
    count = lambda f: sum((F.bit_count(f(i)) for i in range(4)), F.lit(0))
    agree = count(lambda i: F.get("bits_x", F.lit(i)).bitwiseAND(F.get("bits_y", F.lit(i)))) + F.col("l_x") - count(lambda i: F.get("bits_x", F.lit(i)))
    other = F.col("label_x") != F.col("label_y")
    lost_apart = F.abs(F.col("l_x") - F.col("l_y"))

    def meet(x: DataFrame, y: DataFrame, condition: Column) -> DataFrame:
        y = side(y, "y").withColumnsRenamed({"a": "a2", "e": "e2"})
        return side(x, "x").join(y, (F.col("a") == F.col("a2")) & (F.col("e") == F.col("e2")) & other & condition).select("a", "x", "y")

    gained = held.join(rows, ["a", "b"])
    by_gained = meet(gained.where("not linked"), gained, (F.abs(F.col("g_x") - F.col("g_y")) + lost_apart <= room) & (F.least("s_x", "s_y") + agree >= need))
    lost = lambda df, n: df.withColumn("e", F.explode(F.slice("lost", F.lit(1), n)))
    by_lost = meet(lost(rows.where("not linked"), first_x), lost(rows, first_y), (F.col("g_x") + F.col("g_y") + lost_apart <= room) & (agree >= need))
    met = stored(by_gained.unionByName(by_lost).distinct())
    given = lambda v: rows.select("a", F.col("b").alias(v), F.col("nb").alias(f"n{v}"), F.concat("gained", "lost").alias(f"d{v}"))
    both = met.join(given("y"), ["a", "y"]).join(given("x"), ["a", "x"])
    apart = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    total = F.col("nx") + F.col("ny")
    common = (total - apart) / 2
    return both.where(100 * common >= threshold * (total - common)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_far(shared: DataFrame, near: DataFrame, signed: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) across components within buckets of which at least one class is not near the bucket's centre."""
    placed = shared.join(near.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.lit(True).alias("is_near")), ["centre", "node"], "left")
    rows = placed.select("key", "node", "centre", ((F.col("node") != F.col("centre")) & F.col("is_near").isNull()).alias("far"))
    open_ = stored(rows.groupBy("key").agg(F.bool_or("far").alias("open")).where("open").select("key"))
    within = stored(_labelled(stored(rows.join(open_, "key")), labels, "node", "label").join(signed, "node"))
    a = within.where("far").select("key", *(F.col(c).alias(f"{c}a") for c in ("node", "label", "n", "sig")))
    b = within.select("key", "far", *(F.col(c).alias(f"{c}b") for c in ("node", "label", "n", "sig")))
    once = ~F.col("far") | (F.col("nodea") < F.col("nodeb"))
    pairs = a.join(b.withColumnRenamed("key", "keyb"), (F.col("key") == F.col("keyb")) & (F.col("labela") != F.col("labelb")) & once & _plausible(threshold, "siga", "sigb", "na", "nb"))
    new = stored(pairs.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct())
    if new.isEmpty():
        return new
    return _compared(new, classes, docs, k, threshold).where("linked").select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links (a, b) between classes, labelled or not."""
    if links.isEmpty():
        return labels
    ends = stored(_labelled(stored(_labelled(links, labels, "a", "la")), labels, "b", "lb"))
    moved = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    # A class that had no link so far is its own label.
    new = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct().join(labels.select("node"), "node", "left_anti")
    all_ = stored(labels.unionByName(new.select("node", F.col("node").alias("label"))))
    return stored(all_.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def dedup(docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = 28) -> DataFrame:
    """docs with one row of each component, the one with the least doc_id, and rows with an empty set; columns as given.

    Rows that agree in doc_id and text stand together, but for an empty set, and one of them stays. Only rows that
    may go, by their hash, meet the list of those that do.
    """
    found = near_dups(docs, k, threshold, bands).where("n_shingles > 0")
    keys = found.groupBy("doc_id", "text_hash").agg(F.bool_or("first").alias("stays"), F.count(F.lit(1)).alias("times"))
    return without(docs, keys.where("not stays or times > 1"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dups(read(spark, sf_dir, "documents"), k=3, threshold=85, bands=20)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
