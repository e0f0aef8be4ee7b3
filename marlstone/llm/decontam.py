"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

1. The corpus-wide frequency of each word that occurs in a test item is counted.
2. Each window of a test item (WINDOW consecutive words, or the whole item if it
   is shorter) asks for its two rarest words; the index stores their postings
   (term, doc_id, text_hash, pos) over all documents.
3. A posting less the word's place in the item is the place where the item would
   start: its diagonal. Lists adjusted in this way are intersected: a diagonal
   with two of the item's rare words stays.
4. On the diagonals that stay, the document's words along the item are compared
   with it, which leaves exactly the windows that occur: the exact matches.
5. Postings of a window's rarest words that stand close together, in any order,
   are proximity matches.

Test items are small beside the corpus but not bounded: whether a join with them
is broadcast is left to Spark's size threshold, and it shuffles beyond.

Words: A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null or
empty texts have no words: such documents have no hits, such items no windows.
Items with one id count once; items with a null id hit words but are not listed.
Documents that agree in doc_id and text get equal results; an empty table of
documents gives no rows, an empty benchmark no hits. Other columns are ignored
by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, split_by, stored, without

WINDOW = 10
RARE = 2
#: Words that a window's rarest words may be apart in a proximity match.
SLOP = 15
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR, -1), "")


def test_items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, item_words, width): width is the length of its windows."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    return stored(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "item_words", F.least(F.size("item_words"), F.lit(window)).alias("width")))


def _positions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, term) of every word."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(words(F.col("text"))).alias("pos", "term"))


def rare_terms(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item, start, rank, at, term): each window's RARE rarest words by corpus frequency, rarest first."""
    terms = items.select(F.explode("item_words").alias("term")).distinct()
    seen = docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = items.select("item", "width", F.posexplode("item_words").alias("at", "term")).join(stored(seen), "term", "left")
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term")))
    whole = placed.groupBy("item", "width").agg(ordered.alias("ws"))
    starts = whole.select("item", "width", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("width"))).alias("start"))
    window = F.transform(F.slice("ws", F.col("start") + 1, F.col("width")), lambda w: F.struct(w["n"].alias("n"), w["at"].alias("at"), w["term"].alias("term")))
    rarest = F.slice(F.array_sort(window), 1, RARE)
    return stored(starts.select("item", "start", F.posexplode(rarest).alias("rank", "w")).select("item", "start", "rank", "w.at", "w.term"))


def build_index(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """Postings (term, doc_id, text_hash, pos) of the terms asked for, stored."""
    return stored(_positions(docs).join(rare.select("term").distinct(), "term").select("term", "doc_id", "text_hash", "pos"))


def diagonals(index: DataFrame, rare: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, diagonal) where as many rare words line up as a window has."""
    asked = rare.select("term", "item", "at").distinct().join(items.select("item", "width"), "item")
    lined = index.join(asked, "term").select("doc_id", "text_hash", "item", "width", (F.col("pos") - F.col("at")).alias("diagonal"))
    # A place of the item meets a diagonal once, so counting rows counts places.
    met = lined.groupBy("doc_id", "text_hash", "item", "diagonal", "width").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.least("width", F.lit(RARE)))
    return met.select("doc_id", "text_hash", "item", "diagonal")


def near_matches(index: DataFrame, rare: DataFrame, items: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_id, text_hash, item): proximity matches. A window's rarest words stand at most slop words apart, in any
    order and whatever is between them; a window of one word is met by that word.

    Postings of a document meet within cells of slop words, so a pair is made only of words that are near.
    """
    wide = rare.join(items.where(F.col("width") >= RARE).select("item"), "item")
    first, second = (wide.where(F.col("rank") == r).select("item", "start", F.col("term").alias(f"t{r}")) for r in (0, 1))
    pairs = first.join(second, ["item", "start"]).select("item", F.least("t0", "t1").alias("low"), F.greatest("t0", "t1").alias("high")).distinct()
    cell = F.floor(F.col("pos") / slop)
    left = index.join(wide.select("term").distinct(), "term").select("doc_id", "text_hash", cell.alias("cell"), F.col("pos").alias("p"), F.col("term").alias("t"))
    right = left.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("c"), F.col("p").alias("q"), F.col("t").alias("u"))
    same = (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("cell") == F.col("c"))
    close = left.join(right, same & (F.col("q") > F.col("p")) & (F.col("q") - F.col("p") <= slop)).select("doc_id", "text_hash", F.least("t", "u").alias("low"), F.greatest("t", "u").alias("high")).distinct()
    lone = rare.join(items.where(F.col("width") < RARE).select("item"), "item").select("term", "item").distinct()
    return close.join(pairs, ["low", "high"]).select("doc_id", "text_hash", "item").unionByName(index.join(lone, "term").select("doc_id", "text_hash", "item")).distinct()


def matches(docs: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, starts, width): exact matches, the places in the document where windows of the item
    occur. Only texts with a diagonal move; of each diagonal the stretch of words that lies along the item does."""
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    sized = lines.join(items.select("item", F.size("item_words").alias("n")), "item")
    per_doc = stored(sized.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "diagonal", "n")).alias("lines")))
    some, _ = split_by(keyed, "h", per_doc, "text_hash")
    # Rows that agree in doc_id and text give the same matches; one of them is looked at.
    met = some.join(per_doc, (F.col("h") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("d"))).dropDuplicates(["doc_id", "text_hash"])

    def stretch(w: Column) -> Column:
        low = lambda x: F.greatest(F.lit(0), -x["diagonal"])
        cut = lambda x: F.slice(w, x["diagonal"] + low(x) + 1, x["n"] - low(x))
        return F.transform("lines", lambda x: F.struct(x["item"].alias("item"), x["diagonal"].alias("diagonal"), low(x).alias("low"), cut(x).alias("seen")))

    once = F.get(F.transform(F.array(words(F.col("text"))), stretch), F.lit(0))
    each = met.select("doc_id", "text_hash", F.explode(once).alias("x")).select("doc_id", "text_hash", "x.*").join(items.select("item", "item_words", "width"), "item")
    last = F.size("seen") - F.col("width")
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    same = lambda s: F.slice("seen", s + 1, F.col("width")) == F.slice("item_words", F.col("low") + s + 1, F.col("width"))
    starts = F.transform(F.filter(at, same), lambda s: s + F.col("low") + F.col("diagonal"))
    return each.select("doc_id", "text_hash", "item", starts.alias("starts"), "width").where(F.size("starts") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per row of docs: doc_id, n_words, hits (positions of hit words), items (ids of items with exact matches,
    sorted as strings), near (ids of items with proximity matches, which those with exact ones are among)."""
    items = test_items(benchmark, window)
    rare = rare_terms(docs, items)
    index = build_index(docs, rare)
    lines = stored(diagonals(index, rare, items))
    ids = items.select("item", F.col("item_id").cast("string").alias("id"))
    listed = lambda c: F.array_sort(F.collect_set(c))
    exact = stored(matches(docs, lines, items)).join(ids, "item")
    hit = F.transform("starts", lambda s: F.sequence(s, s + F.col("width") - 1))
    found = exact.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.flatten(F.collect_list(hit)))).alias("hits"), listed("id").alias("items"))
    near = near_matches(index, rare, items, slop).join(ids, "item").groupBy("doc_id", "text_hash").agg(listed("id").alias("near"))
    both = stored(near.join(found, (near.text_hash == found.text_hash) & near.doc_id.eqNullSafe(found.doc_id), "full").select(F.coalesce(near.doc_id, found.doc_id).alias("d"), F.coalesce(near.text_hash, found.text_hash).alias("h"), "hits", "items", "near"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(both, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return joined.select("doc_id", "n_words", none("hits", "int"), none("items", "string"), none("near", "string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, as they are."""
    items = test_items(benchmark, window)
    rare = rare_terms(docs, items)
    lines = stored(diagonals(build_index(docs, rare), rare, items))
    return without(docs, matches(docs, lines, items).select("doc_id", "text_hash").distinct().withColumn("stays", F.lit(False)))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )
