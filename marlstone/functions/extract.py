"""Rule-based extraction of entities, dates, statutes, events and relation hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import YEAR

# Label -> patterns; each pattern of a label is scanned on its own.
PATTERNS = {
    "FLIGHT": (r"\b[A-Z]{2,3}\s?\d{3,4}\b",),
    "MONEY": (r"\$[\d,]+(?:\.\d{2})?",),
    "CASE_NUMBER": (r"\b\d{2}-[A-Z]{2,3}-\d{4,}\b",),
    "LAW": (
        r"(?i)\bTitle\s+\d+\b",
        r"(?i)\bSection\s+\d+[a-z]?\b",
        r"§\s*\d+",
        r"(?i)\b\d+\s+U\.?S\.?C\.?\s*§?\s*\d+",
        r"(?i)\b(?:Non-Prosecution|Plea)\s+Agreement\b",
    ),
    "EVENT": (
        r"(?i)\b(?:deposition|hearing|trial|arraignment|sentencing|arrest|indictment|plea\s+(?:deal|agreement))\b",
        r"(?i)\b(?:grand\s+jury|search\s+warrant|subpoena)\b",
        r"(?i)\b(?:meeting|telephone\s+call|flight|visit|trip)\b",
    ),
    "PHONE": (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",),
    "DATE": (r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b",),
}
#: PHONE and DATE are offered, not asked for by default.
DEFAULT_LABELS = ("FLIGHT", "MONEY", "CASE_NUMBER", "LAW", "EVENT")

_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)"
# Relation -> pattern with two names; the longer verb is tried first and names keep their case.
RELATIONS = {
    "met_with": rf"(\b{_NAME}+)\s+(?i:met with|met)\s+(\b{_NAME}+)",
    "employed_by": rf"(\b{_NAME}+)\s+(?i:employed|hired|worked for)\s+(\b{_NAME}+)",
    "traveled_to": rf"(\b{_NAME}+)\s+(?i:traveled|flew|visited)\s+(?i:to\s+)?(\b{_NAME}*)",
}


def mentions(text: Column, label: str) -> Column:
    """All matches of a label's patterns, normalised; pattern by pattern."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in PATTERNS[label])))
    if label == "FLIGHT":
        return F.transform(found, lambda m: F.replace(m, F.lit(" "), F.lit("")))
    return F.transform(found, F.lower) if label == "EVENT" else found


def extract(chunks: DataFrame, key: str = "id", text: str = "text", labels: tuple[str, ...] = DEFAULT_LABELS) -> DataFrame:
    """(key, label, name): one row per match."""
    each = F.flatten(F.array(*(F.transform(mentions(F.col(text), x), lambda m: F.struct(F.lit(x).alias("label"), m.alias("name"))) for x in labels)))
    return chunks.select(key, F.explode(each).alias("m")).select(key, "m.label", "m.name")


def places(text: Column, pattern: str) -> Column:
    """array<struct<name, start, end>> of a pattern's matches, in code points: the lengths of the matches and of what
    lies between them give the places."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    each = F.arrays_zip(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("name"))
    none = F.array().cast("array<struct<name:string,start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["name"])
        one = F.struct(x["name"].alias("name"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    walked = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def with_offsets(chunks: DataFrame, key: str = "id", text: str = "text", labels: tuple[str, ...] = DEFAULT_LABELS) -> DataFrame:
    """(key, label, name, start, end) in code points, in one scan."""
    tagged = lambda x, p: F.transform(places(F.col(text), p), lambda m: F.struct(F.lit(x).alias("label"), m["name"].alias("name"), m["start"].alias("start"), m["end"].alias("end")))
    spans = F.concat(*(tagged(x, p) for x in labels for p in PATTERNS[x]))
    return chunks.select(key, F.explode(spans).alias("m")).select(key, "m.label", "m.name", "m.start", "m.end")


def structured(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One record per chunk: entities by label, years, statutes, events, relation hints and a count."""
    t = F.col(text)
    kinds = [x for x in DEFAULT_LABELS if x not in ("LAW", "EVENT")]
    out = chunks.select(
        "*",
        F.map_filter(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*(F.array_sort(F.array_distinct(mentions(t, x))) for x in kinds))), lambda _, v: F.size(v) > 0).alias("entities"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(YEAR), F.lit(1)))).alias("dates_in_chunk"),
        F.array_sort(F.array_distinct(mentions(t, "LAW"))).alias("legal_acts"),
        F.array_sort(F.array_distinct(mentions(t, "EVENT"))).alias("events"),
        relation_hints(t).alias("relationship_hints"),
    )
    return out.withColumn("entity_count", F.aggregate(F.map_values("entities"), F.lit(0), lambda acc, v: acc + F.size(v)))


def relation_hints(text: Column, around: int = 20) -> Column:
    """array<struct<entity1, entity2, type, evidence>>; evidence reaches ``around`` characters beyond the match."""
    t = F.coalesce(text, F.lit(""))
    parts = []
    for kind, p in RELATIONS.items():
        a, b = (F.regexp_extract_all(t, F.lit(p), F.lit(i)) for i in (1, 2))

        def hint(x: Column) -> Column:
            low = F.greatest(x["m"]["start"] - around, F.lit(0))
            evidence = F.substring(t, low + 1, x["m"]["end"] + around - low)
            return F.struct(x["a"].alias("entity1"), x["b"].alias("entity2"), evidence.alias("evidence"))

        hints = F.transform(F.arrays_zip(places(t, p).alias("m"), a.alias("a"), b.alias("b")), hint)
        parts.append(F.transform(hints, _typed(kind)))
    return F.flatten(F.array(*parts))


def _typed(kind: str):
    return lambda h: F.struct(h["entity1"].alias("entity1"), h["entity2"].alias("entity2"), F.lit(kind).alias("type"), h["evidence"].alias("evidence"))


def aggregate_names(mentions_: DataFrame, most: int = 1000) -> DataFrame:
    """(name, label, count, sources, chunk_ids) of (name, label, source, chunk_id, ord); the label seen first wins.

    The lists have the ``most`` least of a name's sources and chunks, so that a frequent name is no unbounded row.
    """
    out = mentions_.groupBy("name").agg(F.min_by("label", "ord").alias("label"), F.count(F.lit(1)).alias("count"))
    for column, to in (("source", "sources"), ("chunk_id", "chunk_ids")):
        out = out.join(least_of(mentions_, ["name"], column, to, most), "name", "left").withColumn(to, F.coalesce(to, F.array().cast(mentions_.select(F.array(column)).schema[0].dataType)))
    return out


def least_of(rows: DataFrame, keys: list[str], column: str, to: str, most: int | None) -> DataFrame:
    """keys and ``to``: the sorted distinct values of column for each key, all of them or the ``most`` least. Values are
    ranked and cut before they are gathered."""
    distinct = rows.select(*keys, column).where(F.col(column).isNotNull()).distinct()
    if most is not None:
        w = W.partitionBy(*keys).orderBy(column)
        distinct = distinct.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= most)
    return distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias(to))
