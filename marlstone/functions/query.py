"""Parsing of question texts: dates, statutes, intent, keywords, filters. Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import YEAR, stripped

# Trigger words of each intent, tried in this order, and the words that are never keywords.
INTENT_WORDS = {
    "entity_lookup": ("who is", "tell me about", "what do we know about", "profile", "details on"),
    "relationship": ("connection", "relationship", "linked", "connected", "between", "path"),
    "timeline": ("timeline", "chronolog", "when did", "history of", "over time"),
}
STOPWORDS = (
    "the", "a", "an", "is", "was", "were", "are", "in", "on", "at", "to", "for", "of", "with", "and", "or", "but",
    "who", "what", "when", "where", "how", "did", "do", "about", "between", "from",
)
LEGAL = r"(?i)\b(?:Title\s+\d+|Section\s+\d+[a-z]?|§\s*\d+|U\.?S\.?C\.?\s*§?\s*\d+)\b"
YEAR_HINT = r"(?i)\b(?:from|in|during|year)\s*(\d{4})\b"
YEAR_RANGE = r"\b(\d{4})\s*(?:to|-)\s*(\d{4})\b"


def dates(query: Column) -> Column:
    """Sorted distinct years; a range's ends are years of their own."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(YEAR), F.lit(1))))


def statutes(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(LEGAL), F.lit(0))


def intent(query: Column, n_entities: Column) -> Column:
    low = F.lower(query)
    out = None
    for name, triggers in INTENT_WORDS.items():
        hit = F.lit(False)
        for t in triggers:
            hit = hit | F.contains(low, F.lit(t))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    n_words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return out.when((n_entities == 1) & (n_words <= 4), "entity_lookup").when(n_entities >= 2, "relationship").otherwise("search")


def keywords(query: Column, entity_names: Column) -> Column:
    """Words that are no part of an entity, no date, no stop word and longer than one character; repeats stay."""
    words = F.filter(F.split(F.regexp_replace(F.lower(query), r"(?U)[^\w\s]", " "), r"\s+"), lambda w: F.length(w) > 1)
    held = F.flatten(F.transform(entity_names, lambda e: F.split(F.lower(e), r"\s+")))
    stop = F.array(*map(F.lit, STOPWORDS))
    found = dates(query)
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & ~F.array_contains(held, w) & ~F.array_contains(found, w))


def filters(query: Column) -> Column:
    """struct<date_from, date_to, doc_type> from hints in the text; a range overrides a single year."""
    hint = F.nullif(F.regexp_extract(query, YEAR_HINT, 1), F.lit(""))
    low, high = (F.nullif(F.regexp_extract(query, YEAR_RANGE, i), F.lit("")) for i in (1, 2))
    kind = F.when(query.rlike(r"(?i)\btext\s+doc"), "TEXT").when(query.rlike(r"(?i)\b(?:image|ocr|photo|scan)"), "IMAGE")
    return F.struct(F.coalesce(low, hint).alias("date_from"), F.coalesce(high, hint).alias("date_to"), kind.alias("doc_type"))


def structured_filters(found_dates: Column, entity_names: Column, acts: Column) -> Column:
    """struct<date_from, date_to, entities, legal_acts>; absent parts are null."""
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.struct(F.array_min(found_dates).alias("date_from"), F.array_max(found_dates).alias("date_to"), some(entity_names).alias("entities"), some(acts).alias("legal_acts"))


def is_complex(query: Column) -> Column:
    n_words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    low = F.lower(query)
    marks = F.length(query) - F.length(F.replace(query, F.lit("?"), F.lit("")))
    return (n_words > 12) | F.contains(low, F.lit(" and ")) | F.contains(low, F.lit(" or ")) | (marks > 1)


def distinct_variants(variants: Column) -> Column:
    """Query variants without those that another equals but for case and outer space, in order."""
    low = F.transform(variants, lambda v: F.lower(stripped(v)))
    return F.filter(variants, lambda v, i: F.array_position(low, F.lower(stripped(v))) == i + 1)
