"""Text functions: Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased words of more than one character; punctuation separates. Repeats are kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w{2,}"), F.lit(0))


def words3(text: Column) -> Column:
    """Distinct lower-cased words of three or more word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w{3,}\b"), F.lit(0)))


#: Fixed value: white space at a text's ends.
BLANK = " \t\n\x0b\x0c\r"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK))


# The formatting noise that cleaning replaces, in order.
NOISE = (
    (r"\x0c", ""),
    (r"[\x00-\x08\x0b\x0e-\x1f]", ""),
    (r"(?U)(\w)\1{4,}", "$1$1$1"),
    (r"_{5,}", ""),
    (r"-{5,}", "---"),
    (r"={5,}", ""),
    (r"\*{5,}", ""),
    (r"\.{5,}", "..."),
)


def without_noise(text: Column) -> Column:
    for pattern, to in NOISE:
        text = F.regexp_replace(text, pattern, to)
    return text


def normal_space(text: Column) -> Column:
    """Tabs become spaces, lines are stripped, runs of spaces become one."""
    text = F.regexp_replace(text, "\t", "    ")
    text = F.regexp_replace(text, r"(?m)^[^\S\n]+|[^\S\n]+$", "")
    return F.regexp_replace(text, " {2,}", " ")


def unwrapped(text: Column) -> Column:
    """Words hyphenated over a line end and lines broken in mid-sentence are joined."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2"), r"([a-z,;])\n([a-z])", "$1 $2")


def cleaned(text: Column) -> Column:
    """Formatting clean-up; texts of under ten characters stay as they are."""
    out = stripped(F.regexp_replace(unwrapped(normal_space(without_noise(text))), r"\n{3,}", "\n\n"))
    return F.when(F.length(stripped(text)) < 10, text).otherwise(out)


def clean_batch(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with cleaned texts, original_length and cleaned_length; rows whose text is empty then go."""
    out = docs.withColumn("original_length", F.length(F.coalesce(text, F.lit("")))).withColumn(text, cleaned(F.coalesce(text, F.lit(""))))
    return out.withColumn("cleaned_length", F.length(text)).where("cleaned_length > 0")


def is_corrupted(text: Column) -> Column:
    """Too short, hardly any letters or digits, or hardly any distinct characters."""
    rest = lambda t: F.replace(t, F.substring(t, 1, 1), F.lit(""))  # noqa: E731  without its first character
    few = lambda t: once(rest(t), lambda u: rest(u) == "")

    def bad(s: Column) -> Column:
        good = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}\s]+", ""))
        return (F.length(s) < 50) | (good / F.length(s) < 0.3) | once(F.regexp_replace(s, r"\s+", ""), few)

    return once(stripped(F.coalesce(text, F.lit(""))), bad)


def once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def runs(text: Column, k: int) -> Column:
    """All runs of k characters, in order; the text itself if it is shorter."""
    each = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (k - 1)), lambda i: F.array_join(F.slice(c, i, k), ""))
    return once(text, lambda t: F.when(F.length(t) < k, F.array(t)).otherwise(once(F.split(t, ""), each)))


def char_shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k characters of the lower-cased text with single spaces; a shorter text is one."""
    return F.array_distinct(runs(stripped(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), k))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def trigram_overlap(a: Column, b: Column) -> Column:
    """Shared character trigrams of lower-cased texts, by the larger set."""
    x, y = (F.array_distinct(runs(F.lower(t), 3)) for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))


#: Fixed value: years that count as dates.
YEAR = r"\b(19[5-9]\d|20[0-2]\d)\b"


def years(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(1))


#: Fixed value: abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Jr|Sr|vs|etc"


def sentences(text: Column, least: int = 15) -> Column:
    """Sentences of more than ``least`` characters."""
    held = F.regexp_replace(F.coalesce(text, F.lit("")), rf"({ABBREVIATIONS})\.\s", "$1\u0001")
    parts = F.split(held, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: stripped(F.replace(s, F.lit("\u0001"), F.lit(". ")))), lambda s: F.length(s) > least)


def occurrences(text: Column, part: str) -> Column:
    """How often part occurs in the lower-cased text, without overlap."""
    low, p = F.lower(text), part.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / max(len(p), 1)).cast("int")


def snippet(text: Column, part: str, before: int = 100, after: int = 200) -> Column:
    at = F.instr(F.lower(text), part.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.substring(text, start, at - start + len(part) + after)


# Document reference patterns in order of priority, then the default.
DOC_ID = (r"(HOUSE_OVERSIGHT_\d+)", r"(GM_\d+)", r"(DOJ_\d+)", r"(FBI_\d+)", r"([A-Z]{2,}_[A-Z]*_?\d{3,})")
DOC_ID_DEFAULT = "Document"


def doc_reference(text: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """The first reference by priority; prefixes: further ones of the form PREFIX_123, tried before the general pattern."""
    patterns = [*DOC_ID[:-1], *(rf"({p}_\d+)" for p in prefixes), DOC_ID[-1]]
    found = [F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(DOC_ID_DEFAULT))


# What a raw view of scanned text leaves out, in order: time stamps and line numbers, garbage of margins,
# notes of the scan (any case), references at the end, links, and page numbers.
RAW_NOISE = (
    r"\d{2}:\d{2}:\d{2}\s*",
    r"(?md)^\s*\d{1,2}\s*$",
    r"(?md)^\s*\d{1,2}\s+(?=[A-Z])",
    r"Oo O DN OO FF WwW NY =\|",
    r"NO RO PO PNP NM NO \| S\| S\| HS SF S\| S\| S\| S\| S\|",
    r"non BP WO NO -\|- ODO OO WDN OO OT BP WO NYO —",
    r"(?d)On Oa bh .*?\d+",
    r"O[nN]\s*O[aA]\s*[bB][hH]\s*[wW][hH]\s*=",
    r"[oO][rR]\d{4}\s*\d+",
    r"\d{2}:\d{2}:\d{2}\s+\d{1,2}\b",
    r"(?i)ROUGH DRAFT ONLY",
    r"(?i)ESQUIRE DEPOSITION SOLUTIONS",
    r"(954) 331-4400",
    r"(?i)Page \d+ to \d+ of \d+",
    r"(?i)\d+ of \d+ sheets",
    r"\n\s*HOUSE_OVERSIGHT_\d+\s*$",
    r"\n\s*GM_\d+\s*$",
    r'"\s*$',
    r"https?://\S+",
    r"http:/\S+",
    r"(?md)^\s*\d{2,3}\s*$",
    r"(?md)^\d{2}:\d{2}:\d{2}\s+\d+\s+",
)


def raw_view(text: Column) -> Column:
    """A scan's text without time stamps, page numbers and links; lines stripped, blank head and tail dropped."""
    for p in RAW_NOISE:
        text = F.regexp_replace(text, p, "")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " ")
    return stripped(F.regexp_replace(text, r"(?md)^[^\S\n]+|[^\S\n]+$", ""))


def title_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A name without honorific, in title case also after apostrophes and hyphens, or what an alias stands for."""
    bare = stripped(F.regexp_replace(name, r"(?i)^(?:mr|mrs|ms|dr|prof|judge|detective|agent|officer)\.?\s+", ""))
    parts = F.regexp_extract_all(F.lower(bare), F.lit(r"(?U)[^\W\d_]+|[\W\d_]+"), F.lit(0))
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")
    if not aliases:
        return titled
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(stripped(name))), titled)
