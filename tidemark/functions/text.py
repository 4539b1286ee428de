"""Text expressions: white space, tokens, snippets, token F1, topics, shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed

TOKEN = r"[\p{L}\p{N}_]+"
# Topics that documents are tagged with.
TOPICS = ("Kafka", "Flink", "Spark", "Redis", "Kubernetes", "Ray", "TensorFlow", "PyTorch", "GraphQL", "React", "Rust")
SNIPPET = 200
#: Characters of the snippet before the hit.
LEAD = 66


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order. (Folding differs from lower case for a few letters, as the German sharp s.)"""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def snippet(text: Column, query: str, size: int = SNIPPET, lead: int = LEAD) -> Column:
    """A window around the first hit of the whole query, with an ellipsis on cut sides; the beginning without a hit."""
    flat = collapse(text)
    hit = F.instr(F.lower(flat), query.strip().lower())
    start = F.greatest(F.lit(1), hit - lead)
    end = F.least(F.length(flat), start + size - 1)
    found = F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.substring(flat, start, end - start + 1)), F.when(end < F.length(flat), "…").otherwise(""))
    return F.when(hit > 0, found).otherwise(F.trim(F.substring(flat, 1, size)))


def split_names(value: Column) -> Column:
    """camelCase, snake_case and kebab-case to words."""
    apart = F.regexp_replace(value, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(apart, r"[^A-Za-z0-9]+", " ")))


def topics(text: Column, names: Sequence[str] = TOPICS, as_written: bool = False) -> Column:
    """Names that occur as words, whatever their case. ``as_written`` looks for a literal backslash on either side, as a faulty pattern would."""
    edge = r"\\b" if as_written else r"\b"
    return F.filter(
        F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){edge}{n}{edge}"), F.lit(n)) for n in names)), lambda t: t.isNotNull()
    )


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two short arrays of tokens, as of titles; ``evaluation.overlaps`` is for texts."""
    count = lambda x, t: F.size(F.filter(x, lambda u: u == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))


def token_f1(a: Column, b: Column) -> Column:
    """2 * overlap / sizes; 1 if both are empty, 0 if one is."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * overlap(a, b) / both)


def coverage(needed: Column, given: Column) -> Column:
    """Part of the distinct needed words that are given."""
    wanted = F.array_distinct(needed)
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, given)) / F.size(wanted))


def says(text: Column, pattern: str) -> Column:
    """Whether a fixed pattern is found, whatever the case."""
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def shape_tokens(text: Column, links: Column | None = None, heading: Column | None = None) -> Column:
    """What a node's text looks like, as an array of tokens: its length, links and, if it is short, its phrases."""
    links, heading = F.lit(0) if links is None else links, F.lit(False) if heading is None else heading
    text = F.coalesce(text, F.lit(""))
    words = F.size(plain_words(text))
    length = F.when(words.between(1, 20), "shape:short_text").when(words <= 40, "shape:medium_text").when(words <= 100, "shape:long_text").otherwise("shape:very_long_text")
    linked = F.when(links == 1, "shape:one_link").when(links > 1, "shape:multiple_links")
    local = (F.length(text) <= 500) & (words <= 80)
    date, reading = says(text, fixed.DATE_LIKE), says(text, fixed.READING_TIME)
    phrases = [
        ("phrase:by_prefix", says(text, fixed.BY_PREFIX)),
        ("phrase:by_colon", says(text, fixed.BY_COLON)),
        ("phrase:written_by", says(text, fixed.WRITTEN_BY_ANY)),
        ("phrase:article_written_by", says(text, fixed.ARTICLE_WRITTEN_BY)),
        ("phrase:author_label", says(text, fixed.AUTHOR_LABEL)),
        ("phrase:acknowledgements", says(text, fixed.ACKNOWLEDGEMENTS)),
        ("phrase:contributors", says(text, fixed.CONTRIBUTOR)),
        ("phrase:thanks_to", says(text, fixed.THANKS_TO)),
        ("phrase:published", says(text, fixed.PUBLISHED_MARKER)),
        ("phrase:updated", says(text, fixed.UPDATED_MARKER)),
        ("shape:single_name", ~heading & name_shape(text)),
        ("shape:multiple_names", says(text, fixed.MULTIPLE_NAME)),
        ("shape:comma_list", text.contains(",")),
        ("shape:and_last_name", says(text, fixed.AND_LAST_NAME)),
        ("shape:handle", says(text, rf"^\s*{fixed.HANDLE}\s*$")),
        ("shape:organization", says(text, fixed.ORGANIZATION_AUTHOR)),
        ("shape:name_and_role", says(text, fixed.AUTHOR_ROLE)),
        ("shape:absolute_date", date),
        ("shape:relative_date", says(text, fixed.RELATIVE_DATE)),
        ("shape:reading_time", reading),
        ("shape:date_plus_reading_time", date & reading),
    ]
    found = F.array(length, linked, *(F.when(local & condition, name) for name, condition in phrases))
    return F.filter(found, lambda t: t.isNotNull())


def name_shape(text: Column) -> Column:
    """A handle, or up to eight words of which half are capitalised, without a date."""
    words = plain_words(text)
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return says(F.trim(text), f"^{fixed.HANDLE}$") | (F.size(words).between(1, 8) & (2 * capitals >= F.size(words)) & ~says(text, fixed.DATE_LIKE))


def person_name(text: Column) -> Column:
    """Two to five capitalised words of letters."""
    return F.coalesce(text.rlike(r"^\s*\p{Lu}[\p{L}'’.-]*(\s+\p{Lu}[\p{L}'’.-]*){1,4}\s*$"), F.lit(False))


def without_byline_prefix(text: Column) -> Column:
    """A byline without "by", "written by" or "authors:" before the names; text is lower-cased and its white space collapsed."""
    # fixed value: what may stand before names
    return F.regexp_replace(collapse(F.lower(F.coalesce(text, F.lit("")))), r"^(?:(?:written|authored)\s+by|by|authors?)\s*[:\-]?\s*", "")
