"""Text and tag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.constants import STOPWORDS

#: What separates tokens; the same explicit class holds in the oracles.
NOT_TOKEN = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, with repeats; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_TOKEN), "")


def keyword_rank(doc: Column, query: Column) -> Column:
    """0.1 for each token of the document that the query names."""
    return F.size(F.filter(doc, lambda t: F.array_contains(query, t))) * F.lit(0.1)


def query_tags(text: Column) -> Column:
    """Distinct words of letters, of three or more, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_sort(F.array_except(F.filter(F.array_distinct(words), lambda w: F.length(w) >= 3), F.array(*map(F.lit, STOPWORDS))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def tag_union(*lists: Column) -> Column:
    """All tags, each once, in the order in which they come first; a null list has none."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def contains_all(have: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, have)) == 0


def tag_key(tag: Column) -> Column:
    """Before the first colon; ``_keywords`` if a side is empty."""
    return F.when(_split(tag), F.trim(F.substring_index(F.trim(tag), ":", 1))).otherwise("_keywords")


def tag_value(tag: Column) -> Column:
    t = F.trim(tag)
    return F.when(_split(tag), F.trim(F.substr(t, F.locate(":", t) + 1))).otherwise(t)


def _split(tag: Column) -> Column:
    t = F.trim(tag)
    at = F.locate(":", t)
    return (at > 0) & (F.length(F.trim(F.substring_index(t, ":", 1))) > 0) & (F.length(F.trim(F.substr(t, at + 1))) > 0)


def sanitise(text: Column) -> Column:
    """Without lone surrogates and null characters."""
    return F.regexp_replace(text, r"[\x00\ud800-\udfff]", "")


def n_tokens(text: Column) -> Column:
    """Tokens by words: the stand-in for a model's own count."""
    return F.size(tokens(text))


def strip_fence(text: Column) -> Column:
    """JSON without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", ""))


def readable_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM yyyy")


def augmented(text: Column, ts: Column, task: Column | None = None, label: Column | None = None, share: Column | None = None) -> Column:
    """Text with its month, its task and a label that has more than 0.6 of the evidence."""
    parts = [text, F.when(ts.isNotNull(), F.concat(F.lit("(happened in "), readable_date(ts), F.lit(")")))]
    if task is not None:
        parts.append(F.when(F.length(task) > 0, F.concat(F.lit("[task: "), task, F.lit("]"))))
    if label is not None and share is not None:
        parts.append(F.when(share > 0.6, F.concat(F.lit("[mostly "), label, F.lit("]"))))
    return F.concat_ws(" ", *parts)


def first_person(text: Column, name: Column) -> Column:
    """An opinion told about ``name`` put in the first person."""
    return F.regexp_replace(F.regexp_replace(text, F.concat(F.lit(r"^\Q"), name, F.lit(r"\E (believes|thinks) ")), F.lit("I believe ")), F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E's\b")), F.lit("my"))


def describe(properties: Column, most: int = 240) -> Column:
    """key: value pairs of a map in key order, cut at ``most`` characters."""
    entries = F.array_sort(F.map_entries(properties))
    return F.substring(F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "; "), 1, most)
