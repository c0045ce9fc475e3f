"""Secret scans that link multipart credentials, with DataFrame functions only.

Strong kinds (``assign``, ``access``, ``hex``) are reported wherever they stand.
Weak candidates (a login name, a key-like run of 40 characters, an address of a
service) say little alone: they are reported only if a part that complements
them stands within the same scope. Candidates are intervals in their document;
the link is an interval join on (document, bin of ``SCOPE`` characters) as a
semi-join, so no pairs are made.

Positions are code points. They come from the lengths of the stretches between
matches and of the matches, added up by a window over a document's candidates.

Defined cases: a null or empty text has no spans; repeated rows each get the
same result; spans that share a start are ordered by kind; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import cut, small, text_of

#: Characters between parts of one credential at most.
SCOPE = 200

# The patterns of the kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A whole run of 20 characters or more: the same spans as all runs of which shorter ones are dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i:\b(user(?:name|id)?|login|account_?id|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
KEY40 = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""

#: kind, pattern, group whose length counts, its least length, role, strong, and what a text must contain for a match.
KINDS: list[tuple[str, str, int, int, str, bool, tuple[str, ...]]] = [
    ("assign", ASSIGN, 2, 6, "secret", True, ("=", ":")),
    ("access", ACCESS, 0, 20, "identifier", True, ("AKIA",)),
    ("hex", HEX, 0, 24, "secret", True, ()),
    ("login", LOGIN, 2, 1, "identifier", False, ("=", ":")),
    ("key40", KEY40, 0, 40, "secret", False, ()),
    ("endpoint", ENDPOINT, 0, 1, "endpoint", False, ("://",)),
]
#: role: the roles that complement it.
COMPLEMENT = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
PART = "array<struct<kind:int,n:int,gap:int,len:int,group:int>>"


def _parts(text: Column, kind: int) -> Column:
    """Every match of a kind: number, length of the gap before it, its length and its group's."""
    _, pattern, group, least, _, _, needs = KINDS[kind]
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    lengths = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x))
    groups = lengths if group == 0 else F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda x: F.length(x))
    rows = F.transform(
        F.sequence(F.lit(0), F.size(lengths) - 1),
        lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.get(gaps, i).alias("gap"), F.get(lengths, i).alias("len"), F.get(groups, i).alias("group")),
    )
    may = F.lit(not needs)
    for s in needs:
        may = may | F.contains(text, F.lit(s))
    return F.when(may & text.rlike(pattern), rows.cast(PART)).otherwise(F.array().cast(PART))


def candidates(docs: DataFrame) -> DataFrame:
    """id, key, kind, role, strong, start and end of all matches; ``docs`` has id, key and text."""
    # The outer form: for the inner one the optimizer adds a filter that matches everything once more.
    parts = docs.select("id", "key", F.explode_outer(F.concat(*(_parts(F.col("text"), k) for k in range(len(KINDS))))).alias("p"))
    parts = parts.filter(F.col("p").isNotNull()).select("id", "key", "p.*")
    run = Window.partitionBy("id", "key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.distinct().withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    role = F.element_at(F.array(*(F.lit(k[4]) for k in KINDS)), F.col("kind") + 1)
    strong = F.element_at(F.array(*(F.lit(k[5]) for k in KINDS)), F.col("kind") + 1)
    kept = placed.filter(F.col("group") >= least)
    return kept.select("id", "key", "kind", role.alias("role"), strong.alias("strong"), (F.col("end") - F.col("len")).alias("start"), "end")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates that a complementary part stands beside, within ``scope`` characters."""
    reach = found.filter("not strong").withColumn("bin", F.explode(F.sequence(((F.col("start") - scope) / scope).cast("long") - 1, ((F.col("end") + scope) / scope).cast("long"))))
    wanted = F.create_map(*(x for k, v in COMPLEMENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    reach = reach.withColumn("role", F.explode(F.element_at(wanted, F.col("role"))))
    part = found.select(*(F.col(c).alias(f"other_{c}") for c in ("id", "key", "role", "start", "end")))
    # A part after the candidate is met by its start, one before it by its end, however long it is.
    part = part.withColumn("other_bin", F.explode(F.array_distinct(F.array(*((F.col(f"other_{c}") / scope).cast("long") for c in ("start", "end"))))))
    on = [reach[c].eqNullSafe(part[f"other_{c}"]) if c == "id" else reach[c] == part[f"other_{c}"] for c in ("id", "key", "role", "bin")]
    apart = F.greatest(F.col("other_start") - F.col("end"), F.col("start") - F.col("other_end"))
    met = reach.join(part, [*on, (apart >= 0) & (apart <= scope)], "left_semi")
    return met.select("id", "key", "kind", "start", "end").distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id and ``found``, its spans as sorted structs (start, kind, end)."""
    whole = text_of(docs, text)
    keyed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(whole).alias("key"), whole.alias("text"))
    found = cut(candidates(keyed))
    spans = found.filter("strong").select("id", "key", "kind", "start", "end").unionByName(linked(found, scope))
    by_doc = cut(spans.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found")))
    by_doc = small(by_doc, 48 + 40 * F.size("found")).withColumnsRenamed({"id": "own_id", "key": "own_key"})
    rows = keyed.select("id", "key")
    joined = rows.join(by_doc, (rows["key"] == by_doc["own_key"]) & rows["id"].eqNullSafe(by_doc["own_id"]), "left")
    return joined.select(F.col("id").alias("doc_id"), F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))


def as_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
