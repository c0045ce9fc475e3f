"""Interaction audit of filters, over the lattice of what was already applied.

A document is judged by every filter once and becomes a mask of the filters it
fails. An edge of the lattice is (subset of filters already applied, next
filter); five filters have 80 edges, and what an edge keeps, removes or finds
already gone depends on the mask alone. So documents are counted by (part, mask)
first, these few rows contribute to every edge, and the aggregated edges are
joined with the steps of all orders: an order is a path through the lattice, and
the 600 steps of the 120 orders share the 80 edges.

Identical texts are found by 128-bit digests: each digest's smallest doc_id is an
aggregate that combines before the shuffle, and only digests of two rows or more
are joined back (``join_counted``: a text that a third of all rows have is no
task's work). Rows that fail this filter are counted again with the bit set and
taken off without it, so all others need no join.

Defined cases: a null text is empty; a null part is the empty string; a null
doc_id is larger than no other, so its row fails no comparison with smaller ids,
and has no label; rows that share doc_id and text are not smaller than each
other; several labels of one doc_id count if any of them is 1; labels of unknown
documents count nowhere; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import SPACE_CLASS, cut, join_counted, small, text_of, tune

#: The letters of the filters, in the order of their bits.
FILTERS = "ABCDE"
#: The bit of the filter that compares texts of the whole table.
COPY = 4
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters that look at one text only, given it and its words."""
    n = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * upper > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, mask and weight: the weights of one (part, mask) add up to its documents.

    A document that fails the copy filter has three rows: its own mask, the
    same taken off again, and the mask with the bit.
    """
    tune(docs.sparkSession)
    whole = text_of(docs, text)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    source = source.withColumn("words", F.array_remove(F.split("text", SPACE_CLASS + "+"), ""))
    own = cut(source.select("doc_id", "part", own_failures(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")))
    firsts = cut(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    copies = join_counted(own, firsts, ["digest"], "rows", 64, ["doc_id"]).filter("doc_id > first").select("doc_id", "part", "mask")
    copies = cut(copies)
    # One pass over the copies gives both corrections.
    corrections = copies.select("doc_id", "part", F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("weight")), F.struct((F.col("mask") + (1 << COPY)).alias("mask"), F.lit(1).alias("weight")))).alias("c"))
    return own.select("doc_id", "part", "mask", F.lit(1).alias("weight")).unionByName(corrections.select("doc_id", "part", "c.mask", "c.weight"))


def counted(masked: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents by part and mask: n, good (quality 1) and toxic (toxic 1)."""
    says = labels.select(F.col(f"`{doc_id}`").cast("long").alias("marked"), F.col("quality"), F.col("toxic")).filter("marked is not null")
    is_1 = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    says = cut(says.groupBy("marked").agg(is_1("quality").alias("good"), is_1("toxic").alias("toxic")).filter("good = 1 or toxic = 1"))
    all_ = masked.groupBy("part", "mask").agg(F.sum("weight").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    known = masked.join(small(says, 24), F.col("doc_id") == F.col("marked"))
    known = known.groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum(F.col("weight") * F.col("good")).alias("good"), F.sum(F.col("weight") * F.col("toxic")).alias("toxic"))
    return all_.unionByName(known).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def edges(counts: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, before (mask of the filters applied), next (filter), the measures and shapley, of every edge of the lattice."""
    all_ = [(s, f) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]
    literal = F.array(*(F.struct(F.lit(s).alias("before"), F.lit(f).alias("next"), F.lit(1 << f).alias("bit")) for s, f in all_))
    each = counts.select("part", "mask", "n", "good", "toxic", F.explode(literal).alias("e")).select("*", "e.*")
    reached = F.col("mask").bitwiseAND(F.col("before")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(when: Column, what: str) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))

    found = each.groupBy("part", "before", "next").agg(
        total(reached & ~fails, "n").alias("kept"),
        total(reached & fails, "n").alias("removed"),
        total(~reached & fails, "n").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
    )
    # So many orders pass an edge as there are orders of what stands before it and of what comes after it.
    size = F.bit_count("before")
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(filters - 1 - k)) for k in range(filters))), size + 1)
    whole = found.groupBy(F.col("part").alias("of"), F.col("next").alias("filter")).agg(F.sum(F.col("removed") * ways).alias("shapley"))
    return found.join(whole, (F.col("part") == F.col("of")) & (F.col("next") == F.col("filter"))).select("part", "before", "next", *MEASURES, "shapley")


def steps(spark, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, and the edge that it goes along, of every order of the filters: their number's factorial times their number."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for k, f in enumerate(order):
            rows.append(("".join(filters[x] for x in order), k + 1, before, f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, before int, next int")


def paths(along: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The edges joined to every order's steps."""
    all_ = F.broadcast(steps(along.sparkSession, filters))  # a fixed number of rows
    return along.join(all_, ["before", "next"]).select("part", "filter_order", "step", *MEASURES, "shapley")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included."""
    counts = cut(counted(masks(docs, doc_id, text, part), labels, doc_id))  # at most 32 rows a part
    return paths(edges(counts))
