"""Hyper-schemas: schemas of a bank that are alike but differ in properties get a common parent.

Pairs are taken first fit in listing order, each schema once. Done one after
another, that is the greedy matching over the pairs in order of (first, second).
A schema's partner is the first free one behind it, so ``pairs`` compares it with
those just behind it, and with more only while it has found none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import vector
from mnemospark.operators.clustering import PAIRS, _unit, numbers, within
from mnemospark.session import Rewritten, checkpointed

#: Least cosine and least number of differing properties of a pair.
LEAST, DIFFERENCES = 0.7, 1
#: Rows of a block: a schema is compared with its own block and the next, of a larger size in each round, then with all.
BLOCKS = (256, 2048, 16384)
#: Rows of a block that meet the other block's at a time.
SLICE = 256
#: Fixed value: how a parent is described, from its two schemas and the differing keys.
DESCRIPTION = "HyperSchema über '%s' und '%s' (differing keys: %s)"
PROPERTY = "key string, type string, count long, mean double, min double, max double, first_time string, last_time string, value string"


def _first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges, in order, both of whose ends are free; what is kept is the taken ends that lie ahead."""
    of, at, ahead = None, None, set()
    for batch in batches:
        taken = []
        for k, (bank, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if bank != of:
                of, at, ahead = bank, None, set()
            if a != at:
                at, free = a, a not in ahead
                ahead.discard(a)
            if free and b not in ahead:
                free = False
                ahead.add(b)
                taken.append(k)
        yield batch.take(pa.array(taken, pa.int64()))


def matched(edges: DataFrame) -> DataFrame:
    """The greedy matching of (of, a, b), a < b, by order of a, then b, within each ``of``.

    One pass over the edges in that order, bank by bank; the edges are sorted on
    disk and the pass holds no more of them than a batch.
    """
    rows = edges.select("of", "a", "b")
    return rows.repartition("of").sortWithinPartitions("of", "a", "b").mapInArrow(_first_fit, rows.schema)


def _ahead(cut: float):
    """Pairs within the cut of the rows that ask and a block, of those behind what they were compared with before."""

    def run(own: pa.Table, all_: pa.Table) -> pa.Table:
        none = pa.Table.from_pydict({"of": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        if not len(own) or not len(all_):
            return none
        b, others, parts = all_.column("node").to_numpy(), _unit(numbers(all_.column("v"))), [none]
        for k in range(0, len(own), SLICE):
            part = own.slice(k, SLICE)
            a = part.column("node").to_numpy()
            d = np.round(1 - _unit(numbers(part.column("v"))) @ others.T, 9)
            i, j = np.nonzero((d <= cut) & (part.column("past").to_numpy()[:, None] < b[None, :]))
            parts.append(pa.Table.from_arrays([pa.repeat(own.column("of")[0], len(i)), pa.array(a[i]), pa.array(b[j]), pa.array(d[i, j])], ["of", "a", "b", "d"]))
        return pa.concat_tables(parts)

    return run


def _next(rows: DataFrame, asks: DataFrame, cut: float, block: int) -> DataFrame:
    """of, a, b and d of the pairs within the cut of ``asks`` (of, node, past) and rows behind ``past``, to the end of the next block."""
    at = rows.select("of", "node", "v", F.expr(f"cast((node - 1) div {block} as int)").alias("block"))
    upto = F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block")
    asked = at.join(asks, ["of", "node"]).select("of", F.col("block").alias("own"), upto, "node", "past", "v")
    others = at.join(asked.select("of", "own", "block").distinct(), ["of", "block"]).select("of", "own", "block", "node", "v")
    by = ["of", "own", "block"]
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))
    return asked.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(_ahead(cut), PAIRS)


def _differing(a: Column, b: Column) -> Column:
    """The keys, in order, whose summaries differ or that one side lacks."""
    return F.array_sort(F.array_distinct(F.transform(F.array_union(F.array_except(a, b), F.array_except(b, a)), lambda s: s["key"])))


def pairs(schemas: DataFrame, least: float = LEAST, least_differences: int = DIFFERENCES) -> DataFrame:
    """of, a, b (ids), similarity and differing (keys) of the pairs that become hyper-schemas.

    schemas: of, id, centroid and summaries, an array of structs with a ``key``.
    Schemas without a bank, an id or a centroid, or with a centroid of zero length, pair with nothing;
    of rows that share an id in a bank one counts.
    """
    rows = schemas.select(F.col("of").cast("string").alias("of"), F.col("id").cast("string").alias("id"), F.col("centroid").cast("array<double>").alias("v"), F.array_sort(F.array_distinct("summaries")).alias("summaries"))
    rows = rows.filter(F.col("of").isNotNull() & F.col("id").isNotNull() & (F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0)).dropDuplicates(["of", "id"])
    place = rows.select("of", "id", F.row_number().over(Window.partitionBy("of").orderBy("id")).cast("long").alias("node"), F.count(F.lit(1)).over(Window.partitionBy("of")).alias("rows"))
    rows = checkpointed(rows.join(place, ["of", "id"]))
    side = lambda x: rows.select("of", F.col("node").alias(x), F.col("id").alias(f"id_{x}"), F.col("summaries").alias(f"s_{x}"))
    differing = _differing(F.col("s_a"), F.col("s_b"))
    table, found, k = Rewritten(rows.sparkSession, "reach"), None, 0
    reach = table.put(rows.select("of", "node", "rows", F.col("node").alias("past")))  # behind a node, up to ``past``, all of its pairs are known
    asks = reach.filter("past < rows")
    while True:
        # First fit over the known pairs is first fit over all once every schema that found none was compared with all behind it.
        if k < len(BLOCKS):
            near, upto = _next(rows, asks, 1 - least, BLOCKS[k]), F.least("rows", (F.expr(f"(node - 1) div {BLOCKS[k]}") + 2) * BLOCKS[k])
        else:
            near = within(rows.select("of", "node", "v"), 1 - least, asks=asks)
            near, upto = near.join(asks.select("of", F.col("node").alias("a"), "past"), ["of", "a"]).filter("b > past"), F.col("rows")
        near = near.select("of", "a", "b", "d")
        if least_differences > 0:
            # Sets in order are equal if no key differs; keys are only listed where more than one is asked for.
            near = near.join(side("a"), ["of", "a"]).join(side("b"), ["of", "b"]).filter(F.col("s_a") != F.col("s_b") if least_differences == 1 else F.size(differing) >= least_differences)
        near = checkpointed(near.select("of", "a", "b", "d"))
        found = near if found is None else found.unionByName(near)
        taken = checkpointed(matched(found))
        asked = asks.select("of", "node", F.lit(True).alias("asked"))
        reach = table.put(reach.join(asked, ["of", "node"], "left").select("of", "node", "rows", F.when(F.col("asked"), F.greatest("past", upto)).otherwise(F.col("past")).alias("past")))
        paired = taken.select("of", F.explode(F.array("a", "b")).alias("node"))
        asks = checkpointed(reach.filter("past < rows").join(paired, ["of", "node"], "left_anti"))
        k += 1
        if asks.isEmpty():
            break
    both = found.join(taken, ["of", "a", "b"]).join(side("a"), ["of", "a"]).join(side("b"), ["of", "b"])
    return both.select("of", F.col("id_a").alias("a"), F.col("id_b").alias("b"), (1 - F.col("d")).alias("similarity"), differing.alias("differing"))


def pair_up(schemas: DataFrame, bank: str, id_: str, least: float = LEAST, least_differences: int = DIFFERENCES) -> DataFrame:
    """bank, a, b and similarity of the pairs among schemas whose ``properties`` are a map of strings."""
    rows = schemas.select(F.col(bank).alias("of"), F.col(id_).alias("id"), "centroid", F.map_entries("properties").alias("summaries"))
    return pairs(rows, least, least_differences).select(F.col("of").alias("bank"), "a", "b", "similarity")


def summaries(properties: DataFrame) -> DataFrame:
    """of, id and the summaries of a schema's properties: the value, the mean, or both ends in time."""
    one = F.when(F.col("type") == "numeric", F.col("mean").cast("string")).when(F.col("type") == "temporal", F.col("first_time")).otherwise(F.col("value"))
    two = F.when(F.col("type") == "temporal", F.col("last_time"))
    each = properties.select(F.col("of").cast("string").alias("of"), F.col("id").cast("string").alias("id"), F.struct("key", "type", one.alias("one"), two.alias("two")).alias("s"))
    return each.groupBy("of", "id").agg(F.collect_set("s").alias("summaries"))


def merged(pairs_: DataFrame, properties: DataFrame) -> DataFrame:
    """of, a, b and the properties of each pair's parent.

    What one side lacks is taken from the other. Numbers join their ranges and
    have the mean of both means, times join their ranges, equal values stay,
    and others become a set of values (``categorical_set``, joined by ``|``), as
    do properties of different types, first the left one's summary.
    """
    shown = F.when(F.col("type") == "numeric", F.col("mean").cast("string")).when(F.col("type") == "temporal", F.concat_ws("..", "first_time", "last_time")).otherwise(F.col("value"))
    p = properties.withColumns({"of": F.col("of").cast("string"), "id": F.col("id").cast("string"), "shown": shown})
    p = p.select("of", "id", "key", F.struct("type", "count", "mean", "min", "max", "first_time", "last_time", "value", "shown").alias("p"))
    at = lambda x: pairs_.select("of", "a", "b", F.col(x).alias("id")).join(p, ["of", "id"]).select("of", "a", "b", "key", F.col("p").alias(x + "_p"))
    both = at("a").join(at("b"), ["of", "a", "b", "key"], "full")
    x, y = F.col("a_p"), F.col("b_p")
    lone, same = x.isNull() | y.isNull(), F.coalesce(x["type"] == y["type"], F.lit(False))
    numeric, temporal = same & (x["type"] == "numeric"), same & (x["type"] == "temporal")
    equal = same & ~numeric & ~temporal & x["value"].eqNullSafe(y["value"])
    mixed = ~(lone | numeric | temporal | equal)
    set_ = F.when(same, F.array_join(F.array_sort(F.array_distinct(F.concat(F.split(x["value"], r"\|"), F.split(y["value"], r"\|")))), "|")).otherwise(F.concat_ws("|", x["shown"], y["shown"]))
    any_ = lambda f: F.coalesce(x[f], y[f])
    count = F.coalesce(x["count"], F.lit(0)) + F.coalesce(y["count"], F.lit(0))
    return both.select(
        "of",
        "a",
        "b",
        "key",
        F.when(mixed, "categorical_set").otherwise(any_("type")).alias("type"),
        F.when(~mixed, count).cast("long").alias("count"),
        F.when(numeric, (x["mean"] + y["mean"]) / 2).when(lone, any_("mean")).alias("mean"),
        F.when(~mixed, F.least(x["min"], y["min"])).alias("min"),
        F.when(~mixed, F.greatest(x["max"], y["max"])).alias("max"),
        F.when(~mixed, F.least(x["first_time"], y["first_time"])).alias("first_time"),
        F.when(~mixed, F.greatest(x["last_time"], y["last_time"])).alias("last_time"),
        F.when(mixed, set_).when(~(numeric | temporal), any_("value")).alias("value"),
    )


def hyper_schemas(schemas: DataFrame, properties: DataFrame, least: float = LEAST, least_differences: int = DIFFERENCES) -> tuple[DataFrame, DataFrame]:
    """The parents of a run and their properties.

    schemas: of (bank), id, centroid, evidence, description; properties: of, id and
    the columns of ``PROPERTY``. Parents: of, hyper_id (a digest of bank and
    pair), a, b, similarity, differing, centroid (mean of both, of unit length), evidence
    (sum), description. Their properties: of, hyper_id and ``PROPERTY``.
    """
    s = schemas.select(F.col("of").cast("string").alias("of"), F.col("id").cast("string").alias("id"), F.col("centroid").cast("array<double>").alias("centroid"), F.coalesce("evidence", F.lit(0)).alias("evidence"), "description")
    with_ = s.join(summaries(properties), ["of", "id"], "left").withColumn("summaries", F.coalesce("summaries", F.filter(F.array(F.struct(*(F.lit("").alias(c) for c in ("key", "type", "one", "two")))), lambda _: F.lit(False))))
    found = checkpointed(pairs(with_, least, least_differences).withColumn("hyper_id", F.concat(F.lit("hyper-"), F.substring(F.sha2(F.to_json(F.array("of", "a", "b")), 256), 1, 32))))
    s = s.dropDuplicates(["of", "id"])
    side = lambda x: s.select("of", F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("centroid", "evidence", "description")))
    both = found.join(side("a"), ["of", "a"]).join(side("b"), ["of", "b"])
    centre = vector.weighted_centroid(F.col("centroid_a"), F.col("centroid_b"), F.lit(0.5), F.lit(0.5))
    keys = F.when(F.size("differing") > 0, F.array_join("differing", ", ")).otherwise("—")
    told = F.format_string(DESCRIPTION, F.coalesce("description_a", F.lit("")), F.coalesce("description_b", F.lit("")), keys)
    parents = both.select("of", "hyper_id", "a", "b", "similarity", "differing", centre.alias("centroid"), (F.col("evidence_a") + F.col("evidence_b")).alias("evidence"), told.alias("description"))
    return parents, merged(found, properties).join(found.select("of", "a", "b", "hyper_id"), ["of", "a", "b"]).drop("a", "b")
