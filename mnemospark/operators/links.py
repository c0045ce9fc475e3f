"""Typed, weighted links between units: time, vectors, entities and causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scoring
from mnemospark.functions.constants import LINK_TYPES

#: Pairs that one task makes and counts.
PAIRS_PER_TASK = 250_000


def near_in_time(left: DataFrame, right: DataFrame, bank: str, id_: str, ts: str, seconds: float, distinct: bool = True) -> DataFrame:
    """Pairs (a, b, gap in seconds) of a bank within ``seconds``.

    A range join by bins: the right side stands in its own bin, the left side
    looks into three, so both are dealt by (bank, bin) and a bank with very many
    units is spread over its bins.
    """
    a = left.select(F.col(bank).alias("bank"), F.col(id_).alias("a"), scoring.seconds(F.col(ts)).alias("t"))
    b = right.select(F.col(bank).alias("bank"), F.col(id_).alias("b"), scoring.seconds(F.col(ts)).alias("u"))
    at = F.floor(F.col("t") / seconds)
    a = a.withColumn("bin", F.explode(F.array(at - 1, at, at + 1)))
    b = b.withColumn("bin", F.floor(F.col("u") / seconds))
    near = a.join(b, ["bank", "bin"]).filter(F.abs(F.col("t") - F.col("u")) <= seconds)
    if distinct:
        near = near.filter(F.col("a") != F.col("b"))
    return near.select("bank", "a", "b", F.col("u").alias("b_time"), F.abs(F.col("t") - F.col("u")).alias("gap"))


def latest_within(new: DataFrame, existing: DataFrame, bank: str, id_: str, ts: str, seconds: float, most: int) -> DataFrame:
    """For each new unit the latest ``most`` others of its bank within ``seconds``: bank, a, b, b_time, gap and rank.

    Existing units are numbered by time within their bank: a place in their bin,
    plus what the bins before hold. A new unit looks up how many there are up to
    the end of its window, in the bin of that end; the latest are then those just
    below that number, and are fetched by it. So a unit makes ``most`` + 1 rows,
    however many units its window has, and a bank is dealt by its bins.
    """
    width = seconds / 24
    t = scoring.seconds(F.col(ts))
    b = existing.filter(F.col(ts).isNotNull()).select(F.col(bank).alias("bank"), F.col(id_).alias("b"), t.alias("u"))
    b = b.withColumn("bin", F.floor(F.col("u") / width))
    a = new.filter(F.col(ts).isNotNull()).select(F.col(bank).alias("bank"), F.col(id_).alias("a"), t.alias("t")).withColumn("bin", F.floor((F.col("t") + seconds) / width))
    # Bins of a bank with a new unit's end count too: nothing may stand in them.
    held = b.groupBy("bank", "bin").agg(F.count(F.lit(1)).alias("n")).unionByName(a.select("bank", "bin", F.lit(0).cast("long").alias("n")).distinct()).groupBy("bank", "bin").agg(F.sum("n").alias("n"))
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("bank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    # Of equal times the greater id comes first, so that counting down meets the smaller one first.
    rows = b.select("bank", "bin", F.col("u").alias("at"), F.lit(0).alias("probe"), F.col("b").alias("id"), F.col("u").alias("own"))
    rows = rows.unionByName(a.select("bank", "bin", (F.col("t") + seconds).alias("at"), F.lit(1).alias("probe"), F.col("a").alias("id"), F.col("t").alias("own")))
    w = Window.partitionBy("bank", "bin").orderBy("at", "probe", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("place", F.sum(1 - F.col("probe")).over(w)).join(before, ["bank", "bin"]).withColumn("place", F.col("place") + F.col("before"))
    numbered = placed.filter("probe = 0").select("bank", "place", F.col("id").alias("b"), F.col("own").alias("u"))
    asked = placed.filter("probe = 1").select("bank", F.col("id").alias("a"), F.col("own").alias("t"), F.explode(F.sequence(F.col("place") - most, F.col("place"))).alias("place"))
    near = asked.join(numbered, ["bank", "place"]).withColumn("gap", F.abs(F.col("t") - F.col("u"))).filter((F.col("gap") <= seconds) & (F.col("a") != F.col("b")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("bank", "a", "t").orderBy(F.desc("u"), "b")))
    return ranked.filter(F.col("rank") <= most).select("bank", "a", "b", F.col("u").alias("b_time"), "gap", "rank")


def temporal_links(new: DataFrame, existing: DataFrame, bank: str, id_: str, ts: str, hours: float = 24, most: int = 10) -> DataFrame:
    """Links to the latest ``most`` units within ``hours``; weight max(0.3, 1 - gap / window)."""
    near = latest_within(new, existing, bank, id_, ts, hours * 3600, most)
    weight = F.greatest(F.lit(0.3), 1 - F.col("gap") / (hours * 3600))
    return near.select("a", "b", F.lit("temporal").alias("type"), weight.alias("weight"))


def semantic_links(new: DataFrame, existing: DataFrame, bank: str, id_: str, vector: str, most: int = 5, least: float = 0.7) -> DataFrame:
    """Links of new units to the ``most`` units of their bank with a dot product of ``least`` or more, which is the weight."""
    from mnemospark.operators.retrieval import vector_search

    found = vector_search(existing, new, id_, vector, most, least, bank=bank, metric="dot")
    return found.select(F.col("query_id").alias("a"), F.col("item_id").alias("b"), F.lit("semantic").alias("type"), scoring.clamp(F.col("score")).alias("weight"))


def temporal_pairs(new: DataFrame, bank: str, id_: str, ts: str, hours: float = 24) -> DataFrame:
    """Links in both directions between new units within the window."""
    near = near_in_time(new, new, bank, id_, ts, hours * 3600)
    return near.select("a", "b", F.lit("temporal").alias("type"), F.greatest(F.lit(0.3), 1 - F.col("gap") / (hours * 3600)).alias("weight"))


def proximity_links(units: DataFrame, bank: str, id_: str, ts: str, minutes: float = 30, first: DataFrame | None = None) -> DataFrame:
    """Unordered links between units mentioned within ``minutes``; weight falls to 0 at the edge, which is dropped.

    With ``first``, some of the units, those links whose first (lesser) end is one of these.
    """
    near = near_in_time(units if first is None else first, units, bank, id_, ts, minutes * 60).filter(F.col("a") < F.col("b"))
    return near.select("a", "b", F.lit("temporal_proximity").alias("type"), (1 - F.col("gap") / (minutes * 60)).alias("weight")).filter("weight > 0").distinct()


def entity_links(unit_entities: DataFrame, unit: str, entity: str, order: list[Column], cap: int = 50) -> DataFrame:
    """Ordered pairs of units that share an entity, among each entity's last ``cap`` units.

    The cap is the operator's definition, and it bounds the pairs of a hot
    entity at ``cap`` squared before any are made.
    """
    last = unit_entities.filter(F.col(entity).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).filter(F.col("_n") <= cap)
    # An entity's units are a set before they pair up, so no pair comes twice and none is compared again.
    units = last.groupBy(F.col(entity).alias("entity")).agg(F.collect_set(unit).alias("units"))
    pairs = units.select("entity", "units", F.explode("units").alias("a")).select("entity", "a", F.explode("units").alias("b")).filter(F.col("a") != F.col("b"))
    return pairs.select("a", "b", F.lit("entity").alias("type"), F.lit(1.0).alias("weight"), "entity")


def new_entity_links(new: DataFrame, stored: DataFrame, unit: str, entity: str, order: list[Column], cap: int = 50) -> DataFrame:
    """Entity links of new units, in both directions: every one with each entity's last ``cap`` stored units, the last ``cap`` new ones with each other.

    Both sides have ``unit``, ``entity`` and the columns of ``order`` (the latest
    first). A hot entity makes at most 2 x ``cap`` rows for each new unit.
    """
    among = entity_links(new, unit, entity, order, cap)
    last = stored.join(new.select(entity).distinct(), entity, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).filter(F.col("_n") <= cap)
    a = new.select(F.col(entity).alias("entity"), F.col(unit).alias("x")).distinct()
    across = a.join(last.select(F.col(entity).alias("entity"), F.col(unit).alias("y")).distinct(), "entity").filter(F.col("x") != F.col("y"))
    ends = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("l")
    across = across.select(ends, "entity").select("l.a", "l.b", F.lit("entity").alias("type"), F.lit(1.0).alias("weight"), "entity")
    return among.unionByName(across).distinct()


def causal_links(relations: DataFrame) -> DataFrame:
    """Valid causal relations of facts: a known type, an earlier target and no self link.

    ``relations``: batch, fact, target, relation_type, strength.
    """
    ok = F.col("relation_type").isin("causes", "caused_by", "enables", "prevents") & (F.col("target") >= 0) & (F.col("target") < F.col("fact"))
    return relations.filter(ok).select("batch", F.col("fact").alias("a"), F.col("target").alias("b"), F.col("relation_type").alias("type"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength"))).alias("weight"))


def valid_links(links: DataFrame) -> DataFrame:
    """Links of a known type, once each: the greatest weight for (least, greatest, type, entity)."""
    known = links.filter(F.col("type").isin(*LINK_TYPES))
    w = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b"), "type", F.coalesce(F.col("entity").cast("string"), F.lit(""))).orderBy(F.desc("weight"), "a", "b")
    return known.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def co_occurrences(groups: DataFrame, group: str, item: str, cap: int | None = None) -> DataFrame:
    """Unordered pairs of items that share a group, counted once a group.

    ``cap``: most items of a group that pair up (the session's window), by item.
    """
    rows = groups.select(group, item).filter(F.col(group).isNotNull())
    # Pairs are many more than the rows they come from, so tasks are made by their number: Spark would see the rows only.
    pairs = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    n = int(pairs // PAIRS_PER_TASK) + 1
    rows = rows.repartition(n, group).distinct()
    if cap:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(item))).filter(F.col("_n") <= cap).drop("_n")
    a, b = rows.withColumnRenamed(item, "a"), rows.withColumnRenamed(item, "b")
    return a.join(b, group).filter(F.col("a") < F.col("b")).repartition(n, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def co_activation_weight(n: Column, least: int = 3) -> Column:
    """min(n / 20, 0.5) from ``least`` on; null below."""
    return F.when(n >= least, F.least(n / 20, F.lit(0.5)))


def association_weight(n: Column) -> Column:
    """min(0.1 + 0.05 (n - 1), 0.5)."""
    return F.least(0.1 + 0.05 * (n - 1), F.lit(0.5))


def pair_outcomes(rows: DataFrame, key: str, role: str, value: str, left: str, right: str) -> DataFrame:
    """The rows of two roles that share a pair key, side by side."""
    a = rows.filter(F.col(role) == left).select(key, F.col(value).alias(left))
    b = rows.filter(F.col(role) == right).select(key, F.col(value).alias(right))
    return a.join(b, key)
