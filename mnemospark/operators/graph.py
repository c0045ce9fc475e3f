"""Graph search over links: forward push by patterns, spreading activation and bounded paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.constants import CAUSAL_BOOST, DEPTH, LINK_POLICY, PATTERNS, PUSH_THRESHOLD, PUSH_TOP_K, SEEDS
from mnemospark.operators.ranking import top_per
from mnemospark.session import checkpointed

ALPHA = 0.15


def neighbours(links: DataFrame, fan: int = 20, least: float = 0.1) -> DataFrame:
    """The ``fan`` strongest links of each node and type, their weights brought to a sum of one.

    links: src, dst, type, weight. Returns src, dst, type, weight, share.
    """
    near = top_per(links.filter(F.col("weight") >= least), ["src", "type"], [F.desc("weight"), F.col("dst")], fan)
    total = F.sum("weight").over(Window.partitionBy("src", "type"))
    return near.select("src", "dst", "type", "weight", (F.col("weight") / total).alias("share"))


def walk(seeds: list[DataFrame], links: DataFrame | Callable[[DataFrame], DataFrame], patterns: list[tuple[int, tuple[str, ...]]], threshold: float = 1e-6, alpha: float = ALPHA, fan: int = 20) -> DataFrame:
    """Forward push along several patterns of edge types at once: query_id, pattern (its number), node, mass.

    ``seeds``: frames of query_id, node and score; ``patterns``: the number of a
    pattern's seeds, and its types. Seed scores are brought to a sum of one per
    query. On each hop a node whose mass reaches the threshold keeps ``alpha`` of
    it and pushes the rest over its edges; below the threshold a node neither
    keeps nor pushes. What stands on the frontier at the end is added.

    Patterns share their first hops: the frontier is a table with a column for
    the prefix it has come along, and a hop is one join with the links, which are
    ranked once, whatever the number of patterns. The walk stops where the
    frontier is empty.

    ``links`` may be a function that makes the links from given nodes (a
    checkpointed frame of node, each once); then every hop makes those of its
    frontier only, whatever the number of all links.
    """
    ranked = lambda x: checkpointed(neighbours(x, fan).select("src", "type", "dst", "share"))
    near = None if callable(links) else ranked(links)
    prefixes = sorted({(s, p[:k]) for s, p in patterns for k in range(len(p) + 1)})
    number = {x: n for n, x in enumerate(prefixes)}
    spark = seeds[0].sparkSession
    on = F.broadcast(spark.createDataFrame([(number[s, p[:-1]], p[-1], number[s, p]) for s, p in prefixes if p], "at int, hop string, to int"))
    says = F.broadcast(spark.createDataFrame([(number[s, p[:k]], n, 1.0 if k == len(p) else alpha) for n, (s, p) in enumerate(patterns) for k in range(len(p) + 1)], "at int, pattern int, share double"))
    w = Window.partitionBy("query_id")
    total = F.sum("score").over(w)
    mass = F.when(total == 0, 1 / F.count(F.lit(1)).over(w)).otherwise(F.col("score") / total)
    first = [x.select("query_id", F.lit(number[n, ()]).alias("at"), "node", mass.alias("mass")) for n, x in enumerate(seeds) if (n, ()) in number]
    frontier = checkpointed(reduce(DataFrame.unionByName, first).filter(F.col("mass") >= threshold))
    reached = [frontier]
    for _ in range(max((len(p) for _, p in patterns), default=0)):
        going = frontier.join(on, "at")
        if callable(links):
            near = ranked(links(checkpointed(going.select("node").distinct())))
        step = going.join(near.withColumnRenamed("share", "part"), (F.col("node") == F.col("src")) & (F.col("hop") == F.col("type")))
        step = step.groupBy("query_id", F.col("to").alias("at"), F.col("dst").alias("node")).agg(F.sum(F.col("mass") * (1 - alpha) * F.col("part")).alias("mass"))
        frontier = checkpointed(step.filter(F.col("mass") >= threshold))
        if frontier.isEmpty():
            break
        reached.append(frontier)
    return reduce(DataFrame.unionByName, reached).join(says, "at").groupBy("query_id", "pattern", "node").agg(F.sum(F.col("mass") * F.col("share")).alias("mass"))


def push(seeds: DataFrame, links: DataFrame | Callable[[DataFrame], DataFrame], pattern: tuple[str, ...], threshold: float = 1e-6, alpha: float = ALPHA, fan: int = 20) -> DataFrame:
    """``walk`` along one pattern: query_id, node, mass."""
    return walk([seeds], links, [(0, pattern)], threshold, alpha, fan).drop("pattern")


def pattern_search(semantic: DataFrame, temporal: DataFrame | None, links: DataFrame | Callable[[DataFrame], DataFrame], mode: str = "default", budget: int = 50, k: int = 60) -> DataFrame:
    """All patterns of a mode in one walk, fused by reciprocal rank: query_id, node, score, rank."""
    patterns = PATTERNS[mode]
    threshold, most = PUSH_THRESHOLD.get(mode, 1e-6), PUSH_TOP_K.get(mode, 50)
    runs = [(0, p) for p in patterns[0]] + ([(1, p) for p in patterns[1]] if temporal is not None else [])
    rows = walk([semantic] if temporal is None else [semantic, temporal], links, runs, threshold)
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "pattern").orderBy(F.round("mass", 12).desc(), "node")))
    fused = ranked.groupBy("query_id", "node").agg(F.sum(1.0 / (k + F.col("place"))).alias("score"))
    return top_per(fused, ["query_id"], [F.round("score", 12).desc(), F.col("node")], min(budget, most))


def _boost(type_: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(x for k, v in CAUSAL_BOOST.items() for x in (F.lit(k), F.lit(v)))), type_), F.lit(1.0))


def spread(entries: DataFrame, links: DataFrame, decay: float = 0.8, least: float = 0.1, hops: int = 3, budget: int = 100) -> DataFrame:
    """Spreading activation from entries (query_id, node, score): the nodes with most activation.

    A neighbour gets activation x weight x decay, times the boost of causal
    links, at most 1. Hops are level by level: a node keeps the greatest
    activation it gets in the first level that reaches it, as in a breadth-first
    walk without a budget; the budget then takes the strongest, ties by node.
    """
    reached = entries.groupBy("query_id", "node").agg(F.max("score").alias("activation")).withColumn("depth", F.lit(0))
    edges = checkpointed(links.select(F.col("src").alias("node"), "dst", "weight", "type"))
    for depth in range(1, hops + 1):
        from_ = reached.filter(F.col("depth") == depth - 1)
        value = F.least(F.lit(1.0), F.col("activation") * F.col("weight") * decay * _boost(F.col("type")))
        step = from_.join(edges, "node").select("query_id", F.col("dst").alias("node"), value.alias("activation")).filter(F.col("activation") >= least)
        step = step.groupBy("query_id", "node").agg(F.max("activation").alias("activation")).withColumn("depth", F.lit(depth))
        reached = checkpointed(reached.unionByName(step.join(reached.select("query_id", "node"), ["query_id", "node"], "left_anti")))
    return top_per(reached, ["query_id"], [F.round("activation", 12).desc(), F.col("node")], budget)


def temporal_spread(entries: DataFrame, links: DataFrame, proximity: DataFrame, hops: int = 3, fade: float = 0.7, least: float = 0.2, fan: int = 200, budget: int = 100) -> DataFrame:
    """Spread from temporal entries: neighbours count by link, fading, and by their own date.

    ``proximity``: query_id, node, proximity of dated units; others count 0.3.
    Each hop follows a query's ``fan`` strongest links (weight, then node).
    """
    reached = entries.groupBy("query_id", "node").agg(F.max("score").alias("score")).withColumn("depth", F.lit(0))
    edges = checkpointed(links.select(F.col("src").alias("node"), "dst", "weight", "type"))
    for depth in range(1, hops + 1):
        from_ = reached.filter((F.col("depth") == depth - 1) & (F.col("score") > least))
        step = from_.join(edges, "node").select("query_id", F.col("dst").alias("node"), "weight", (F.col("score") * F.col("weight") * fade * _boost(F.col("type"))).alias("passed"))
        step = step.join(reached.select("query_id", "node"), ["query_id", "node"], "left_anti")
        step = top_per(step, ["query_id"], [F.desc("weight"), F.col("node"), F.desc("passed")], fan)
        step = step.join(proximity, ["query_id", "node"], "left").withColumn("score", F.greatest(F.least(F.lit(1.0), F.col("passed")), F.coalesce("proximity", F.lit(0.3)) * F.least(F.lit(1.0), F.col("passed"))))
        reached = checkpointed(reached.unionByName(step.groupBy("query_id", "node").agg(F.max("score").alias("score")).withColumn("depth", F.lit(depth))))
    return top_per(reached, ["query_id"], [F.round("score", 12).desc(), F.col("node")], budget)


def within_depth(seeds: DataFrame, links: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """Nodes within ``depth`` hops of a query's seeds and 1 / (1 + the least depth).

    Every edge on a path has ``least`` weight or more.
    """
    edges = links.filter(F.col("weight") >= least).select(F.col("src").alias("node"), "dst").distinct()
    reached = seeds.select("query_id", "node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = reached.filter(F.col("depth") == d - 1).join(edges, "node").select("query_id", F.col("dst").alias("node")).distinct()
        reached = reached.unionByName(step.join(reached.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(d)))
    return reached.withColumn("activation", 1 / (1 + F.col("depth")))


def engram_search(seeds: DataFrame, links: DataFrame, mode: str, weak: float = 0.3) -> DataFrame:
    """Graph retriever by mode: its seeds, its depth and what it does with weak links.

    ``ignore`` leaves links below ``weak`` out, ``follow`` takes all, ``prefer``
    takes all and multiplies what is reached over a weak link by 1.5, at most 1.
    """
    first = top_per(seeds, ["query_id"], [F.desc("score"), F.col("node")], SEEDS[mode])
    policy = LINK_POLICY[mode]
    found = within_depth(first, links, DEPTH[mode], weak if policy == "ignore" else 0.0)
    if policy != "prefer":
        return found
    over_weak = links.filter(F.col("weight") < weak).select(F.col("dst").alias("node")).distinct().withColumn("_weak", F.lit(1.5))
    return found.join(over_weak, "node", "left").withColumn("activation", F.least(F.lit(1.0), F.col("activation") * F.coalesce("_weak", F.lit(1.0)))).drop("_weak")


def hybrid(schemas: DataFrame, engrams: DataFrame, schema_weight: float, engram_weight: float, k: int) -> DataFrame:
    """Schemas and engrams (query_id, id, score) in one list by weighted score."""
    both = schemas.withColumn("kind", F.lit("schema")).withColumn("value", F.col("score") * schema_weight).unionByName(engrams.withColumn("kind", F.lit("engram")).withColumn("value", F.col("score") * engram_weight))
    return top_per(both, ["query_id"], [F.round("value", 12).desc(), F.col("kind"), F.col("id")], k)


def relationships(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """All links from or to the given nodes, with the other side."""
    out = links.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", "weight", F.lit("out").alias("direction"))
    into = links.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", "weight", F.lit("in").alias("direction"))
    return out.unionByName(into)


def view(units: DataFrame, links: DataFrame, strength: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with strength and colour, and edges between them once each, for display."""
    nodes = units.join(strength, "id", "left").withColumn("strength", F.coalesce("strength", F.lit(0.5)))
    nodes = nodes.withColumn("colour", F.when(F.col("strength") < 0.3, "weak").when(F.col("strength") <= 0.7, "medium").otherwise("strong"))
    ends = units.select("id")
    inside = links.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    w = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"), "type").orderBy(F.desc("weight"), "src")
    return nodes, inside.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
