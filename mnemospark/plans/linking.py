"""Link and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.constants import ENGRAM_WEIGHT, PATTERNS, SCHEMA_WEIGHT
from mnemospark.operators import entities, graph, links
from mnemospark.plans.derived import EVENT_LINKS, EVERY, event_links
from mnemospark.sources.tables import table
from mnemospark.streaming import sessions


def temporal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's links to the ten latest events of its user within a day."""
    e = table(spark, sf_dir, "events")
    return links.temporal_links(e, e, "user_id", "event_id", "ts").select("a", "b", "type", F.round("weight", 6).alias("weight"))


TEMPORAL = f"WITH {EVENT_LINKS} SELECT a, b, type, round(weight, 6) AS weight FROM temporal"


def temporal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a user's events within an hour, in both directions."""
    return links.temporal_pairs(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", 1).select("a", "b", F.round("weight", 6).alias("weight"))


TEMPORAL_PAIRS = """
SELECT x.event_id AS a, y.event_id AS b, round(greatest(0.3, 1 - abs(epoch(x.ts) - epoch(y.ts)) / 3600), 6) AS weight
FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id <> y.event_id AND abs(epoch(x.ts) - epoch(y.ts)) <= 3600"""


def proximity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between a user's events within half an hour."""
    return links.proximity_links(table(spark, sf_dir, "events"), "user_id", "event_id", "ts").select("a", "b", F.round("weight", 6).alias("weight"))


PROXIMITY = f"WITH {EVENT_LINKS} SELECT a, b, round(weight, 6) AS weight FROM close"


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the last fifty orders of each part."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    found = links.entity_links(l, "l_orderkey", "l_partkey", [F.desc("l_orderkey")])
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("n_links"), F.min("a").alias("first"), F.max("b").alias("last"))


ENTITY_LINKS = """
WITH u AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)),
p AS (SELECT x.l_partkey AS entity, x.l_orderkey AS a, y.l_orderkey AS b FROM u x JOIN u y ON x.l_partkey = y.l_partkey AND x.l_orderkey <> y.l_orderkey WHERE x.r <= 50 AND y.r <= 50)
SELECT entity, count(*) AS n_links, min(a) AS first, max(b) AS last FROM p GROUP BY entity"""


def entity_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share orders, and how many."""
    return links.co_occurrences(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


CO_OCCURRENCE = """
WITH u AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM u x JOIN u y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL"""


def co_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers seen in the same orders three times or more, with their link weight."""
    n = links.co_occurrences(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
    return n.select("a", "b", "n", F.round(links.co_activation_weight(F.col("n")), 6).alias("weight")).filter("weight is not null")


CO_ACTIVATION = """
WITH u AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM u x JOIN u y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)
SELECT a, b, n, round(least(n / 20, 0.5), 6) AS weight FROM p WHERE n >= 3"""


def session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events within five minutes of each other, with their association weight."""
    found = sessions.associations(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")
    return found.select(F.col("bank").alias("user_id"), "a", "b", "n", F.round("weight", 6).alias("weight"))


SESSION_PAIRS = """
SELECT x.user_id, x.event_id AS a, y.event_id AS b, count(*) AS n, round(least(0.1 + 0.05 * (count(*) - 1), 0.5), 6)::DOUBLE AS weight
FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id < y.event_id AND abs(epoch(x.ts) - epoch(y.ts)) <= 300 GROUP BY ALL"""


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, closed after a day without events."""
    found = sessions.sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


EVENT_SESSIONS = """
WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 86400000000 THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(t) AS start, max(t) + 86400000000 AS "end", count(*) AS n FROM s GROUP BY user_id, no"""


def links_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link for each unordered pair and type: the strongest."""
    rows = event_links(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", "weight", F.lit(None).cast("string").alias("entity"))
    return links.valid_links(rows).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "type", F.round("weight", 6).alias("weight"))


DISTINCT_PAIRS = f"WITH {EVENT_LINKS} SELECT least(src, dst) AS low, greatest(src, dst) AS high, type, round(max(weight), 6) AS weight FROM links GROUP BY 1, 2, 3"


def causal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal relations of order lines to earlier lines of the order: whitelisted, in range, no self link."""
    l = table(spark, sf_dir, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("fact"), (F.col("l_linenumber") - 2 + F.col("l_partkey") % 3).alias("target"), F.when(F.col("l_returnflag") == "A", "causes").when(F.col("l_returnflag") == "N", "prevents").otherwise("mentions").alias("relation_type"), (F.col("l_tax") * 20).alias("strength"))
    return links.causal_links(rows).select("batch", "a", F.col("b").cast("long").alias("b"), "type", F.round("weight", 6).alias("weight"))


CAUSAL = """
SELECT l_orderkey AS batch, l_linenumber AS a, l_linenumber - 2 + l_partkey % 3 AS b, CASE l_returnflag WHEN 'A' THEN 'causes' ELSE 'prevents' END AS type,
    round(least(1.0, greatest(0.0, l_tax * 20)), 6) AS weight
FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linenumber - 2 + l_partkey % 3 >= 0 AND l_linenumber - 2 + l_partkey % 3 < l_linenumber"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth event is a query, and the two events before it are its seeds."""
    q = table(spark, sf_dir, "events").filter(F.col("event_id") % EVERY == 0).select(F.col("event_id").alias("query_id"))
    return q.select("query_id", F.explode(F.array(F.struct(F.col("query_id").alias("node"), F.lit(1.0).alias("score")), F.struct((F.col("query_id") + 1).alias("node"), F.lit(0.5).alias("score")))).alias("s")).select("query_id", "s.node", "s.score")


_SEEDS = f"""seeds AS (SELECT event_id AS query_id, event_id AS node, 1.0::DOUBLE AS score FROM events WHERE event_id % {EVERY} = 0
    UNION ALL SELECT event_id, event_id + 1, 0.5 FROM events WHERE event_id % {EVERY} = 0)"""
_TWO_HOPS = """shares AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM
    (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM links WHERE type = 'temporal' AND weight >= 0.1) WHERE r <= 20),
f0 AS (SELECT query_id, node, score / sum(score) OVER (PARTITION BY query_id) AS mass FROM seeds),
f1 AS (SELECT query_id, dst AS node, sum(mass * 0.85 * share) AS mass FROM f0 JOIN shares ON src = node WHERE mass >= 1e-6 GROUP BY ALL),
f2 AS (SELECT query_id, dst AS node, sum(mass * 0.85 * share) AS mass FROM f1 JOIN shares ON src = node WHERE mass >= 1e-6 GROUP BY ALL),
pushed AS (SELECT query_id, node, mass * 0.15 AS mass FROM f0 WHERE mass >= 1e-6 UNION ALL SELECT query_id, node, mass * 0.15 FROM f1 WHERE mass >= 1e-6 UNION ALL SELECT query_id, node, mass FROM f2 WHERE mass >= 1e-6)"""


def push_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward push over two temporal hops from every query's seeds."""
    found = graph.push(_seeds(spark, sf_dir), event_links(spark, sf_dir), ("temporal", "temporal"))
    return found.select("query_id", "node", F.round("mass", 9).alias("mass"))


PUSH = f"WITH {EVENT_LINKS}, {_SEEDS}, {_TWO_HOPS} SELECT query_id, node, round(sum(mass), 9) AS mass FROM pushed GROUP BY ALL"


def pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default patterns from each query's seeds, fused by reciprocal rank."""
    s = _seeds(spark, sf_dir)
    return graph.pattern_search(s, s, event_links(spark, sf_dir)).select("query_id", "node", F.round("score", 9).alias("score"), "rank")


def pattern_ctes(starts: tuple[str, str] = ("f0", "f0")) -> str:
    """Each default pattern walked by itself, from the masses ``starts`` (of both kinds of seeds), and ``fused``."""
    runs = [(start, p) for start, kind in zip(starts, PATTERNS["default"], strict=True) for p in kind]
    steps, lists = [], []
    for n, (start, (one, two)) in enumerate(runs):
        hop = "SELECT query_id, dst AS node, sum(mass * 0.85 * share) AS mass FROM {0} JOIN shares ON src = node AND type = '{1}' WHERE mass >= 1e-6 GROUP BY ALL"
        steps += [f"p{n}a AS ({hop.format(start, one)})", f"p{n}b AS ({hop.format(f'p{n}a', two)})"]
        kept = " UNION ALL ".join([f"SELECT query_id, node, mass * 0.15 AS mass FROM {t} WHERE mass >= 1e-6" for t in (start, f"p{n}a")] + [f"SELECT query_id, node, mass FROM p{n}b WHERE mass >= 1e-6"])
        lists.append(f"SELECT query_id, {n} AS pattern, node, sum(mass) AS mass FROM ({kept}) GROUP BY ALL")
    return f"""shares AS (SELECT src, dst, type, weight / sum(weight) OVER (PARTITION BY src, type) AS share FROM
    (SELECT *, row_number() OVER (PARTITION BY src, type ORDER BY weight DESC, dst) AS r FROM links WHERE weight >= 0.1) WHERE r <= 20),
{", ".join(steps)},
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, pattern ORDER BY round(mass, 12) DESC, node) AS place FROM ({" UNION ALL ".join(lists)})),
walked AS (SELECT query_id, node, sum(1.0::DOUBLE / (60 + place)) AS score FROM placed GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, node) AS rank FROM walked)"""


def _pattern_sql() -> str:
    return f"""
WITH {EVENT_LINKS}, {_SEEDS},
f0 AS (SELECT query_id, node, score / sum(score) OVER (PARTITION BY query_id) AS mass FROM seeds),
{pattern_ctes()}
SELECT query_id, node, round(score, 9) AS score, rank::INTEGER AS rank FROM ordered WHERE rank <= 50"""


def _spread_sql(hops: int = 3) -> str:
    """Levels of a breadth-first walk; a node counts in the first level that reaches it."""
    levels, before = ["l0 AS (SELECT query_id, node, max(score) AS activation, 0 AS depth FROM seeds GROUP BY ALL)"], "SELECT * FROM l0"
    for d in range(1, hops + 1):
        levels.append(f"""l{d} AS (SELECT query_id, dst AS node, max(a) AS activation, {d} AS depth FROM
    (SELECT query_id, dst, least(1.0, activation * weight * 0.8) AS a FROM l{d - 1} JOIN links ON src = node) WHERE a >= 0.1 AND (query_id, dst) NOT IN (SELECT (query_id, node) FROM ({before})) GROUP BY ALL)""")
        before += f" UNION ALL SELECT * FROM l{d}"
    return f"""
WITH {EVENT_LINKS}, {_SEEDS}, {", ".join(levels)}
SELECT query_id, node, round(activation, 9) AS activation, depth, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 12) DESC, node) AS rank FROM ({before})) WHERE rank <= 100"""


def _temporal_spread_sql(hops: int = 2) -> str:
    """Levels of a walk that follows a query's 200 strongest links a hop; only seeds have a date of their own."""
    levels, before = ["l0 AS (SELECT query_id, node, max(score) AS score, 0 AS depth FROM seeds GROUP BY ALL)"], "SELECT * FROM l0"
    for d in range(1, hops + 1):
        levels.append(f"""l{d} AS (SELECT query_id, node, max(least(1.0, passed)) AS score, {d} AS depth FROM (
    SELECT query_id, dst AS node, score * weight * 0.7 AS passed, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, dst, score * weight * 0.7 DESC) AS r
    FROM l{d - 1} JOIN links ON src = node WHERE score > 0.2 AND (query_id, dst) NOT IN (SELECT (query_id, node) FROM ({before}))) WHERE r <= 200 GROUP BY ALL)""")
        before += f" UNION ALL SELECT * FROM l{d}"
    return f"""
WITH {EVENT_LINKS}, {_SEEDS}, {", ".join(levels)}
SELECT query_id, node, round(score, 9) AS score, depth, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, node) AS rank FROM ({before})) WHERE rank <= 100"""


def within_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of every query's seeds over links of 0.5 or more."""
    found = graph.within_depth(_seeds(spark, sf_dir), event_links(spark, sf_dir), 2, 0.5)
    return found.select("query_id", "node", "depth", F.round("activation", 6).alias("activation"))


WITHIN_DEPTH = f"""
WITH RECURSIVE {EVENT_LINKS}, {_SEEDS},
e AS (SELECT DISTINCT src, dst FROM links WHERE weight >= 0.5),
walk AS (SELECT DISTINCT query_id, node, 0 AS depth FROM seeds UNION SELECT query_id, dst, depth + 1 FROM walk JOIN e ON src = node WHERE depth < 2)
SELECT query_id, node, min(depth) AS depth, round(1 / (1 + min(depth)), 6) AS activation FROM walk GROUP BY query_id, node"""


def engram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph retriever in analogy mode, which prefers weak links."""
    found = graph.engram_search(_seeds(spark, sf_dir), event_links(spark, sf_dir), "analogy", weak=0.35)
    return found.select("query_id", "node", "depth", F.round("activation", 6).alias("activation"))


ENGRAM_SEARCH = f"""
WITH RECURSIVE {EVENT_LINKS}, {_SEEDS},
e AS (SELECT DISTINCT src, dst FROM links),
weak AS (SELECT DISTINCT dst FROM links WHERE weight < 0.35),
walk AS (SELECT DISTINCT query_id, node, 0 AS depth FROM seeds UNION SELECT query_id, dst, depth + 1 FROM walk JOIN e ON src = node WHERE depth < 2),
m AS (SELECT query_id, node, min(depth) AS depth FROM walk GROUP BY query_id, node)
SELECT query_id, node, depth, round(least(1.0, 1 / (1 + depth) * CASE WHEN node IN (SELECT dst FROM weak) THEN 1.5 ELSE 1 END), 6)::DOUBLE AS activation FROM m"""


def bfs_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreading activation over three hops, the hundred strongest nodes of each query."""
    return graph.spread(_seeds(spark, sf_dir), event_links(spark, sf_dir)).select("query_id", "node", F.round("activation", 9).alias("activation"), "depth", "rank")


def temporal_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread from each query's seeds in time, over two hops."""
    seeds = _seeds(spark, sf_dir)
    near = seeds.select("query_id", "node", F.lit(0.8).alias("proximity"))
    return graph.temporal_spread(seeds, event_links(spark, sf_dir), near, hops=2).select("query_id", "node", F.round("score", 9).alias("score"), "depth", "rank")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from and to every hundredth event, counted by type and direction."""
    nodes = table(spark, sf_dir, "events").filter(F.col("event_id") % EVERY == 0).select(F.col("event_id").alias("node"))
    return graph.relationships(event_links(spark, sf_dir), nodes).groupBy("node", "type", "direction").agg(F.count(F.lit(1)).alias("n"))


RELATIONSHIPS = f"""
WITH {EVENT_LINKS}
SELECT src AS node, type, 'out' AS direction, count(*) AS n FROM links WHERE src % {EVERY} = 0 GROUP BY ALL
UNION ALL SELECT dst, type, 'in', count(*) FROM links WHERE dst % {EVERY} = 0 GROUP BY ALL"""


def hybrid_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas and engrams of each customer's nation in one list, by the mode's weights."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("score"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("score"))
    return graph.hybrid(s, c, SCHEMA_WEIGHT["precision"], ENGRAM_WEIGHT["precision"], 10).select("query_id", "kind", "id", F.round("value", 6).alias("value"), "rank")


HYBRID_KINDS = """
WITH b AS (SELECT s_nationkey AS query_id, 'schema' AS kind, s_suppkey AS id, s_acctbal / 10000 * 1.2 AS value FROM supplier
    UNION ALL SELECT c_nationkey, 'engram', c_custkey, c_acctbal / 10000 * 0.9 FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(value, 12) DESC, kind, id) AS rank FROM b)
SELECT query_id, kind, id, round(value, 6) AS value, rank::INTEGER AS rank FROM r WHERE rank <= 10"""


def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the event graph with colour, and the number of drawn edges at each."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    strength = e.filter(F.col("id") % 7 != 0).select("id", (F.pmod(F.col("id") * 29, F.lit(101)) / 100).alias("strength"))
    nodes, edges = graph.view(e, event_links(spark, sf_dir), strength)
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(ends, "id", "left").select("id", "strength", "colour", F.coalesce("edges", F.lit(0)).alias("edges"))


GRAPH_VIEW = f"""
WITH {EVENT_LINKS},
d AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, type FROM links),
n AS (SELECT id, count(*) AS edges FROM (SELECT a AS id FROM d UNION ALL SELECT b FROM d) GROUP BY id),
e AS (SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN (event_id * 29 % 101) / 100.0::DOUBLE ELSE 0.5 END AS strength FROM events)
SELECT id, strength, CASE WHEN strength < 0.3 THEN 'weak' WHEN strength <= 0.7 THEN 'medium' ELSE 'strong' END AS colour, coalesce(edges, 0) AS edges FROM e LEFT JOIN n USING (id)"""


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as mentions, resolved among the parts of the same brand."""
    p = table(spark, sf_dir, "part")
    day = F.timestamp_seconds(F.lit(1_700_000_000))
    known = p.select(F.col("p_brand").alias("bank"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), day.alias("last_seen"))
    said = p.select(F.col("p_brand").alias("bank"), F.col("p_partkey").alias("mention_id"), F.upper("p_name").alias("name"), F.array().cast("array<string>").alias("nearby"), day.alias("seen"))
    company = known.select("entity_id", F.array().cast("array<string>").alias("names"))
    found = entities.resolve(said, known, company)
    return found.select("mention_id", "entity_id", F.round("score", 6).alias("score"))


def ambiguous_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that several parts of a brand have."""
    return entities.ambiguous(table(spark, sf_dir, "part"), "p_brand", "p_name")


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of customers by market segment, with the greatest key as the latest."""
    return entities.mention_counts(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("c_nationkey", "key", "mention_count", "last_seen", "name")


QUERIES = {f.__name__: f for f in (temporal_links, temporal_pairs, proximity_links, entity_links, entity_cooccurrence, co_activation, session_pairs, event_sessions, links_distinct_pairs, causal_links, push_two_hops, pattern_search, within_depth, engram_search, bfs_activation, temporal_spread, relationships, hybrid_kinds, graph_view, entity_resolution, ambiguous_entities, mention_counts)}
ORACLE_SQL = {
    "temporal_links": TEMPORAL,
    "temporal_pairs": TEMPORAL_PAIRS,
    "proximity_links": PROXIMITY,
    "entity_links": ENTITY_LINKS,
    "entity_cooccurrence": CO_OCCURRENCE,
    "co_activation": CO_ACTIVATION,
    "session_pairs": SESSION_PAIRS,
    "event_sessions": EVENT_SESSIONS,
    "links_distinct_pairs": DISTINCT_PAIRS,
    "causal_links": CAUSAL,
    "push_two_hops": PUSH,
    "pattern_search": _pattern_sql(),
    "bfs_activation": _spread_sql(),
    "temporal_spread": _temporal_spread_sql(),
    "within_depth": WITHIN_DEPTH,
    "engram_search": ENGRAM_SEARCH,
    "relationships": RELATIONSHIPS,
    "hybrid_kinds": HYBRID_KINDS,
    "graph_view": GRAPH_VIEW,
    "ambiguous_entities": "SELECT p_brand, lower(p_name) AS name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
    "mention_counts": "SELECT c_nationkey, lower(c_mktsegment) AS key, count(*) AS mention_count, max(c_custkey) AS last_seen, arg_max(c_mktsegment, c_custkey) AS name FROM customer GROUP BY 1, 2",
}
