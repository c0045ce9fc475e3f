"""Tables of the memory model made of the driver's tables, as DataFrames and as DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import scoring
from mnemospark.operators.ranking import members
from mnemospark.session import checkpointed
from mnemospark.sources.tables import table

#: Sessions that every bank has had.
SESSIONS = 50
#: The queries of a search: the rows whose id is divisible by this.
EVERY = 100


def share(id_: Column, factor: int) -> Column:
    """A number from 0 to 1 that an id stands for."""
    return F.pmod(id_ * factor, F.lit(101)) / 100


def engrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored item an event, with scores, counters, tags and a layer."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.element_at(F.array(F.lit("fact"), F.lit("experience"), F.lit("opinion")), F.pmod(i, F.lit(3)).cast("int") + 1)
    return e.select(
        i.alias("engram_id"),
        F.col("user_id").alias("bank_id"),
        F.col("ts"),
        F.when(i % 20 == 0, None).otherwise(share(i, 37)).alias("novelty"),
        share(i, 53).alias("surprise"),
        share(i, 71).alias("task_relevance"),
        share(i, 89).alias("emotional_valence"),
        share(i, 29).alias("strength"),
        share(i, 17).alias("overall"),
        (i % 17).alias("access_count"),
        (i % 40).alias("created_session"),
        F.lit(SESSIONS).cast("long").alias("session_count"),
        F.when(i % 4 == 0, None).when(i % 4 == 1, "working").otherwise("buffer").alias("layer"),
        F.when(i % 11 == 0, "archived").otherwise("active").alias("status"),
        F.array(kind, F.concat(F.lit("activity:"), F.col("event_type")), F.concat(F.lit("k: "), F.regexp_extract("props", r'"k":\s*(-?\d+)', 1))).alias("tags"),
        F.col("value"),
    )


ENGRAMS = f"""engrams AS (
    SELECT event_id AS engram_id, user_id AS bank_id, ts,
        CASE WHEN event_id % 20 = 0 THEN NULL ELSE (event_id * 37 % 101) / 100.0::DOUBLE END AS novelty,
        (event_id * 53 % 101) / 100.0::DOUBLE AS surprise, (event_id * 71 % 101) / 100.0::DOUBLE AS task_relevance,
        (event_id * 89 % 101) / 100.0::DOUBLE AS emotional_valence, (event_id * 29 % 101) / 100.0::DOUBLE AS strength,
        (event_id * 17 % 101) / 100.0::DOUBLE AS overall, event_id % 17 AS access_count, event_id % 40 AS created_session,
        {SESSIONS}::BIGINT AS session_count,
        CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'working' ELSE 'buffer' END AS layer,
        CASE WHEN event_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status,
        [['fact', 'experience', 'opinion'][event_id % 3 + 1], 'activity:' || event_type,
            'k: ' || regexp_extract(props, '"k":\\s*(-?\\d+)', 1)] AS tags,
        value
    FROM events)"""

#: The lifecycle columns of ``engrams``, with ``mode_rate`` in place of the mode's base rate.
RATED = """rated AS (
    SELECT *, CASE WHEN n < 1 THEN 1.5 WHEN n < 100 THEN least(1.5, ln(1001) / ln(1 + n::DOUBLE)) ELSE ln(1001) / ln(1 + n::DOUBLE) END AS factor
    FROM (SELECT *, count(*) OVER (PARTITION BY bank_id) AS n FROM {source})),
lived AS (
    SELECT *, greatest(0, session_count - created_session) AS alive,
        greatest(0.001, {rate} * (1 + 0.5 * task_relevance) / (1 + 0.5 * (coalesce(novelty, 0.5) + surprise + emotional_valence) / 3) * factor) AS rate
    FROM rated),
composed AS (
    SELECT *, CASE WHEN alive <= 0 OR rate <= 0 THEN 1.0 WHEN access_count <= 0 THEN 0.0 ELSE ln(1 + access_count) / ln(1 + alive * rate) END AS decay
    FROM lived),
scored AS (SELECT *, greatest(0.0, least(10.0, overall * decay)) AS composite FROM composed)"""


def orders_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a time range: an order from its date to its last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ended"))
    return table(spark, sf_dir, "orders").join(last, "o_orderkey", "left").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("bank_id"), F.col("o_orderdate").alias("started"), "ended", F.lit(None).cast("timestamp").alias("mentioned"))


ORDER_RANGES = """ranges AS (
    SELECT o_orderkey AS unit_id, o_custkey AS bank_id, o_orderdate AS started, ended
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ended FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def event_links(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """A links table over events: near in time within a bank, and next event of the same type.

    With ``nodes``, a checkpointed frame of node, the links from these events:
    no link is longer than a day, so their banks' days beside them have all ends.
    """
    from mnemospark.operators.links import proximity_links, temporal_links

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    some = e
    if nodes is not None:
        some = checkpointed(members(e, nodes.select(F.col("node").alias("event_id")), ["event_id"]))
        day = F.floor(scoring.seconds(F.col("ts")) / 86400)
        days = checkpointed(some.select("user_id", F.explode(F.array(day - 1, day, day + 1)).alias("day")).distinct())
        e = checkpointed(members(e.withColumn("day", day), days, ["user_id", "day"]).drop("day"))
    t = temporal_links(some, e, "user_id", "event_id", "ts").select("a", "b", "type", "weight")
    p = proximity_links(e, "user_id", "event_id", "ts", first=some).select("a", "b", F.lit("semantic").alias("type"), "weight")
    return t.unionByName(p).select(F.col("a").alias("src"), F.col("b").alias("dst"), "type", "weight")


EVENT_LINKS = """near AS (
    SELECT x.user_id AS bank, x.event_id AS a, y.event_id AS b, epoch(y.ts) AS u, abs(epoch(x.ts) - epoch(y.ts)) AS gap
    FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id <> y.event_id AND abs(epoch(x.ts) - epoch(y.ts)) <= 86400),
temporal AS (
    SELECT a, b, 'temporal' AS type, greatest(0.3, 1 - gap / 86400) AS weight
    FROM (SELECT *, row_number() OVER (PARTITION BY bank, a ORDER BY u DESC, b) AS r FROM near) WHERE r <= 10),
close AS (SELECT DISTINCT a, b, 'semantic' AS type, 1 - gap / 1800 AS weight FROM near WHERE a < b AND gap < 1800),
links AS (SELECT a AS src, b AS dst, type, weight FROM temporal UNION ALL SELECT * FROM close)"""
