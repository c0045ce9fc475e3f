"""Smaller steps as queries of their own: filters, unions, joins, properties and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import scoring, text, time
from mnemospark.operators import consolidation, lifecycle, links, ranking, retrieval
from mnemospark.plans.derived import ENGRAMS, EVERY, engrams, share
from mnemospark.sources.tables import table


def strength_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose engram is strong enough; those without one count as 0.5."""
    known = engrams(spark, sf_dir).filter(F.col("engram_id") % 5 != 0).select(F.col("engram_id").alias("event_id"), "strength")
    return retrieval.strength_filter(table(spark, sf_dir, "events").select("event_id", "user_id"), known, "event_id", 0.4).select("event_id", "user_id", F.coalesce("strength", F.lit(0.5)).alias("strength"))


STRENGTH_PREFILTER = f"""
WITH {ENGRAMS}, k AS (SELECT engram_id, strength FROM engrams WHERE engram_id % 5 <> 0)
SELECT event_id, user_id, coalesce(strength, 0.5) AS strength FROM events LEFT JOIN k ON engram_id = event_id WHERE coalesce(strength, 0.5) >= 0.4"""


def floor_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines above a floor of the discount; orders without one keep their returned lines."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("hit"))
    return retrieval.floor_with_fallback(l, ["l_orderkey"], "l_discount", 0.08, "hit").select("l_orderkey", "l_linenumber", "l_discount")


FLOOR = """
SELECT l_orderkey, l_linenumber, l_discount FROM (SELECT *, bool_or(l_discount >= 0.08) OVER (PARTITION BY l_orderkey) AS any_kept FROM lineitem)
WHERE l_discount >= 0.08 OR (NOT any_kept AND l_returnflag = 'R')"""


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, then customers of a nation by rest of their key: the first list's row stays."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("id"), F.col("s_suppkey").alias("row")).groupBy("id").agg(F.min("row").alias("row")).withColumn("origin", F.lit("supplier"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 80).alias("id"), F.col("c_custkey").alias("row")).groupBy("id").agg(F.min("row").alias("row")).withColumn("origin", F.lit("customer"))
    return ranking.keep_first([s, c], ["id"]).select("id", "row", "origin")


MERGED = """
WITH s AS (SELECT s_suppkey % 50 AS id, min(s_suppkey) AS "row", 'supplier' AS origin FROM supplier GROUP BY 1),
c AS (SELECT c_custkey % 80 AS id, min(c_custkey) AS "row", 'customer' AS origin FROM customer GROUP BY 1)
SELECT * FROM s UNION ALL SELECT * FROM c WHERE id NOT IN (SELECT id FROM s)"""


def outcome_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a user's and the assistant's turn that share a conversation and place, with the error between them."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2)).alias("pair"), "role", F.length("text").alias("n"))
    pairs = links.pair_outcomes(c, "pair", "role", "n", "user", "assistant")
    error = F.least(F.lit(1.0), F.abs(F.col("user") - F.col("assistant")) / F.greatest("user", "assistant", F.lit(1)))
    return pairs.select("pair", F.col("user").cast("long").alias("expected"), F.col("assistant").cast("long").alias("outcome"), F.round(error, 6).alias("error"), scoring.error_level(error).alias("level"))


OUTCOMES = """
WITH c AS (SELECT conv_id || '-' || (turn // 2) AS pair, role, length(text) AS n FROM conversations),
p AS (SELECT u.pair, u.n AS e, a.n AS o, least(1.0::DOUBLE, abs(u.n - a.n)::DOUBLE / greatest(u.n, a.n, 1)) AS error FROM c u JOIN c a ON u.pair = a.pair AND u.role = 'user' AND a.role = 'assistant')
SELECT pair, e AS expected, o AS outcome, round(error, 6) AS error, CASE WHEN error < 0.3 THEN 'low' WHEN error < 0.7 THEN 'medium' ELSE 'high' END AS level FROM p"""


def aggregated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's confidence from all events, less the issues among them."""
    e = table(spark, sf_dir, "events")
    facts = e.select("user_id", share(F.col("event_id"), 43).alias("confidence"))
    issues = e.filter(F.col("event_id") % 50 == 0).select("user_id", share(F.col("event_id"), 61).alias("relevance"))
    return lifecycle.aggregate_confidence(facts, issues, "user_id").withColumn("confidence", F.round("confidence", 6))


CONFIDENCE = """
WITH f AS (SELECT user_id, avg((event_id * 43 % 101) / 100) AS mean, coalesce(sum((event_id * 61 % 101) / 100) FILTER (event_id % 50 = 0 AND (event_id * 61 % 101) / 100 >= 0.3), 0) AS lost FROM events GROUP BY user_id)
SELECT user_id, round(greatest(0.0, least(1.0, mean * greatest(0.5, 1 - 0.15 * lost))), 6) AS confidence FROM f"""


def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of an answer key by language, without invalid answers."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("valid", F.col("doc_id") % 9 != 0)
    right = F.when(F.col("valid"), (F.col("quality") == 1).cast("int"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(right).alias("n_valid"), F.round(F.avg(right), 6).alias("accuracy"))


ACCURACY = "SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 9 <> 0) AS n_valid, round(avg((quality = 1)::INTEGER) FILTER (doc_id % 9 <> 0), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = engrams(spark, sf_dir)
    return tuple(consolidation.properties(e.filter(F.col("engram_id") % 2 == k).withColumn("all", F.lit(1)), ["all"], "tags").drop("all") for k in (0, 1))


def merged_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of even and odd engrams in one."""
    m = consolidation.merge_properties(*_halves(spark, sf_dir))
    return m.select("key", "type", "count", F.round("mean", 4).alias("mean"), "min", "max", "value")


def property_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose summary differs between even and odd engrams."""
    return consolidation.differences(*_halves(spark, sf_dir))


def _half(n: int) -> str:
    return f"""SELECT CASE WHEN contains(tag, ':') THEN split_part(tag, ':', 1) ELSE '_keywords' END AS key, CASE WHEN contains(tag, ':') THEN trim(split_part(tag, ':', 2)) ELSE tag END AS value
    FROM (SELECT unnest(tags) AS tag FROM engrams WHERE engram_id % 2 = {n})"""


_SUMMARY = f"""a AS (SELECT 0 AS h, * FROM ({_half(0)}) UNION ALL SELECT 1, * FROM ({_half(1)})),
s AS (SELECT h, key, count(*) AS n, bool_and(try_cast(value AS DOUBLE) IS NOT NULL) AS num, round_even(avg(try_cast(value AS DOUBLE)), 0) AS mean, min(try_cast(value AS DOUBLE)) AS lo, max(try_cast(value AS DOUBLE)) AS hi FROM a GROUP BY ALL),
v AS (SELECT h, key, value, n, row_number() OVER (PARTITION BY h, key ORDER BY n DESC, value) AS r FROM (SELECT h, key, value, count(*) AS n FROM a GROUP BY ALL)),
e AS (SELECT engram_id % 2 AS h, count(*) AS evidence FROM engrams GROUP BY 1),
p AS (SELECT s.*, v.value, v.n / evidence AS confidence FROM s JOIN v ON s.h = v.h AND s.key = v.key AND r = 1 JOIN e ON e.h = s.h)"""
MERGED_PROPERTIES = f"""
WITH {ENGRAMS}, {_SUMMARY}
SELECT x.key, CASE WHEN x.num THEN 'numeric' ELSE 'categorical' END AS type, x.n + y.n AS count, CASE WHEN x.num THEN round((x.mean * x.n + y.mean * y.n) / (x.n + y.n), 4) END AS mean,
    CASE WHEN x.num THEN least(x.lo, y.lo) END AS min, CASE WHEN x.num THEN greatest(x.hi, y.hi) END AS max, CASE WHEN x.num THEN NULL WHEN x.confidence >= y.confidence THEN x.value ELSE y.value END AS value
FROM p x JOIN p y ON x.key = y.key AND x.h = 0 AND y.h = 1"""

PROPERTY_DIFFERENCES = f"""
WITH {ENGRAMS}, {_SUMMARY}, w AS (SELECT h, key, CASE WHEN num THEN mean::VARCHAR ELSE value END AS v FROM p)
SELECT coalesce(x.key, y.key) AS key, x.v AS left, y.v AS right FROM (FROM w WHERE h = 0) x FULL JOIN (FROM w WHERE h = 1) y ON x.key = y.key WHERE x.v IS DISTINCT FROM y.v"""


def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, frequency, anchors and nearness of orders to the first of their year."""
    o = table(spark, sf_dir, "orders")
    first = F.date_trunc("year", "o_orderdate")
    days = F.datediff("o_orderdate", first)
    return o.select("o_orderkey", F.round(scoring.recency(days, F.lit(0.5)), 6).alias("recency"), F.round(scoring.frequency(days), 6).alias("frequency"), F.round(scoring.day_proximity(scoring.anchor(first, first), scoring.anchor(F.col("o_orderdate"), F.col("o_orderdate"))), 6).alias("proximity"))


RECENCY = """
WITH o AS (SELECT o_orderkey, date_diff('day', date_trunc('year', o_orderdate)::DATE, o_orderdate::DATE) AS d, floor((epoch(o_orderdate) - epoch(date_trunc('year', o_orderdate)::TIMESTAMP)) / 86400) AS w FROM orders)
SELECT o_orderkey, round(1 / (1 + ln(1 + d / (365 * 1.5::DOUBLE))), 6) AS recency, round(CASE WHEN d <= 0 THEN 1.0 ELSE 1 + least(log10(d + 1), 1.0) END, 6) AS frequency, round(1 / (1 + ln(1 + w / 30)), 6) AS proximity FROM o"""


def mode_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode after each event's error, unless it was set."""
    from mnemospark.streaming.sessions import mode_shift as shift

    e = table(spark, sf_dir, "events").select("event_id", F.lit("precision").alias("mode"), (F.col("event_id") % 6 == 0).alias("explicit"), share(F.col("event_id"), 23).alias("error"))
    return shift(e, "mode", "explicit", "error").select("event_id", "next_mode")


def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day that a fact's text means, told at each event's time."""
    said = ["seen yesterday", "done today", "it was 3 days ago", "due tomorrow", "from last week", "no day"]
    t = F.element_at(F.array(*map(F.lit, said)), F.pmod(F.col("event_id"), F.lit(len(said))).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(time.relative_date(t, F.col("ts")).cast("date").cast("string"), F.lit("")).alias("day"))


RELATIVE = """SELECT event_id, coalesce((CASE event_id % 6 WHEN 0 THEN ts::DATE - 1 WHEN 1 THEN ts::DATE WHEN 2 THEN ts::DATE - 3 WHEN 3 THEN ts::DATE + 1 WHEN 4 THEN ts::DATE - 7 END)::VARCHAR, '') AS day FROM events"""


def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engrams that are opinions and purchases, by key and value of their activity tag."""
    rows = retrieval.tag_filter(engrams(spark, sf_dir), "tags", ["opinion"])
    tag = F.element_at("tags", 2)
    return rows.select("engram_id", text.tag_key(tag).alias("key"), text.tag_value(tag).alias("value"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the ids that the hundredth orders name."""
    ids = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % EVERY == 0).select(F.col("o_custkey").alias("c_custkey"))
    return retrieval.point_lookup(table(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three active engrams of each user's declared list."""
    e = engrams(spark, sf_dir)
    lists = e.groupBy("bank_id").agg(F.sort_array(F.collect_list("engram_id"), asc=False).alias("ids"))
    found = lifecycle.evidence(lists.withColumn("schema_id", F.col("bank_id")), "schema_id", "ids", e.select("engram_id", "bank_id", "status"), "engram_id", 3)
    return found.select("schema_id", "engram_id", "rank")


EVIDENCE = f"""WITH {ENGRAMS}, r AS (SELECT bank_id AS schema_id, engram_id, row_number() OVER (PARTITION BY bank_id ORDER BY engram_id DESC) AS rank FROM engrams WHERE status = 'active')
SELECT schema_id, engram_id, rank::INTEGER AS rank FROM r WHERE rank <= 3"""


QUERIES = {f.__name__: f for f in (strength_prefilter, floor_with_fallback, merged_candidates, outcome_pairs, aggregated_confidence, accuracy_by_category, merged_properties, property_differences, recency_weights, mode_shift, relative_dates, tag_lookup, point_lookup, evidence)}
ORACLE_SQL = {
    "strength_prefilter": STRENGTH_PREFILTER,
    "floor_with_fallback": FLOOR,
    "merged_candidates": MERGED,
    "outcome_pairs": OUTCOMES,
    "aggregated_confidence": CONFIDENCE,
    "accuracy_by_category": ACCURACY,
    "merged_properties": MERGED_PROPERTIES,
    "property_differences": PROPERTY_DIFFERENCES,
    "recency_weights": RECENCY,
    "mode_shift": "SELECT event_id, CASE WHEN event_id % 6 <> 0 AND (event_id * 23 % 101) / 100 >= 0.3 THEN 'validation' ELSE 'precision' END AS next_mode FROM events",
    "relative_dates": RELATIVE,
    "tag_lookup": "SELECT event_id AS engram_id, 'activity' AS key, event_type AS value FROM events WHERE event_id % 3 = 2",
    "point_lookup": f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % {EVERY} = 0)",
    "evidence": EVIDENCE,
}
