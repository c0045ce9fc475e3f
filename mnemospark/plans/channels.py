"""Recall over all four channels, with the reranker's floor and two banks, as one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import scoring, text
from mnemospark.functions.constants import AGENT_WEIGHT, MAX_RESULTS, MAX_TOKENS, RERANK_FLOOR, SCORE_WEIGHTS, SHARED_WEIGHT, STRENGTH_FLOOR
from mnemospark.functions.providers import OverlapReranker
from mnemospark.operators import graph, ranking, retrieval
from mnemospark.plans.derived import ENGRAMS, EVENT_LINKS, engrams, event_links
from mnemospark.plans.linking import pattern_ctes
from mnemospark.plans.search import _BOOST, _KEYWORDS, _MEAN, _MODE_TERMS, _RECENCY, _VECTORS, _terms, tags_sql
from mnemospark.session import checkpointed
from mnemospark.sources.tables import table

#: Results of a channel, seeds of the walk, and days to each side of a query's date.
MOST, STARTS, DAYS = 20, 5, 2


def lists(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    """The four channels' lists of query_id, id and rank, and the dated ones' nearness.

    A benchmark item is a query: its words, the vector of its id, and the time and
    the bank of the event of its id. A unit is an id: a document's text, a vector
    and an event. The walk over the links starts from what is alike and what is near in time.
    """
    e, b, events = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "events")
    q = e.join(b.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    alike = retrieval.vector_search(e, q, "vec_id", "embedding", MOST).select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("id"), "rank")
    words = retrieval.keyword_search(table(spark, sf_dir, "documents"), b, MOST).select("query_id", F.col("doc_id").alias("id"), "rank")
    asked = events.join(b.select("item_id"), F.col("item_id") == F.col("event_id")).select(F.col("item_id").alias("query_id"), F.col("user_id").alias("bank"), *((F.col("ts") + F.make_dt_interval(F.lit(d))).alias(n) for n, d in (("low", -DAYS), ("high", DAYS))))
    dated = events.select(F.col("event_id").alias("unit_id"), F.col("user_id").alias("bank"), F.col("ts").alias("s"), F.lit(None).cast("timestamp").alias("e"), F.lit(None).cast("timestamp").alias("m"))
    near = retrieval.temporal_entries(dated, asked, MOST, "unit_id", "s", "e", "m", bank="bank").select("query_id", F.col("unit_id").alias("id"), "proximity", "rank")
    alike, near = checkpointed(alike), checkpointed(near)
    start = lambda x: x.filter(F.col("rank") <= STARTS).select("query_id", F.col("id").alias("node"), (1 / F.col("rank")).alias("score"))
    walked = graph.pattern_search(start(alike), start(near), lambda nodes: event_links(spark, sf_dir, nodes), budget=MOST).select("query_id", F.col("node").alias("id"), "rank")
    return [alike, words, walked, near.select("query_id", "id", "rank")], near.select("query_id", "id", "proximity")


def recall_channels(spark: SparkSession, sf_dir: str, mode: str = "precision") -> DataFrame:
    """Four channels fused, reranked with a floor, scored by seven terms, two banks merged, within the token budget.

    Even ids are the agent's; odd ones and every third are the shared bank's.
    """
    found, near = lists(spark, sf_dir)
    fused = checkpointed(ranking.normalise(ranking.rrf(found, ["query_id"], "id"), ["query_id"], "rrf", "rrf_norm"))
    # Only what was found moves, not the tables.
    ids = checkpointed(fused.select("id").distinct())
    items = _terms(ranking.members(engrams(spark, sf_dir).withColumnRenamed("engram_id", "id"), ids, ["id"])).select("id", "strength", "recency", "strength_w", f"thalamus_{mode}", "tags")
    docs = ranking.members(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ids, ["id"])
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = fused.join(near, ["query_id", "id"], "left").join(items, "id", "left").join(docs, "id", "left").join(asked, "query_id")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).filter(F.coalesce("strength", F.lit(0.5)) >= STRENGTH_FLOOR[mode])
    rows = rows.withColumns({"rerank": scoring.sigmoid(OverlapReranker().column(F.col("query"), F.col("text"))), "hits": (F.col("source") == 1).cast("int"), "tokens": F.ceil(F.length("text") / 4)})
    rows = retrieval.floor_with_fallback(rows, ["query_id"], "rerank", RERANK_FLOOR[mode], "hits")
    overlap = text.jaccard(text.query_tags(F.col("query")), F.coalesce("tags", F.array().cast("array<string>")))
    score = scoring.combined(mode, rerank=F.col("rerank"), rrf=F.col("rrf_norm"), temporal=F.coalesce("proximity", F.lit(0.5)), recency=F.coalesce("recency", F.lit(0.5)), strength=F.coalesce("strength_w", scoring.strength_weight(F.lit(0.5))), thalamus=F.coalesce(f"thalamus_{mode}", F.lit(0.5)), tags=overlap)
    rows = checkpointed(rows.select("query_id", "id", "source", "tokens", score.alias("score")))
    agent, shared = rows.filter("id % 2 = 0"), rows.filter("id % 2 <> 0 or id % 3 = 0")
    both = ranking.merge_banks(agent, shared, mode, ["query_id"], "id", "score", F.col("id") % 5 == 0).withColumn("score", F.round("merged", 6))
    order = [F.desc("score"), F.col("id")]
    kept = ranking.token_budget(both.filter(F.col("tokens") <= MAX_TOKENS[mode]), ["query_id"], order, "tokens", MAX_TOKENS[mode])
    return ranking.top_per(kept, ["query_id"], order, MAX_RESULTS[mode]).select("query_id", "id", "source", "tier", "score", F.col("running_tokens").cast("long").alias("running_tokens"), "rank")


def _sql(mode: str = "precision") -> str:
    w = SCORE_WEIGHTS[mode]
    words = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''))"
    return f"""
WITH {ENGRAMS}, {EVENT_LINKS}, {_VECTORS}, {_KEYWORDS},
sr AS (SELECT q.vec_id AS query_id, i.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, i.e), 9) DESC, i.vec_id) AS rank
    FROM v q JOIN v i ON q.vec_id <> i.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
asked AS (SELECT item_id AS query_id, user_id AS bank, epoch(ts) AS moment FROM benchmark JOIN events ON event_id = item_id),
tr AS (SELECT query_id, event_id AS id, 1 - least(abs(epoch(ts) - moment) / ({DAYS} * 86400), 1) AS proximity, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, event_id) AS rank
    FROM asked JOIN events ON user_id = bank AND abs(epoch(ts) - moment) <= {DAYS} * 86400),
f0 AS (SELECT query_id, id AS node, (1.0::DOUBLE / rank) / sum(1.0::DOUBLE / rank) OVER (PARTITION BY query_id) AS mass FROM sr WHERE rank <= {STARTS}),
g0 AS (SELECT query_id, id AS node, (1.0::DOUBLE / rank) / sum(1.0::DOUBLE / rank) OVER (PARTITION BY query_id) AS mass FROM tr WHERE rank <= {STARTS}),
{pattern_ctes(("f0", "g0"))},
ch AS (SELECT query_id, id, rank, 0 AS list FROM sr WHERE rank <= {MOST} UNION ALL SELECT query_id, doc_id, rank, 1 FROM kr WHERE rank <= {MOST}
    UNION ALL SELECT query_id, node, rank, 2 FROM ordered WHERE rank <= {MOST} UNION ALL SELECT query_id, id, rank, 3 FROM tr WHERE rank <= {MOST}),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list) AS source FROM ch GROUP BY ALL),
normal AS (SELECT *, CASE WHEN max(rrf) OVER u > min(rrf) OVER u THEN (rrf - min(rrf) OVER u) / (max(rrf) OVER u - min(rrf) OVER u) ELSE 0.5 END AS rrf_norm FROM fused WINDOW u AS (PARTITION BY query_id)),
j AS (SELECT n.query_id, n.id, n.source, n.rrf_norm, t.proximity, g.*, coalesce(d.text, '') AS body, b.text AS query, {tags_sql("b.text")} AS wanted
    FROM normal n JOIN benchmark b ON b.item_id = n.query_id LEFT JOIN (SELECT * FROM tr WHERE rank <= {MOST}) t ON t.query_id = n.query_id AND t.id = n.id
    LEFT JOIN engrams g ON g.engram_id = n.id LEFT JOIN documents d ON d.doc_id = n.id WHERE coalesce(g.strength, 0.5) >= {STRENGTH_FLOOR[mode]}),
o AS (SELECT *, {words.format("query")} AS qw, {words.format("body")} AS dw, ceil(length(body) / 4)::BIGINT AS tokens FROM j),
r AS (SELECT *, 1 / (1 + exp(-CASE WHEN len(qw) = 0 THEN -3.0::DOUBLE ELSE 6.0::DOUBLE * len(list_intersect(qw, dw)) / len(qw) - 3 END)) AS rerank FROM o),
kept AS (SELECT *, max(rerank) OVER (PARTITION BY query_id) >= {RERANK_FLOOR[mode]} AS above FROM r QUALIFY rerank >= {RERANK_FLOOR[mode]} OR (NOT above AND source = 1)),
s AS (SELECT query_id, id, source, tokens, {w[0]} * rerank + {w[1]} * rrf_norm + {w[2]} * coalesce(proximity, 0.5)
    + {w[3]} * CASE WHEN engram_id IS NULL THEN 0.5 ELSE {_RECENCY} END + {w[4]} * (ln(1 + coalesce(strength, 0.5)) / ln(2))
    + {w[5]} * CASE WHEN engram_id IS NULL THEN 0.5 ELSE {_MODE_TERMS.format(boosted=_BOOST[mode], mean=_MEAN)} END
    + {w[6]} * CASE WHEN len(coalesce(tags, [])) + len(wanted) = 0 THEN 0.0 ELSE len(list_intersect(coalesce(tags, []), wanted))::DOUBLE / (len(coalesce(tags, [])) + len(wanted) - len(list_intersect(coalesce(tags, []), wanted))) END AS score FROM kept),
m AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'agent' ELSE 'shared' END AS tier, score * CASE WHEN id % 2 = 0 THEN {AGENT_WEIGHT[mode]} ELSE {SHARED_WEIGHT[mode]} END AS x FROM s),
z AS (SELECT query_id, id, source, tier, tokens, round(CASE WHEN id % 5 = 0 THEN (x + 0.2) * 0.95 ELSE x END, 6) AS score FROM m WHERE tokens <= {MAX_TOKENS[mode]}),
y AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM y WHERE running <= {MAX_TOKENS[mode]})
SELECT query_id, id, source::INTEGER AS source, tier, score::DOUBLE AS score, running::BIGINT AS running_tokens, rank::INTEGER AS rank FROM k WHERE rank <= {MAX_RESULTS[mode]}"""


QUERIES = {"recall_channels": recall_channels}
ORACLE_SQL = {"recall_channels": _sql()}
