"""Search queries: channels, fusion, scores and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import scoring, text, time
from mnemospark.functions.constants import MODES, SCORE_WEIGHTS
from mnemospark.operators import ranking, retrieval, vector_index
from mnemospark.plans.derived import ENGRAMS, EVERY, ORDER_RANGES, engrams, orders_ranges
from mnemospark.sources.tables import table


def semantic_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    e = table(spark, sf_dir, "embeddings")
    found = retrieval.vector_search(e, e.filter(F.col("vec_id") % EVERY == 0), "vec_id", "embedding", k)
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), F.round("score", 6).alias("score"), "rank")


_VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
SEMANTIC = f"""
WITH {_VECTORS},
s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.e, i.e) AS score
    FROM v q JOIN v i ON q.vec_id <> i.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s WHERE score >= {{least}})
SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= {{k}}"""


def indexed_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The ten nearest vectors of every hundredth vector, through an inverted file of fifty rows a cell."""
    e = table(spark, sf_dir, "embeddings")
    found = vector_index.build(e, "vec_id", "embedding", cell=50).search(e.filter(F.col("vec_id") % EVERY == 0), "vec_id", "embedding", k)
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), F.round("score", 6).alias("score"), "rank")


def semantic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five links of every hundredth vector to vectors of similarity 0.2 or more, weights 0 to 1."""
    e = table(spark, sf_dir, "embeddings")
    found = retrieval.vector_search(e, e.filter(F.col("vec_id") % EVERY == 0), "vec_id", "embedding", 5, 0.2)
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), F.round(scoring.clamp(F.col("score")), 6).alias("score"), "rank")


def keyword_rank(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The ten documents of every benchmark item with most keyword hits."""
    found = retrieval.keyword_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_KEYWORDS = r"""dt AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS t FROM documents) WHERE t <> '' GROUP BY ALL),
qt AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS t FROM benchmark) WHERE t <> ''),
kw AS (SELECT item_id AS query_id, doc_id, sum(n) / 10 AS score FROM qt JOIN dt USING (t) GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kw)"""
KEYWORD = f"WITH {_KEYWORDS} SELECT query_id, doc_id, round(score::DOUBLE, 6) AS score, rank::INTEGER AS rank FROM kr WHERE rank <= 10"


def _channels(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Both channels for the benchmark items: the vector with an item's id stands for its embedding."""
    e, b = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    q = e.join(b.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    s = retrieval.vector_search(e, q, "vec_id", "embedding", k).select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("id"), "rank")
    w = retrieval.keyword_search(table(spark, sf_dir, "documents"), b, k).select("query_id", F.col("doc_id").alias("id"), "rank")
    return s, w


_CHANNELS = f"""{_VECTORS}, {_KEYWORDS},
sr AS (SELECT q.vec_id AS query_id, i.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, i.e), 9) DESC, i.vec_id) AS rank
    FROM v q JOIN v i ON q.vec_id <> i.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
ch AS (SELECT query_id, id, rank, 0 AS list FROM sr WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 1 FROM kr WHERE rank <= 20),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list) AS source FROM ch GROUP BY ALL),
normal AS (SELECT *, CASE WHEN max(rrf) OVER w > min(rrf) OVER w THEN (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) ELSE 0.5 END AS rrf_norm
    FROM fused WINDOW w AS (PARTITION BY query_id))"""


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and keyword lists fused by reciprocal rank, and the sum brought to 0..1 per query."""
    fused = ranking.rrf(list(_channels(spark, sf_dir, 20)), ["query_id"], "id")
    return ranking.normalise(fused, ["query_id"], "rrf", "rrf_norm").select("query_id", "id", F.round("rrf", 9).alias("rrf"), "source", F.round("rrf_norm", 5).alias("rrf_norm"))


HYBRID = f"WITH {_CHANNELS} SELECT query_id, id, round(rrf, 9) AS rrf, source::INTEGER AS source, round(rrf_norm, 5) AS rrf_norm FROM normal"


def _terms(rows: DataFrame) -> DataFrame:
    """The score terms of engrams, on their own columns."""
    dims = [F.col(d) for d in ("novelty", "surprise", "task_relevance", "emotional_valence")]
    days = F.col("access_count") * 10
    return rows.withColumns({"recency": scoring.recency(days, F.col("strength")), "strength_w": scoring.strength_weight(F.col("strength")), **{f"thalamus_{m}": scoring.thalamus_weight(m, *dims) for m in MODES}})


def recall(spark: SparkSession, sf_dir: str, mode: str = "exploration") -> DataFrame:
    """The whole chain: channels, fusion, engrams, seven-term score, token budget and result count of a mode."""
    from mnemospark.functions.constants import MAX_RESULTS, MAX_TOKENS, STRENGTH_FLOOR

    found = ranking.normalise(ranking.rrf(list(_channels(spark, sf_dir, 20)), ["query_id"], "id"), ["query_id"], "rrf", "rrf_norm")
    items = _terms(engrams(spark, sf_dir)).select(F.col("engram_id").alias("id"), "strength", "recency", "strength_w", f"thalamus_{mode}")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.ceil(F.length("text") / 4).alias("tokens"))
    rows = found.join(items, "id", "left").join(docs, "id", "left")
    strength = F.coalesce("strength", F.lit(0.5))
    rows = rows.filter(strength >= STRENGTH_FLOOR[mode]).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    score = scoring.combined(mode, rerank=F.col("rrf_norm"), rrf=F.col("rrf_norm"), temporal=F.lit(0.5), recency=F.coalesce("recency", F.lit(0.5)), strength=F.coalesce("strength_w", scoring.strength_weight(F.lit(0.5))), thalamus=F.coalesce(f"thalamus_{mode}", F.lit(0.5)), tags=F.lit(0.0))
    rows = rows.withColumn("score", F.round(score, 6)).filter(F.col("tokens") <= MAX_TOKENS[mode])
    order = [F.desc("score"), F.col("id")]
    kept = ranking.token_budget(rows, ["query_id"], order, "tokens", MAX_TOKENS[mode])
    return ranking.top_per(kept, ["query_id"], order, MAX_RESULTS[mode]).select("query_id", "id", "score", F.col("running_tokens").cast("long").alias("running_tokens"), "rank")


_MODE_TERMS = """CASE WHEN coalesce(novelty, surprise, task_relevance, emotional_valence) IS NULL THEN 0.5 WHEN {boosted} IS NULL THEN {mean} ELSE least(1.0, {boosted} * 1.5) END"""
_MEAN = "(coalesce(novelty, 0) + coalesce(surprise, 0) + coalesce(task_relevance, 0) + coalesce(emotional_valence, 0)) / 4"
_BOOST = {"precision": "task_relevance", "validation": "surprise", "analogy": "NULL::DOUBLE", "exploration": "novelty"}
_RECENCY = "1 / (1 + ln(1 + access_count * 10 / (365 * (1 + strength))))"


def _recall_sql(mode: str = "exploration", results: int = 10, tokens: int = 2048) -> str:
    w = SCORE_WEIGHTS[mode]
    return f"""
WITH {ENGRAMS}, {_CHANNELS},
j AS (SELECT n.query_id, n.id, n.rrf_norm, coalesce(ceil(length(d.text) / 4), 0)::BIGINT AS tokens,
    round({w[0]} * rrf_norm + {w[1]} * rrf_norm + {w[2]} * 0.5
        + {w[3]} * CASE WHEN g.engram_id IS NULL THEN 0.5 ELSE {_RECENCY} END
        + {w[4]} * (ln(1 + coalesce(g.strength, 0.5)) / ln(2))
        + {w[5]} * CASE WHEN g.engram_id IS NULL THEN 0.5 ELSE {_MODE_TERMS.format(boosted=_BOOST[mode], mean=_MEAN)} END, 6) AS score
    FROM normal n LEFT JOIN engrams g ON g.engram_id = n.id LEFT JOIN documents d ON d.doc_id = n.id),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM j WHERE tokens <= {tokens}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE running <= {tokens})
SELECT query_id, id, score, running::BIGINT AS running_tokens, rank::INTEGER AS rank FROM k WHERE rank <= {results}"""


def combined_score_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven-term score of every engram in every mode, one row each."""
    rows = _terms(engrams(spark, sf_dir))
    score = {m: scoring.combined(m, rerank=F.col("overall"), rrf=F.col("surprise"), temporal=F.lit(0.5), recency=F.col("recency"), strength=F.col("strength_w"), thalamus=F.col(f"thalamus_{m}"), tags=F.col("strength")) for m in MODES}
    return rows.select("engram_id", *(F.round(s, 6).alias(m) for m, s in score.items()))


def _combined_sql() -> str:
    parts = []
    for m in MODES:
        w = SCORE_WEIGHTS[m]
        parts.append(f"round({w[0]} * overall + {w[1]} * surprise + {w[2]} * 0.5 + {w[3]} * {_RECENCY} + {w[4]} * (ln(1 + strength) / ln(2)) + {w[5]} * {_MODE_TERMS.format(boosted=_BOOST[m], mean=_MEAN)} + {w[6]} * strength, 6) AS {m}")
    return f"WITH {ENGRAMS} SELECT engram_id, {', '.join(parts)} FROM engrams"


def token_budget(spark: SparkSession, sf_dir: str, most: int = 2048) -> DataFrame:
    """Per source, the leading documents by id whose running word count stays within 2048."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text.n_tokens(F.col("text")).cast("long").alias("tokens"))
    return ranking.token_budget(docs, ["source"], [F.col("doc_id")], "tokens", most)


TOKEN_BUDGET = r"""
WITH t AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS tokens FROM documents)
SELECT * FROM (SELECT doc_id, source, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM t)
WHERE running_tokens <= 2048"""


def access_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engrams of each bank whose overall score is near the bank's best."""
    return ranking.access_bump(engrams(spark, sf_dir).select("bank_id", "engram_id", "overall"), ["bank_id"], "overall")


ACCESS_BUMP = f"""WITH {ENGRAMS} SELECT bank_id, engram_id, overall FROM (SELECT *, max(overall) OVER (PARTITION BY bank_id) AS best FROM engrams)
WHERE overall >= greatest(0.4, 0.7 * best)"""


def bank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vectors as the agent's and every third as shared: both top tens of each query, merged by weights."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % EVERY == 0)

    def top(rows: DataFrame) -> DataFrame:
        return retrieval.vector_search(rows, q, "vec_id", "embedding", 10).select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), "score")

    both = ranking.merge_banks(top(e.filter(F.col("vec_id") % 2 == 0)), top(e.filter(F.col("vec_id") % 3 == 0)), "precision", ["query_id"], "item_id", "score", F.col("item_id") % 5 == 0)
    return both.select("query_id", "item_id", "tier", F.round("merged", 6).alias("merged"))


BANK_MERGE = f"""
WITH {_VECTORS},
s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.e, i.e) AS score FROM v q JOIN v i ON q.vec_id <> i.vec_id WHERE q.vec_id % {EVERY} = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS r FROM s WHERE item_id % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS r FROM s WHERE item_id % 3 = 0),
m AS (SELECT query_id, item_id, 'agent' AS tier, score * 0.7 AS w FROM a WHERE r <= 10
    UNION ALL SELECT query_id, item_id, 'shared', score * 0.3 FROM b WHERE r <= 10 AND NOT EXISTS (SELECT 1 FROM a WHERE a.r <= 10 AND a.query_id = b.query_id AND a.item_id = b.item_id))
SELECT query_id, item_id, tier, round(CASE WHEN item_id % 5 = 0 THEN (w + 0.2) * 0.95 ELSE w END, 6) AS merged FROM m"""


def tag_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every document against those of a benchmark item (doc_id mod 40)."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id"), text.query_tags(F.col("text")).alias("wanted"))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), text.query_tags(F.col("text")).alias("tags"))
    return d.join(b, "item_id").select("doc_id", "item_id", F.size("tags").cast("long").alias("n_tags"), F.round(text.jaccard(F.col("tags"), F.col("wanted")), 6).alias("jaccard"))


def tags_sql(column: str) -> str:
    """The tags of a text."""
    from mnemospark.functions.constants import STOPWORDS

    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '\\p{{L}}+')), lambda x: length(x) >= 3 AND x NOT IN ({stop}))"


def _tag_sql() -> str:
    tags = tags_sql("text")
    return f"""
WITH d AS (SELECT doc_id, doc_id % 40 AS item_id, {tags} AS tags FROM documents),
b AS (SELECT item_id, {tags} AS wanted FROM benchmark)
SELECT doc_id, item_id, len(tags) AS n_tags,
    round(CASE WHEN len(tags) + len(wanted) = 0 THEN 0.0 ELSE len(list_intersect(tags, wanted))::DOUBLE / (len(tags) + len(wanted) - len(list_intersect(tags, wanted))) END, 6) AS jaccard
FROM d JOIN b USING (item_id)"""


def temporal_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest orders that meet each of the windows, with their nearness to its middle."""
    windows = spark.sql("SELECT id AS query_id, make_timestamp(cast(1992 + id AS int), 3, 1, 0, 0, 0) AS low, make_timestamp(cast(1992 + id AS int), 3, 31, 0, 0, 0) AS high FROM range(0, 8)")
    found = retrieval.temporal_entries(orders_ranges(spark, sf_dir), windows, 10, "unit_id", "started", "ended", "mentioned")
    return found.select("query_id", "unit_id", F.round("proximity", 6).alias("proximity"), "rank")


TEMPORAL_ENTRY = f"""
WITH {ORDER_RANGES},
q AS (SELECT range AS query_id, make_timestamp(1992 + range, 3, 1, 0, 0, 0) AS low, make_timestamp(1992 + range, 3, 31, 0, 0, 0) AS high FROM range(0, 8)),
m AS (SELECT query_id, unit_id, coalesce(started, ended) AS best, epoch(low) AS l, epoch(high) AS h FROM ranges JOIN q
    ON coalesce(started <= high AND ended >= low, false) OR coalesce(started BETWEEN low AND high, false) OR coalesce(ended BETWEEN low AND high, false)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, unit_id) AS rank FROM m)
SELECT query_id, unit_id, round(1 - least(abs(epoch(best) - (l + h) / 2) / ((h - l) / 2), 1), 6) AS proximity, rank::INTEGER AS rank FROM r WHERE rank <= 10"""


def date_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a date phrase asked at each event's time; the phrase goes by the event's id."""
    phrases = ["what happened yesterday", "who called today", "a couple of days ago", "a few weeks ago", "last week", "last month", "last year", "in march 2023", "no date at all", "last weekend"]
    asked = F.element_at(F.array(*map(F.lit, phrases)), F.pmod(F.col("event_id"), F.lit(len(phrases))).cast("int") + 1)
    rows = table(spark, sf_dir, "events").select("event_id", time.phrase_window(asked, F.col("ts")).alias("w"))
    return rows.select("event_id", F.col("w.start").cast("string").alias("start"), F.col("w.end").cast("string").alias("end"))


DATE_PHRASES = """
WITH e AS (SELECT event_id, event_id % 10 AS p, ts::DATE AS d, date_trunc('week', ts)::DATE AS w, date_trunc('month', ts)::DATE AS m, date_trunc('year', ts)::DATE AS y FROM events)
SELECT event_id,
    (CASE p WHEN 0 THEN d - 1 WHEN 1 THEN d WHEN 2 THEN d - 2 WHEN 3 THEN d - 24 WHEN 4 THEN w - 7 WHEN 5 THEN (m - INTERVAL 1 MONTH)::DATE WHEN 6 THEN (y - INTERVAL 1 YEAR)::DATE WHEN 7 THEN DATE '2023-03-01' WHEN 9 THEN w - 2 END)::VARCHAR AS start,
    (CASE p WHEN 0 THEN d - 1 WHEN 1 THEN d WHEN 2 THEN d - 2 WHEN 3 THEN d - 18 WHEN 4 THEN w - 1 WHEN 5 THEN m - 1 WHEN 6 THEN y - 1 WHEN 7 THEN DATE '2023-03-31' WHEN 9 THEN w - 1 END)::VARCHAR AS "end"
FROM e"""


def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active buffered engrams of strength 0.5 or more that are facts, with their place in their bank."""
    rows = retrieval.scan(engrams(spark, sf_dir), least_strength=0.5, layer="buffer", status="active", tags=["fact"])
    return rows.select("bank_id", "engram_id", "strength", F.row_number().over(Window.partitionBy("bank_id").orderBy(F.desc("strength"), "engram_id")).alias("place"))


DICTIONARY_SCAN = f"""WITH {ENGRAMS} SELECT bank_id, engram_id, strength, row_number() OVER (PARTITION BY bank_id ORDER BY strength DESC, engram_id)::INTEGER AS place
FROM engrams WHERE strength >= 0.5 AND layer = 'buffer' AND status = 'active' AND list_contains(tags, 'fact')"""


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention a license in any case, with their length."""
    return retrieval.search_text(table(spark, sf_dir, "documents"), "LICENSE", ["text", "source"]).select("doc_id", "source", F.length("text").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (semantic_topk, indexed_topk, semantic_links, keyword_rank, hybrid_rrf, recall, combined_score_by_mode, token_budget, access_bump, bank_merge, tag_jaccard, temporal_entry, date_phrases, dictionary_scan, text_search)}
ORACLE_SQL = {
    "semantic_topk": SEMANTIC.format(least=-1, k=10),
    "indexed_topk": SEMANTIC.format(least=-1, k=10),
    "semantic_links": SEMANTIC.format(least=0.2, k=5),
    "keyword_rank": KEYWORD,
    "hybrid_rrf": HYBRID,
    "recall": _recall_sql(),
    "combined_score_by_mode": _combined_sql(),
    "token_budget": TOKEN_BUDGET,
    "access_bump": ACCESS_BUMP,
    "bank_merge": BANK_MERGE,
    "tag_jaccard": _tag_sql(),
    "temporal_entry": TEMPORAL_ENTRY,
    "date_phrases": DATE_PHRASES,
    "dictionary_scan": DICTIONARY_SCAN,
    "text_search": "SELECT doc_id, source, length(text) AS n FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%'",
}
