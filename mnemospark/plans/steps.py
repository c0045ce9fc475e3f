"""Single steps of retain, consolidation and listings as queries of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import providers, scoring, text, vector
from mnemospark.operators import consolidation, lifecycle, links, ranking, retrieval, texts
from mnemospark.plans.derived import ENGRAMS, EVERY, engrams, share
from mnemospark.sources.tables import table


def weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector moved by a quarter towards the one after it."""
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    moved = vector.weighted_centroid(F.col("embedding"), F.col("next"), F.lit(0.75), F.lit(0.25))
    both = e.join(after, "vec_id").select("vec_id", moved.alias("c"))
    return both.select("vec_id", F.round(F.get("c", F.lit(0)), 6).alias("first"), F.round(F.get("c", F.lit(63)), 6).alias("last"))


WEIGHTED = """
WITH m AS (SELECT x.vec_id, list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * 0.75::DOUBLE + p[2]::DOUBLE * 0.25::DOUBLE) AS c FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda v: v * v))) AS n FROM m)
SELECT vec_id, round(c[1] / n, 6) AS first, round(c[64] / n, 6) AS last FROM n"""


def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and sessions of each bank."""
    return lifecycle.session_counters(engrams(spark, sf_dir), "bank_id")


COUNTERS = f"WITH {ENGRAMS} SELECT bank_id, count(*) AS n_items, max(session_count) AS sessions FROM engrams GROUP BY 1"


def schema_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and maturity of each market segment among a nation's customers."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("members"))
    part = F.col("members") / F.sum("members").over(Window.partitionBy("c_nationkey"))
    return n.select("c_nationkey", "c_mktsegment", "members", scoring.maturity(part, F.col("members")).alias("maturity"))


MATURITY = """
WITH m AS (SELECT c_nationkey, c_mktsegment, count(*) AS members FROM customer GROUP BY ALL),
d AS (SELECT *, members / sum(members) OVER (PARTITION BY c_nationkey) AS share FROM m)
SELECT c_nationkey, c_mktsegment, members, CASE WHEN share >= 0.6 AND members >= 5 THEN 'dominant' WHEN share >= 0.3 THEN 'stable' ELSE 'emerging' END AS maturity FROM d"""


def fact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of an order's lines, ten seconds apart by their place."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    return texts.offset_times(l, ["l_orderkey"], "l_linenumber", ["at"]).select("l_orderkey", "l_linenumber", F.unix_seconds("at").alias("seconds"))


FACT_TIMES = "SELECT l_orderkey, l_linenumber, 1704067200 + 10 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) AS seconds FROM lineitem"


def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading 300 characters of each conversation, turn by turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ranking.text_budget(c, ["conv_id"], [F.col("turn")], "text", 300).select("conv_id", "turn", "text")


CHUNK_BUDGET = """
WITH r AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS before FROM conversations)
SELECT conv_id, turn, substring(text, 1, (300 - before)::INTEGER) AS text FROM r WHERE before < 300"""


def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty events of each user."""
    return lifecycle.keep_last(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


HISTORY = "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20"


def dictionary_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty engrams by novelty, those without one last."""
    rows = engrams(spark, sf_dir).orderBy(F.desc_nulls_last("novelty"), "engram_id").offset(100).limit(50)
    return rows.select("engram_id", "novelty")


PAGE = f"WITH {ENGRAMS} SELECT engram_id, novelty FROM engrams ORDER BY novelty DESC NULLS LAST, engram_id LIMIT 50 OFFSET 100"


def gate_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty, surprise, relevance and valence of a similarity; every seventh event has none."""
    s = F.when(F.col("event_id") % 7 != 0, share(F.col("event_id"), 31))
    named = {"novelty": scoring.novelty(s), "surprise": scoring.surprise(s), "relevance": scoring.task_relevance(s), "valence": scoring.valence(s)}
    return table(spark, sf_dir, "events").select("event_id", *(F.round(c, 6).alias(n) for n, c in named.items()))


DIMENSIONS = """
WITH s AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (event_id * 31 % 101) / 100 END AS s FROM events)
SELECT event_id, round(1 - coalesce(s, 0), 6) AS novelty, round(coalesce(1 - s, 0.5), 6) AS surprise, round(coalesce(s, 0.5), 6) AS relevance, round(CASE WHEN s IS NULL THEN 0.3 ELSE least(1.0, (1 - s) * 1.5) END, 6) AS valence FROM s"""


def reranker_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reranker reads of an event, and a logit of it as a score."""
    context = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.col("event_type"))
    day = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", providers.rerank_text(F.lit("seen"), context, day).alias("input"), F.round(scoring.sigmoid(share(F.col("event_id"), 13) * 4 - 2), 6).alias("score"))


RERANKER = """
SELECT event_id, concat_ws(' ', CASE WHEN event_id % 3 <> 0 THEN '[Date: ' || strftime(ts, '%Y-%m-%d') || ']' END, CASE WHEN event_id % 2 <> 0 THEN event_type || ':' END, 'seen') AS input,
    round(1 / (1 + exp(2 - 4 * ((event_id * 13 % 101) / 100))), 6) AS score FROM events"""


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without null characters, with their month, in the first person and out of a code fence."""
    e = table(spark, sf_dir, "events")
    told = F.concat(F.lit("Ann believes "), F.col("event_type"), F.lit(" is Ann's aim"))
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return e.select(
        "event_id",
        text.sanitise(F.concat(F.col("event_type"), F.chr(F.lit(0)), F.lit("!"))).alias("clean"),
        text.augmented(F.col("event_type"), F.col("ts"), F.lit("plan"), F.col("event_type"), share(F.col("event_id"), 7)).alias("augmented"),
        text.first_person(told, F.lit("Ann")).alias("opinion"),
        text.strip_fence(fenced).alias("body"),
    )


TEXT_FORMS = """
SELECT event_id, event_type || '!' AS clean, event_type || ' (happened in ' || strftime(ts, '%B %Y') || ') [task: plan]' || CASE WHEN (event_id * 7 % 101) / 100 > 0.6 THEN ' [mostly ' || event_type || ']' ELSE '' END AS augmented,
    'I believe ' || event_type || ' is my aim' AS opinion, trim(props) AS body FROM events"""


def schema_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts described by their properties, within forty characters."""
    p = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.describe(p, 40).alias("description"))


DESCRIPTIONS = "SELECT p_partkey, substring('brand: ' || p_brand || '; size: ' || p_size || '; type: ' || p_type, 1, 40) AS description FROM part"


def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags given, derived and inherited, each once, in this order."""
    more = F.array(F.lit("fact"), F.concat(F.lit("activity:"), F.element_at(F.split(F.col("tags")[1], ":"), 2)), F.lit("parent"))
    return engrams(spark, sf_dir).select("engram_id", F.array_join(text.tag_union(F.col("tags"), more), "|").alias("tags"))


TAG_UNION = f"""
WITH {ENGRAMS}, t AS (SELECT engram_id, list_concat(tags, ['fact', tags[2], 'parent']) AS l FROM engrams)
SELECT engram_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags FROM t"""


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all turns by role."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(text.n_tokens(F.col("text")).cast("long")).alias("tokens"))


TOKEN_USAGE = r"SELECT role, sum(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')))::BIGINT AS tokens FROM conversations GROUP BY role"


def vectors_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that the hundredth parts name."""
    ids = table(spark, sf_dir, "part").filter(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("vec_id"))
    return retrieval.point_lookup(table(spark, sf_dir, "embeddings"), ids, "vec_id").select("vec_id", F.size("embedding").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


VECTORS_BY_ID = f"SELECT vec_id, len(embedding)::INTEGER AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_partkey % {EVERY} = 0)"


def dot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five links of every hundredth vector, of twice its length, to those whose dot product with it is 0.7 or more."""
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 2))
    found = retrieval.vector_search(e, e.filter(F.col("vec_id") % EVERY == 0), "vec_id", "embedding", 5, 0.7, metric="dot")
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), F.round(F.least("score", F.lit(1.0)), 6).alias("weight"))


DOT_LINKS = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_dot_product(q.e, i.e) AS s FROM v q JOIN v i ON q.vec_id <> i.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, item_id, round(least(s, 1.0), 6) AS weight FROM s WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, item_id) <= 5"""


def latest_entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the newest orders of each part to its last fifty ones before, counted by part."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    new = F.col("l_orderkey") % EVERY == 0
    found = links.new_entity_links(l.filter(new), l.filter(~new), "l_orderkey", "l_partkey", [F.desc("l_orderkey")])
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("n_links"), F.sum("a").alias("ends"))


LATEST_LINKS = f"""
WITH u AS (SELECT *, l_orderkey % {EVERY} = 0 AS new, row_number() OVER (PARTITION BY l_partkey, l_orderkey % {EVERY} = 0 ORDER BY l_orderkey DESC) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)),
p AS (SELECT x.l_partkey AS entity, x.l_orderkey AS a FROM u x JOIN u y ON x.l_partkey = y.l_partkey AND x.l_orderkey <> y.l_orderkey
    WHERE (x.new AND y.new AND x.r <= 50 AND y.r <= 50) OR (x.new AND NOT y.new AND y.r <= 50) OR (NOT x.new AND y.new AND x.r <= 50))
SELECT entity, count(*) AS n_links, sum(a)::BIGINT AS ends FROM p GROUP BY entity"""


def resolved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of every hundredth vector with the rest, as of the stored items of the same ids; another label contradicts."""
    e = table(spark, sf_dir, "embeddings")
    new = F.col("vec_id") % EVERY == 0
    found = consolidation.detect_conflicts(e.filter(new), e.filter(~new), "vec_id", "embedding", 0.2)
    says = engrams(spark, sf_dir).join(e.select(F.col("vec_id").alias("engram_id"), "label"), "engram_id").select(F.col("engram_id").cast("string").alias("id"), "overall", "strength", F.col("ts").alias("at"), "label")
    of = lambda x: says.select(F.col("id").alias(f"{x}_id"), F.col("overall").alias(f"{x}_score"), F.col("strength").alias(f"{x}_strength"), F.col("at").alias(f"{x}_at"), F.col("label").alias(f"{x}_label"))
    pairs = found.join(of("new"), "new_id").join(of("old"), "old_id").withColumn("contradicts", ~F.col("new_label").eqNullSafe(F.col("old_label")))
    done = consolidation.resolve_conflicts(pairs)
    return done.select(F.col("new_id").cast("long").alias("new_id"), F.col("old_id").cast("long").alias("old_id"), "action", F.col("winner").cast("long").alias("winner"))


RESOLVED = f"""
WITH {ENGRAMS}, v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS new_id, i.vec_id AS old_id, q.label IS DISTINCT FROM i.label AS contradicts, list_cosine_similarity(q.e, i.e) AS s FROM v q JOIN v i ON q.vec_id % {EVERY} = 0 AND i.vec_id % {EVERY} <> 0),
p AS (SELECT * FROM s WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY round(s, 9) DESC, old_id) <= 5),
j AS (SELECT p.*, CASE WHEN contradicts THEN a.overall > b.overall OR (a.overall = b.overall AND a.ts > b.ts) ELSE a.strength >= b.strength END AS wins
    FROM p JOIN engrams a ON a.engram_id = new_id JOIN engrams b ON b.engram_id = old_id)
SELECT new_id, old_id, CASE WHEN contradicts THEN CASE WHEN wins THEN 'contradiction_link' ELSE 'keep_existing' END WHEN wins THEN 'replace' ELSE 'merge' END AS action,
    CASE WHEN wins THEN new_id ELSE old_id END AS winner FROM j"""


def schema_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each part's schema, its shared match being another part."""
    p = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    schemas = parts.select(p.alias("schema_id"), F.when(p % 3 != 0, p * 2).alias("match"))
    return consolidation.promotion(schemas, parts.select(p.alias("schema_id")), parts.filter(p % 5 == 0).select(p.alias("schema_id"))).select("schema_id", "action")


PROMOTIONS = """
SELECT p_partkey AS schema_id, CASE WHEN p_partkey % 3 = 0 OR p_partkey * 2 NOT IN (SELECT p_partkey FROM part) THEN 'promote' WHEN p_partkey % 5 = 0 THEN 'dispute' ELSE 'reinforce' END AS action FROM part"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, every third without a match, two that meet the same."""
    v = F.col("vec_id")
    known = F.when(v % 3 != 0, F.floor(v / 2).cast("string"))
    return table(spark, sf_dir, "embeddings").select(v.alias("cluster"), F.col("embedding").alias("centroid"), known.alias("match"), share(v, 41).alias("similarity"), (v % 9 + 1).alias("n"))


def matured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints after a run: one cycle more for those met, new ones, and none that are stale."""
    v = F.col("vec_id")
    seen = F.timestamp_seconds(F.lit(1704067200) - F.pmod(v, F.lit(10)) * 86400)
    old = table(spark, sf_dir, "embeddings").filter(v % 2 == 0).select(v.alias("id"), F.col("embedding").alias("centroid"), (v % 3).cast("int").alias("cycles"), seen.alias("last_seen"))
    return consolidation.mature(_matched(spark, sf_dir), old, "2024-01-01 00:00:00").select("id", "cycles", F.unix_seconds("last_seen").alias("seen"), "ready")


MATURED = """
WITH m AS (SELECT DISTINCT (vec_id // 2)::BIGINT AS id FROM embeddings WHERE vec_id % 3 <> 0),
o AS (SELECT vec_id, (vec_id % 3 + (m.id IS NOT NULL)::INTEGER)::INTEGER AS cycles, CASE WHEN m.id IS NULL THEN 1704067200 - vec_id % 10 * 86400 ELSE 1704067200 END::BIGINT AS seen FROM embeddings LEFT JOIN m ON m.id = vec_id WHERE vec_id % 2 = 0),
a AS (SELECT vec_id::VARCHAR AS id, cycles, seen FROM o UNION ALL SELECT 'new-' || vec_id, 1, 1704067200 FROM embeddings WHERE vec_id % 3 = 0)
SELECT id, cycles, seen, cycles >= 2 AS ready FROM a WHERE seen >= 1704067200 - 7 * 86400"""


def reinforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of schemas after clusters met them, and schemas made of clusters that met none."""
    v = F.col("vec_id")
    old = table(spark, sf_dir, "embeddings").filter(v % 2 == 0).select(v.alias("schema_id"), F.col("embedding").alias("centroid"), (v % 7 + 1).alias("evidence"), F.lit(None).cast("timestamp").alias("last_reinforced"))
    return consolidation.reinforce(_matched(spark, sf_dir), old, "2024-01-01 00:00:00").select("schema_id", "evidence", F.col("last_reinforced").isNotNull().alias("met"))


REINFORCED = """
WITH m AS (SELECT (vec_id // 2)::BIGINT AS id, sum(vec_id % 9 + 1) AS more FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY 1)
SELECT vec_id::VARCHAR AS schema_id, (vec_id % 7 + 1 + coalesce(more, 0))::BIGINT AS evidence, more IS NOT NULL AS met FROM embeddings LEFT JOIN m ON m.id = vec_id WHERE vec_id % 2 = 0
UNION ALL SELECT 'schema-' || vec_id, vec_id % 9 + 1, true FROM embeddings WHERE vec_id % 3 = 0"""


def cleaned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted facts of events made regular."""
    i, at = F.col("event_id"), F.unix_seconds("ts")
    kinds = F.element_at(F.array(*map(F.lit, ("world", "assistant", "opinion", "other"))), (i % 4 + 1).cast("int"))
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(i % 6 == 0, " n/a ").otherwise(F.col("event_type")).alias("what"),
        F.when(i % 2 == 0, "today").otherwise("N/A").alias("when"),
        F.when(i % 3 == 0, "").otherwise("Ann").alias("who"),
        F.lit("none").alias("why"),
        kinds.alias("fact_type"),
        F.when(i % 5 == 0, "event").otherwise("state").alias("kind"),
        F.lit(None).cast("long").alias("occurred_start"),
        F.lit(None).cast("long").alias("occurred_end"),
        at.alias("reference"),
    )
    return texts.clean_facts(raw).select("event_id", "fact_type", "text", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("occurred_start", "occurred_end")))


CLEANED = """
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'experience' WHEN 2 THEN 'opinion' ELSE 'world' END AS fact_type,
    concat_ws(' | ', CASE WHEN event_id % 6 <> 0 THEN event_type END, CASE WHEN event_id % 2 = 0 THEN 'When: today' END, CASE WHEN event_id % 3 <> 0 THEN 'Involving: Ann' END) AS text,
    CASE WHEN event_id % 5 = 0 THEN floor(epoch(ts))::BIGINT ELSE -1 END AS started FROM events)
SELECT event_id, fact_type, text, started AS occurred_start, started AS occurred_end FROM t WHERE text <> ''"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a store after two appends, an upsert, a backup and a restore, by table and bank."""
    import uuid

    from mnemospark.sources.store import Store

    root = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    store, copy = Store(spark, f"{root}/a"), Store(spark, f"{root}/b")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("unit_id"), F.concat(F.lit("bank-"), F.col("user_id") % 3).alias("bank_id"), F.col("event_type").alias("text"), F.col("event_id").alias("n"))
    store.append({"units": e.filter("n % 2 = 0"), "access_events": e.filter("n % 5 = 0")})
    store.append({"units": e.filter("n % 2 = 1")})
    store.upsert("units", e.filter("n % 4 = 0").withColumn("text", F.lit("again")))
    store.backup(f"{root}/backup")
    copy.restore(f"{root}/backup")
    units = copy.read("units").groupBy("bank_id").agg(F.lit("units").alias("name"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "again").alias("again"))
    seen = copy.read("access_events").groupBy("bank_id").agg(F.lit("access_events").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("again"))
    return units.unionByName(seen)


STORED = """
SELECT 'bank-' || (user_id % 3) AS bank_id, 'units' AS name, count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS again FROM events GROUP BY 1
UNION ALL SELECT 'bank-' || (user_id % 3), 'access_events', count(*), 0 FROM events WHERE event_id % 5 = 0 GROUP BY 1"""


_ALL = (
    (weighted_centroids, WEIGHTED),
    (session_counters, COUNTERS),
    (schema_maturity, MATURITY),
    (fact_times, FACT_TIMES),
    (chunk_budget, CHUNK_BUDGET),
    (session_history, HISTORY),
    (dictionary_page, PAGE),
    (gate_dimensions, DIMENSIONS),
    (reranker_input, RERANKER),
    (text_forms, TEXT_FORMS),
    (schema_descriptions, DESCRIPTIONS),
    (tag_union, TAG_UNION),
    (token_usage, TOKEN_USAGE),
    (vectors_by_id, VECTORS_BY_ID),
    (dot_links, DOT_LINKS),
    (latest_entity_links, LATEST_LINKS),
    (resolved_conflicts, RESOLVED),
    (schema_promotions, PROMOTIONS),
    (matured, MATURED),
    (reinforced, REINFORCED),
    (cleaned_facts, CLEANED),
    (stored, STORED),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: s for f, s in _ALL}
