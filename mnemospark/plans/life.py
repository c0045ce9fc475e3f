"""Lifecycle, consolidation, document and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import scoring, vector
from mnemospark.operators import consolidation, lifecycle, ranking, texts
from mnemospark.plans.derived import ENGRAMS, EVERY, RATED, engrams
from mnemospark.sources import store
from mnemospark.sources.tables import table


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engrams that pass the gate of validation mode."""
    return lifecycle.gate(engrams(spark, sf_dir).drop("overall"), "validation").select("engram_id", F.round("overall", 6).alias("overall"))


GATE = f"""WITH {ENGRAMS}, g AS (SELECT engram_id, greatest(0.0, least(1.0, 0.2 * novelty + 0.4 * surprise + 0.2 * task_relevance + 0.2 * emotional_valence)) AS o, novelty FROM engrams)
SELECT engram_id, round(o, 6) AS overall FROM g WHERE novelty IS NOT NULL AND o >= 0.2"""


def lifecycle_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor, rate, decay and composite of every engram in precision mode."""
    rated = lifecycle.composite(lifecycle.with_sizes(engrams(spark, sf_dir)), "precision")
    return rated.select("engram_id", *(F.round(c, 6).alias(c) for c in ("factor", "rate", "decay", "composite")))


COMPOSITE = f"WITH {ENGRAMS}, {RATED.format(source='engrams', rate=0.8)} SELECT engram_id, round(factor, 6) AS factor, round(rate, 6) AS rate, round(decay, 6) AS decay, round(composite, 6) AS composite FROM scored"


def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First consolidation of all active working engrams (no layer counts as working)."""
    rows = engrams(spark, sf_dir).withColumn("layer", F.coalesce("layer", F.lit("working")))
    out = lifecycle.promote(lifecycle.with_sizes(rows).filter("layer = 'working' and status = 'active'"))
    return out.select("engram_id", "decision", "new_layer", "new_status", F.round("new_strength", 6).alias("new_strength"))


PROMOTION = f"""
WITH {ENGRAMS}, {RATED.format(source='engrams', rate=0.5)},
p AS (SELECT *, coalesce(novelty < 0.2, false) AS dull, access_count >= greatest(1, ceil(5 * factor)) AND composite >= CASE WHEN list_contains(tags, 'experience') OR list_contains(tags, 'opinion') THEN 0.35 ELSE 0.7 END AS passed
    FROM scored WHERE coalesce(layer, 'working') = 'working' AND status = 'active')
SELECT engram_id, CASE WHEN dull THEN 'archived' WHEN passed THEN 'promoted' ELSE 'kept' END AS decision,
    CASE WHEN NOT dull AND passed THEN 'buffer' ELSE 'working' END AS new_layer, CASE WHEN dull THEN 'archived' ELSE 'active' END AS new_status,
    round(CASE WHEN dull THEN 0.0 ELSE greatest(0.0, least(1.0, composite)) END, 6) AS new_strength FROM p"""


def decay_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second consolidation of all active engrams, one session later."""
    out = lifecycle.decay_sweep(lifecycle.with_sizes(engrams(spark, sf_dir)).filter("status = 'active'"))
    return out.select("engram_id", F.round("composite", 6).alias("composite"), "new_status", F.round("new_strength", 6).alias("new_strength"))


DECAY_SWEEP = f"""
WITH {ENGRAMS}, later AS (SELECT * REPLACE (session_count + 1 AS session_count) FROM engrams), {RATED.format(source='later', rate=0.5)}
SELECT engram_id, round(composite, 6) AS composite, CASE WHEN composite < 0.05 THEN 'archived' ELSE 'active' END AS new_status,
    round(CASE WHEN composite < 0.05 THEN 0.0 ELSE least(1.0, composite) END, 6) AS new_strength FROM scored WHERE status = 'active'"""


def reconsolidation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bank's queue in exploration mode: flagged, weak, then the rest."""
    out = lifecycle.reconsolidation_queue(engrams(spark, sf_dir), "exploration", ["bank_id"], F.col("engram_id") % 13 == 0, "engram_id", "ts")
    return out.select("bank_id", "engram_id", "tier", "rank")


QUEUE = f"""
WITH {ENGRAMS}, t AS (SELECT *, CASE WHEN engram_id % 13 = 0 THEN 0 WHEN strength < 0.3 THEN 1 ELSE 2 END AS tier FROM engrams),
r AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY tier, strength, ts, engram_id) AS rank FROM t)
SELECT bank_id, engram_id, tier, rank::INTEGER AS rank FROM r WHERE rank <= 15"""


def strength_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths after a confirmation or contradiction, by each bank's disposition."""
    e = engrams(spark, sf_dir)
    profile = scoring.disposition(F.col("bank_id") % 5 + 1, F.col("bank_id") % 3 + 2, F.col("bank_id") % 4 + 1)
    delta = F.when(F.col("engram_id") % 3 == 0, 0.1).when(F.col("engram_id") % 3 == 1, 0.0).otherwise(-0.2)
    value = scoring.modulated_strength(F.col("strength"), delta, F.col("engram_id") % 3 == 0, F.col("surprise"), profile)
    return e.select("engram_id", profile.alias("profile"), F.round(value, 6).alias("new_strength"))


STRENGTH = f"""
WITH {ENGRAMS},
p AS (SELECT *, CASE WHEN bank_id % 5 + 1 >= 4 THEN 'analytical' WHEN bank_id % 4 + 1 >= 4 THEN 'optimistic' WHEN bank_id % 3 + 2 >= 4 THEN 'conservative' ELSE 'neutral' END AS profile,
    CASE engram_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.0 ELSE -0.2 END::DOUBLE AS delta FROM engrams),
w AS (SELECT *, CASE profile WHEN 'neutral' THEN 1.0 WHEN 'analytical' THEN 1.2 ELSE 0.8 END::DOUBLE AS weight, CASE profile WHEN 'optimistic' THEN 0.2 ELSE 0.0 END::DOUBLE AS bias,
    CASE profile WHEN 'neutral' THEN 0.0 WHEN 'analytical' THEN 0.3 WHEN 'optimistic' THEN 0.5 ELSE 0.7 END::DOUBLE AS tolerance FROM p)
SELECT engram_id, profile, round(CASE WHEN delta < 0 AND surprise < tolerance THEN strength
    ELSE greatest(0.0, least(1.0, strength + delta * weight + CASE WHEN engram_id % 3 = 0 THEN bias ELSE 0 END)) END, 6) AS new_strength FROM w"""


def strength_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and mean strength by layer and strength bucket, zero where there is none."""
    e = engrams(spark, sf_dir)
    bucket = F.when(F.col("strength") < 0.3, "weak").when(F.col("strength") <= 0.7, "medium").otherwise("strong")
    stats = e.groupBy(F.coalesce("layer", F.lit("none")).alias("layer"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("strength").alias("mean"))
    keys = spark.sql("SELECT layer, bucket FROM (SELECT explode(array('none', 'working', 'buffer', 'archive')) AS layer) LATERAL VIEW explode(array('weak', 'medium', 'strong')) t AS bucket")
    return keys.join(stats, ["layer", "bucket"], "left").select("layer", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"))


BUCKETS = f"""
WITH {ENGRAMS}, s AS (SELECT coalesce(layer, 'none') AS layer, CASE WHEN strength < 0.3 THEN 'weak' WHEN strength <= 0.7 THEN 'medium' ELSE 'strong' END AS bucket, count(*) AS n, avg(strength) AS mean FROM engrams GROUP BY ALL),
k AS (SELECT * FROM (SELECT unnest(['none', 'working', 'buffer', 'archive']) AS layer), (SELECT unnest(['weak', 'medium', 'strong']) AS bucket))
SELECT layer, bucket, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean FROM k LEFT JOIN s USING (layer, bucket)"""


def bank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and type, by user, and in all: grouping sets in one pass."""
    table(spark, sf_dir, "events").createOrReplaceTempView("stats_events")
    return spark.sql("SELECT coalesce(user_id, -1) AS user_id, coalesce(event_type, '') AS event_type, count(*) AS n, round(sum(value), 2) AS total, cast(grouping_id(user_id, event_type) AS int) AS level FROM stats_events GROUP BY GROUPING SETS ((user_id, event_type), (user_id), ())")


BANK_STATS = "SELECT coalesce(user_id, -1) AS user_id, coalesce(event_type, '') AS event_type, count(*) AS n, round(sum(value), 2) AS total, grouping(user_id, event_type)::INTEGER AS level FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id), ())"


def entity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest shipments of each part with at least five (observations' evidence)."""
    l = table(spark, sf_dir, "lineitem")
    often = l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("facts")).filter("facts >= 5")
    top = ranking.top_per(l.join(often, "l_partkey"), ["l_partkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    return top.select("l_partkey", "facts", "l_orderkey", "l_linenumber", "rank")


ENTITY_TOP = """
WITH r AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS facts, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT l_partkey, facts, l_orderkey, l_linenumber, rank::INTEGER AS rank FROM r WHERE facts >= 5 AND rank <= 5"""


def entity_list(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The entities most often mentioned: parts by orders and last appearance."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("mentions"), F.max("l_shipdate").alias("last")).orderBy(F.desc("mentions"), F.desc("last"), "l_partkey").limit(k).select("l_partkey", "mentions")


ENTITY_LIST = "SELECT l_partkey, count(*) AS mentions FROM lineitem GROUP BY l_partkey ORDER BY count(*) DESC, max(l_shipdate) DESC, l_partkey LIMIT 20"


def doc_unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of their labels and the digest of their content."""
    d = store.tracked_documents(table(spark, sf_dir, "documents"), "source", "doc_id", "text").select(F.col("document_id").cast("long").alias("doc_id"), F.col("bank_id").alias("source"), "content_hash")
    n = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"))
    return d.join(n, "doc_id", "left").select("doc_id", "source", "content_hash", F.coalesce("units", F.lit(0)).alias("units"))


DOC_UNITS = "SELECT d.doc_id, d.source, sha256(coalesce(text, '')) AS content_hash, count(l.doc_id) AS units FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL"


def vector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit centroid of each label, by element."""
    c = consolidation.centroids(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


_MEANS = """e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL)"""
CENTROIDS = f"WITH {_MEANS} SELECT label, i::INTEGER AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m"


def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise cosine within each label, without making pairs."""
    return consolidation.cohesion(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", "n", F.round("cohesion", 6).alias("cohesion"))


COHESION = """
WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT label, count(*) AS n FROM v GROUP BY label),
p AS (SELECT a.label, avg(list_cosine_similarity(a.e, b.e)) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label)
SELECT label, n, round(coalesce(c, 1.0), 6) AS cohesion FROM n LEFT JOIN p USING (label)"""


def centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each vector is to its label's centroid after the centroid drifted towards it."""
    e = table(spark, sf_dir, "embeddings")
    c = consolidation.centroids(e, ["label"], "embedding").select("label", "centroid")
    moved = e.join(c, "label").withColumn("moved", vector.drift(F.col("centroid"), vector.normalised(F.col("embedding")), 0.05))
    return moved.select("vec_id", F.round(vector.cosine(F.col("moved"), F.col("embedding")), 6).alias("similarity"))


DRIFT = f"""
WITH {_MEANS}, c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
n AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS y FROM u),
d AS (SELECT n.vec_id, 0.95 * c.x + 0.05 * n.y AS z, n.y FROM n JOIN c USING (label, i))
SELECT vec_id, round(sum(z * y) / (sqrt(sum(z * z)) * sqrt(sum(y * y))), 6) AS similarity FROM d GROUP BY vec_id"""


def schema_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label centroid nearest to every hundredth vector, if it has a similarity of 0.2."""
    e = table(spark, sf_dir, "embeddings")
    c = consolidation.centroids(e, ["label"], "embedding").select("label", "centroid")
    q = e.filter(F.col("vec_id") % EVERY == 0).select("vec_id", F.col("embedding").cast("array<double>").alias("centroid"))
    return consolidation.match(q, c, "vec_id", "label", 0.2).select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("match").cast("int"), F.lit(-1)).alias("label"), F.round("similarity", 6).alias("similarity"))


SCHEMA_MATCH = f"""
WITH {_MEANS}, c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], c.c) AS s FROM embeddings, c WHERE vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS r FROM s WHERE s >= 0.2)
SELECT v.vec_id, coalesce(r.label, -1) AS label, round(r.s, 6) AS similarity FROM embeddings v LEFT JOIN r ON r.vec_id = v.vec_id AND r.r = 1 WHERE v.vec_id % {EVERY} = 0"""


def agglomerative_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete-linkage clusters of each label's vectors at a distance of 0.75."""
    return consolidation.clusters(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", cut=0.75)


def dedup_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEEP, DROP or REPLACE of each event by the nearest one before it of its user and type within a day."""
    from mnemospark.operators.links import near_in_time

    e = engrams(spark, sf_dir)
    near = near_in_time(e, e, "bank_id", "engram_id", "ts", 86400).filter(F.col("b") < F.col("a"))
    same = near.groupBy("a").agg(F.min_by("b", F.struct("gap", "b")).alias("old_id"))
    old = e.select(F.col("engram_id").alias("old_id"), F.col("overall").alias("old_score"), F.col("strength").alias("old_strength"))
    pairs = e.select(F.col("engram_id").alias("a"), F.col("overall").alias("new_score")).join(same, "a", "left").join(old, "old_id", "left")
    return lifecycle.resolve_duplicates(pairs).select(F.col("a").alias("new_id"), F.coalesce("old_id", F.lit(-1)).alias("old_id"), "resolution")


DEDUP = f"""
WITH {ENGRAMS},
p AS (SELECT x.engram_id AS new_id, y.engram_id AS old_id, y.overall AS os, y.strength AS ost, row_number() OVER (PARTITION BY x.engram_id ORDER BY abs(epoch(x.ts) - epoch(y.ts)), y.engram_id) AS r
    FROM engrams x JOIN engrams y ON x.bank_id = y.bank_id AND y.engram_id < x.engram_id AND abs(epoch(x.ts) - epoch(y.ts)) <= 86400)
SELECT e.engram_id AS new_id, coalesce(p.old_id, -1) AS old_id, CASE WHEN p.old_id IS NULL THEN 'KEEP' WHEN e.overall >= os + 0.1 * ost THEN 'REPLACE' ELSE 'DROP' END AS resolution
FROM engrams e LEFT JOIN p ON p.new_id = e.engram_id AND p.r = 1"""


def property_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the tags of each bank's engrams: numbers of ``k``, the commonest activity and keyword."""
    p = consolidation.properties(engrams(spark, sf_dir), ["bank_id"], "tags")
    return p.select("bank_id", "key", "type", "count", "mean", "median", "min", "max", "value", F.round("confidence", 6).alias("confidence"))


PROPERTIES = f"""
WITH {ENGRAMS}, t AS (SELECT bank_id, unnest(tags) AS tag FROM engrams), sizes AS (SELECT bank_id, count(*) AS evidence FROM engrams GROUP BY 1),
kv AS (SELECT bank_id, CASE WHEN contains(tag, ':') AND trim(split_part(tag, ':', 2)) <> '' THEN trim(split_part(tag, ':', 1)) ELSE '_keywords' END AS key,
    CASE WHEN contains(tag, ':') AND trim(split_part(tag, ':', 2)) <> '' THEN trim(split_part(tag, ':', 2)) ELSE trim(tag) END AS value FROM t),
a AS (SELECT bank_id, key, count(*) AS count, bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS num, avg(TRY_CAST(value AS DOUBLE)) AS mean, median(TRY_CAST(value AS DOUBLE)) AS median, min(TRY_CAST(value AS DOUBLE)) AS lo, max(TRY_CAST(value AS DOUBLE)) AS hi FROM kv GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY bank_id, key ORDER BY n DESC, value) AS r FROM (SELECT bank_id, key, value, count(*) AS n FROM kv GROUP BY ALL))
SELECT a.bank_id, a.key, CASE WHEN num THEN 'numeric' ELSE 'categorical' END AS type, a.count, CASE WHEN num THEN round_even(mean, 0) END AS mean, CASE WHEN num THEN round_even(median, 0) END AS median,
    CASE WHEN num THEN lo END AS min, CASE WHEN num THEN hi END AS max, CASE WHEN NOT num THEN value END AS value, CASE WHEN NOT num THEN round(n / evidence, 6) END AS confidence
FROM a JOIN m ON a.bank_id = m.bank_id AND a.key = m.key AND m.r = 1 JOIN sizes s ON s.bank_id = a.bank_id"""


def property_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on which a bank's early and late engrams disagree."""
    e = engrams(spark, sf_dir)
    early = consolidation.properties(e.filter(F.col("engram_id") % 2 == 0), ["bank_id"], "tags")
    late = consolidation.properties(e.filter(F.col("engram_id") % 2 == 1), ["bank_id"], "tags")
    return consolidation.conflicts(early, late, ["bank_id"])


def _half(n: int) -> str:
    return PROPERTIES.replace("FROM events)", f"FROM events WHERE event_id % 2 = {n})").strip()


CONFLICTS = f"""
WITH x AS ({_half(0)}), y AS ({_half(1)})
SELECT bank_id, key, kind FROM (SELECT x.bank_id, x.key, CASE WHEN x.type <> y.type THEN 'type_mismatch'
    WHEN x.type = 'numeric' AND abs(x.mean - y.mean) > 0.5 * greatest(x.max - x.min, y.max - y.min) THEN 'numeric'
    WHEN x.type = 'categorical' AND x.value <> y.value THEN 'categorical' END AS kind FROM x JOIN y ON x.bank_id = y.bank_id AND x.key = y.key) WHERE kind IS NOT NULL"""


def dominant_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest tags of each bank, ties by first appearance."""
    return consolidation.dominant_tags(engrams(spark, sf_dir), ["bank_id"], "tags", "engram_id").select("bank_id", "tag", "count", "rank")


DOMINANT = f"""
WITH {ENGRAMS}, t AS (SELECT bank_id, engram_id, unnest(tags) AS tag, unnest(range(len(tags))) AS p FROM engrams),
c AS (SELECT bank_id, tag, count(*) AS count, min(engram_id * 10 + p) AS f FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY count DESC, f, tag) AS rank FROM c)
SELECT bank_id, tag, count, rank::INTEGER AS rank FROM r WHERE rank <= 5"""


def promotion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a part may or may not be shared, and whether it is dead: by orders, months and idle days."""
    l = table(spark, sf_dir, "lineitem")
    now = scoring.seconds(F.lit(l.agg(F.max("l_shipdate")).first()[0]))
    p = l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("evidence"), F.count_distinct(F.date_trunc("month", "l_shipdate")).alias("cycles"), F.max("l_shipdate").alias("seen"))
    p = p.withColumn("idle_days", F.floor((now - scoring.seconds(F.col("seen"))) / 86400))
    return lifecycle.archive_dead(lifecycle.promotion_reason(p)).select("l_partkey", "evidence", "cycles", "idle_days", "reason", "dead")


REASONS = """
WITH p AS (SELECT l_partkey, count(*) AS evidence, count(DISTINCT date_trunc('month', l_shipdate)) AS cycles, max(l_shipdate) AS seen FROM lineitem GROUP BY 1),
d AS (SELECT *, floor((epoch((SELECT max(l_shipdate) FROM lineitem)) - epoch(seen)) / 86400)::BIGINT AS idle_days FROM p)
SELECT l_partkey, evidence, cycles, idle_days, CASE WHEN evidence < 10 THEN 'evidence' WHEN cycles < 3 THEN 'cycles' WHEN idle_days > 7 THEN 'inactive' ELSE 'eligible' END AS reason,
    floor(idle_days / 7) > 8 AND evidence < 3 AS dead FROM d"""


def chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document, by length and digest."""
    c = texts.chunks(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return c.select("chunk_id", "chunk_index", F.length("chunk_text").alias("n"), F.sha2("chunk_text", 256).alias("digest"))


def sub_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in batches of 60,000 characters at most."""
    return texts.sub_batches(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text", 60_000)


SUB_BATCHES = """
WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, doc_id, chars, r, coalesce(chars, 0) AS total, 0 AS batch FROM d WHERE r = 1
    UNION ALL SELECT d.source, d.doc_id, d.chars, d.r, CASE WHEN total > 0 AND total + coalesce(d.chars, 0) > 60000 THEN coalesce(d.chars, 0) ELSE total + coalesce(d.chars, 0) END,
        CASE WHEN total > 0 AND total + coalesce(d.chars, 0) > 60000 THEN batch + 1 ELSE batch END FROM f JOIN d ON d.source = f.source AND d.r = f.r + 1)
SELECT source, doc_id, chars::INTEGER AS chars, batch FROM f"""


def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all chunks of all documents, counted."""
    c = texts.chunks(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return texts.extract_facts(c).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("facts"))


def sequence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as facts, actions with effects or experiences."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "fact").when(F.col("turn") % 3 == 1, "action_effect").otherwise("experience")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), kind.alias("kind"), F.col("role").alias("fact"), F.col("role").alias("action"), F.col("turn").cast("string").alias("effect"), F.lit("expected").alias("expectation"), F.lit(None).cast("string").alias("outcome"))
    return texts.expand_sequences(rows)


SEQUENCES = """
WITH u AS (SELECT conv_id * 1000 + turn AS unit_id, turn, role FROM conversations)
SELECT unit_id, 'fact' AS kind, 0 AS place, 'fact' AS role, role AS text FROM u WHERE turn % 3 = 0
UNION ALL SELECT unit_id, 'action_effect', 0, 'action', role FROM u WHERE turn % 3 = 1
UNION ALL SELECT unit_id, 'action_effect', 1, 'effect', turn::VARCHAR FROM u WHERE turn % 3 = 1
UNION ALL SELECT unit_id, 'experience', 0, 'expectation', 'expected' FROM u WHERE turn % 3 = 2"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the accounts of every third one raised and of new ones added."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = c.filter(F.col("c_custkey") % 3 == 0).select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 10_000_000).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return store.upserted(c, new, ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


UPSERTED = """
SELECT c_custkey, round(CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 10000000, round(c_acctbal + 1, 2) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0"""


def cascaded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay in units, unit entities and links after every seventh order goes."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tables = {"units": o.select(F.col("o_orderkey").alias("unit_id")), "unit_entities": l.select(F.col("l_orderkey").alias("unit_id"), "l_partkey"), "links": o.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))}
    kept = store.cascade(tables, o.filter(F.col("o_orderkey") % 7 == 0).select(F.col("o_orderkey").alias("unit_id")))
    rows = [df.agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t, df in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


CASCADED = """
WITH gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0)
SELECT 'units' AS name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (FROM gone)
UNION ALL SELECT 'unit_entities', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM gone)
UNION ALL SELECT 'links', count(*) FROM orders WHERE o_orderkey NOT IN (FROM gone) AND o_orderkey + 1 NOT IN (FROM gone)"""


def working_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's working context after all recalls, an event being a result of a day's recall."""
    from mnemospark.streaming.sessions import working_contexts as run

    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("session_id"), F.dayofmonth("ts").alias("recall_no"), F.concat_ws("-", "event_type", (F.col("event_id") % 40)).alias("item"), (F.pmod(F.col("event_id") * 31, F.lit(101)) / 101).alias("score"))
    return run(rows).withColumn("relevance", F.round("relevance", 6))


def tier_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A working context of all events after some minutes in precision mode."""
    from mnemospark.streaming.sessions import decayed

    e = table(spark, sf_dir, "events")
    tier = F.element_at(F.array(F.lit("focus"), F.lit("supporting"), F.lit("peripheral")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.select("event_id", tier.alias("tier"), (F.pmod(F.col("event_id") * 31, F.lit(101)) / 100).alias("relevance"), (F.col("event_id") % 9).alias("minutes"))
    return decayed(rows, "precision").select("event_id", "tier", F.round("relevance", 6).alias("relevance"))


TIER_DECAY = """
WITH r AS (SELECT event_id, event_id % 3 AS t, (event_id * 31 % 101) / 100 * pow(0.9, event_id % 9) AS s FROM events),
a AS (SELECT *, CASE WHEN t = 0 AND s < 0.5 THEN 1 ELSE t END AS u FROM r), b AS (SELECT *, CASE WHEN u = 1 AND s < 0.3 THEN 2 ELSE u END AS w FROM a)
SELECT event_id, ['focus', 'supporting', 'peripheral'][w + 1] AS tier, round(s, 6) AS relevance FROM b WHERE NOT (w = 2 AND s < 0.1)"""


QUERIES = {f.__name__: f for f in (gate, lifecycle_composite, promotion_decision, decay_sweep, reconsolidation_queue, strength_update, strength_buckets, bank_stats, entity_top, entity_list, doc_unit_counts, vector_centroids, cluster_cohesion, centroid_drift, schema_match, agglomerative_clusters, dedup_resolution, property_aggregation, property_conflicts, dominant_tags, promotion_reasons, chunking, sub_batches, extracted_facts, sequence_units, upserted, cascaded_delete, working_contexts, tier_decay)}
ORACLE_SQL = {
    "gate": GATE,
    "lifecycle_composite": COMPOSITE,
    "promotion_decision": PROMOTION,
    "decay_sweep": DECAY_SWEEP,
    "reconsolidation_queue": QUEUE,
    "strength_update": STRENGTH,
    "strength_buckets": BUCKETS,
    "bank_stats": BANK_STATS,
    "entity_top": ENTITY_TOP,
    "entity_list": ENTITY_LIST,
    "doc_unit_counts": DOC_UNITS,
    "vector_centroids": CENTROIDS,
    "cluster_cohesion": COHESION,
    "centroid_drift": DRIFT,
    "schema_match": SCHEMA_MATCH,
    "dedup_resolution": DEDUP,
    "property_aggregation": PROPERTIES,
    "property_conflicts": CONFLICTS,
    "dominant_tags": DOMINANT,
    "promotion_reasons": REASONS,
    "sub_batches": SUB_BATCHES,
    "sequence_units": SEQUENCES,
    "upserted": UPSERTED,
    "cascaded_delete": CASCADED,
    "tier_decay": TIER_DECAY,
}
