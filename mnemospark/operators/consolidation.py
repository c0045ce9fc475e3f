"""Consolidation: centroids, clusters, properties and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text, vector
from mnemospark.operators.clustering import clusters, complete_linkage  # noqa: F401
from mnemospark.operators.ranking import top_per

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"


def means(rows: DataFrame, by: list[str], vector_column: str) -> DataFrame:
    """Elementwise mean vector and count of each group; partial sums per element combine before the shuffle."""
    parts = rows.select(*by, F.posexplode(F.col(vector_column).cast("array<double>")).alias("_i", "_x"))
    sums = parts.groupBy(*by, "_i").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda e: e["_m"]).alias("mean"), F.max("n").alias("n"))


def centroids(rows: DataFrame, by: list[str], vector_column: str) -> DataFrame:
    """Unit-length centroid of each group."""
    return means(rows, by, vector_column).select(*by, "n", vector.normalised(F.col("mean")).alias("centroid"))


def cohesion(rows: DataFrame, by: list[str], vector_column: str) -> DataFrame:
    """Mean cosine of a group's unordered pairs; 1 for fewer than two.

    No pairs are made: for unit vectors it is (|sum|^2 - n) / (n (n - 1)).
    """
    unit = rows.select(*by, vector.normalised(F.col(vector_column)).alias("_v"))
    m = means(unit, by, "_v")
    square = vector.dot(F.col("mean"), F.col("mean")) * F.col("n") * F.col("n")
    return m.select(*by, "n", F.when(F.col("n") < 2, F.lit(1.0)).otherwise((square - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))


def dominant_tags(rows: DataFrame, by: list[str], tags: str, order: str, k: int = 5) -> DataFrame:
    """The ``k`` commonest tags of each group; ties by first appearance."""
    each = rows.select(*by, F.col(order).alias("_o"), F.posexplode(tags).alias("_p", "tag"))
    counts = each.groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("_o", "_p")).alias("_first"))
    return top_per(counts, by, [F.desc("count"), F.col("_first"), F.col("tag")], k).drop("_first")


def properties(rows: DataFrame, by: list[str], tags: str) -> DataFrame:
    """Summary of ``key:value`` tags: numeric, temporal or categorical, decided by all values of a key.

    Integers' mean and median are rounded half to even. A categorical key has its
    commonest value (ties: the smallest) and its share of the group's rows.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("evidence"))
    each = rows.select(*by, F.explode(tags).alias("_t"))
    each = each.select(*by, text.tag_key(F.col("_t")).alias("key"), text.tag_value(F.col("_t")).alias("value"))
    number = F.when(F.col("value").rlike(NUMBER), F.col("value").cast("double"))
    summary = each.groupBy(*by, "key").agg(
        F.bool_and(F.col("value").rlike(NUMBER)).alias("_numeric"),
        F.bool_and(F.col("value").rlike(INTEGER)).alias("_integer"),
        F.bool_and(F.col("value").rlike(ISO_TIME)).alias("_temporal"),
        F.count(F.lit(1)).alias("count"),
        F.avg(number).alias("_mean"),
        F.median(number).alias("_median"),
        F.min(number).alias("_min"),
        F.max(number).alias("_max"),
        F.min("value").alias("_first"),
        F.max("value").alias("_last"),
    )
    modes = top_per(each.groupBy(*by, "key", "value").agg(F.count(F.lit(1)).alias("_times")), [*by, "key"], [F.desc("_times"), F.col("value")], 1).drop("rank")
    kind = F.when(F.col("_numeric"), "numeric").when(F.col("_temporal"), "temporal").otherwise("categorical")
    out = summary.join(modes, [*by, "key"]).join(sizes, by).withColumn("type", kind)
    numeric = F.col("type") == "numeric"
    whole = lambda c: F.when(numeric, F.when(F.col("_integer"), F.bround(F.col(c))).otherwise(F.col(c)))
    return out.select(
        *by,
        "key",
        "type",
        "count",
        whole("_mean").alias("mean"),
        whole("_median").alias("median"),
        F.when(numeric, F.col("_min")).alias("min"),
        F.when(numeric, F.col("_max")).alias("max"),
        F.when(F.col("type") == "temporal", F.col("_first")).alias("first_time"),
        F.when(F.col("type") == "temporal", F.col("_last")).alias("last_time"),
        F.when(F.col("type") == "categorical", F.col("value")).alias("value"),
        F.when(F.col("type") == "categorical", F.col("_times") / F.col("evidence")).alias("confidence"),
    )


def merge_properties(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two property tables by key and type: counts add up, ranges join, the stronger value stays."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, ["key", "type"], "full")
    n, m = F.coalesce(F.col("x.count"), F.lit(0)), F.coalesce(F.col("y.count"), F.lit(0))
    mean = F.when(F.col("type") == "numeric", (F.coalesce(F.col("x.mean"), F.lit(0.0)) * n + F.coalesce(F.col("y.mean"), F.lit(0.0)) * m) / (n + m))
    stronger = F.coalesce(F.col("x.confidence"), F.lit(-1.0)) >= F.coalesce(F.col("y.confidence"), F.lit(-1.0))
    return both.select(
        "key",
        "type",
        (n + m).alias("count"),
        mean.alias("mean"),
        F.least(F.col("x.min"), F.col("y.min")).alias("min"),
        F.greatest(F.col("x.max"), F.col("y.max")).alias("max"),
        F.when(stronger, F.col("x.value")).otherwise(F.col("y.value")).alias("value"),
        F.when(stronger, F.col("x.confidence")).otherwise(F.col("y.confidence")).alias("confidence"),
    )


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose summary value differs, also where one side has none."""
    x = a.select("key", F.coalesce(F.col("value"), F.col("mean").cast("string")).alias("left"))
    y = b.select("key", F.coalesce(F.col("value"), F.col("mean").cast("string")).alias("right"))
    return x.join(y, "key", "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def conflicts(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Conflicts on shared keys of two property tables.

    Different types; sets of values with a Jaccard below 0.2; means further
    apart than half the larger range; or unequal values.
    """
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, [*on, "key"])
    range_ = F.greatest(F.col("x.max") - F.col("x.min"), F.col("y.max") - F.col("y.min"))
    sets = text.jaccard(F.split("x.value", r"\|"), F.split("y.value", r"\|"))
    kind = (
        F.when(F.col("x.type") != F.col("y.type"), "type_mismatch")
        .when((F.col("x.type") == "numeric") & (F.abs(F.col("x.mean") - F.col("y.mean")) > 0.5 * range_), "numeric")
        .when((F.col("x.type") == "categorical") & (sets < 0.2), "categorical")
        .when((F.col("x.type") == "temporal") & (F.col("x.first_time") != F.col("y.first_time")), "scalar")
    )
    return both.select(*on, "key", kind.alias("kind")).filter(F.col("kind").isNotNull())


def match(clusters_: DataFrame, known: DataFrame, key: str, known_key: str, least: float = 0.85, block_rows: int = 2048, bank: str | None = None) -> DataFrame:
    """The nearest known centroid of each cluster with a similarity of ``least``; null if there is none.

    With ``bank``, a column of both sides, a cluster meets its bank's centroids;
    ``key`` still names one cluster.
    """
    from mnemospark.operators.retrieval import vector_search

    near = vector_search(known, clusters_, known_key, "centroid", 1, least, key, exclude_same=False, block=block_rows, bank=bank)
    near = near.select(F.col("query_id").alias(key), F.col("item_id").alias("match"), F.col("score").alias("similarity"))
    return clusters_.withColumn(key, F.col(key).cast("string")).join(near, key, "left")


def mature(matched: DataFrame, fingerprints: DataFrame, now: str, cycles: int = 2, stale_days: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprints after a run: met ones survive one cycle more, new clusters enter, stale ones go.

    Two clusters that meet one fingerprint count once. ``ready`` from ``cycles``.
    ``by``: columns of both sides (the bank) within which an id is one.
    """
    met = matched.filter("match is not null").groupBy(*by, F.col("match").alias("id")).agg(F.max("similarity").alias("similarity"))
    old = fingerprints.withColumn("id", F.col("id").cast("string")).join(met, [*by, "id"], "left")
    seen = F.col("similarity").isNotNull()
    stay = old.select(*by, "id", "centroid", (F.col("cycles") + seen.cast("int")).alias("cycles"), F.when(seen, F.lit(now).cast("timestamp")).otherwise(F.col("last_seen")).alias("last_seen"))
    new = matched.filter("match is null").select(*by, F.concat(F.lit("new-"), F.col("cluster").cast("string")).alias("id"), "centroid", F.lit(1).alias("cycles"), F.lit(now).cast("timestamp").alias("last_seen"))
    fresh = stay.unionByName(new).filter(F.col("last_seen") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(stale_days)))
    return fresh.withColumn("ready", F.col("cycles") >= cycles)


def reinforce(matched: DataFrame, schemas: DataFrame, now: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Schemas after clusters met them: moved centroid and added evidence; clusters without one become schemas.

    ``by``: columns of both sides (the bank) within which an id is one.
    """
    met = matched.filter("match is not null").groupBy(*by, F.col("match").alias("schema_id")).agg(F.max_by("centroid", "n").alias("new_centroid"), F.sum("n").alias("more"))
    old = schemas.withColumn("schema_id", F.col("schema_id").cast("string")).join(met, [*by, "schema_id"], "left")
    total = F.col("evidence") + F.coalesce("more", F.lit(0))
    moved = vector.weighted_centroid(F.col("centroid"), F.col("new_centroid"), F.col("evidence") / total, F.col("more") / total)
    stay = old.select(*by, "schema_id", F.when(F.col("more").isNull(), F.col("centroid")).otherwise(moved).alias("centroid"), total.alias("evidence"), F.when(F.col("more").isNull(), F.col("last_reinforced")).otherwise(F.lit(now).cast("timestamp")).alias("last_reinforced"))
    new = matched.filter("match is null").select(*by, F.concat(F.lit("schema-"), F.col("cluster").cast("string")).alias("schema_id"), "centroid", F.col("n").alias("evidence"), F.lit(now).cast("timestamp").alias("last_reinforced"))
    return stay.unionByName(new)


def promotion(schemas: DataFrame, shared: DataFrame, conflicts_: DataFrame) -> DataFrame:
    """What becomes of eligible schemas: promoted, reinforcing a shared one, or in dispute with it.

    schemas: schema_id, match (the nearest shared one or null); conflicts_: schema_id.
    """
    disputed = conflicts_.select("schema_id").distinct().withColumn("_c", F.lit(True))
    out = schemas.join(disputed, "schema_id", "left").join(shared.select(F.col("schema_id").alias("match"), F.lit(True).alias("_known")), "match", "left")
    action = F.when(F.col("_known").isNull(), "promote").when(F.col("_c"), "dispute").otherwise("reinforce")
    return out.select("schema_id", "match", action.alias("action"))


def detect_conflicts(new: DataFrame, shared: DataFrame, id_: str, vector_column: str, least: float = 0.85, most: int = 5) -> DataFrame:
    """new_id, old_id and similarity of each new item and those of its ``most`` nearest shared ones that are ``least`` similar or more."""
    from mnemospark.operators.retrieval import vector_search

    found = vector_search(shared, new, id_, vector_column, most, least)
    return found.select(F.col("query_id").alias("new_id"), F.col("item_id").alias("old_id"), F.col("score").alias("similarity"))


def resolve_conflicts(pairs: DataFrame) -> DataFrame:
    """What becomes of a new and a stored item that conflict: action, winner and loser.

    A contradiction is won by the higher score, of equal ones by the later date
    (a new item without a date is not later, a stored one without is earlier): the
    new item enters with a link to the other, or the stored one is kept. Without
    a contradiction a new item of at least the stored one's strength replaces it;
    a weaker one is merged into it.

    pairs: new_id, old_id, new_score, old_score, new_strength, old_strength,
    new_at, old_at, contradicts; null scores and strengths are 0.
    """
    score = [F.coalesce(f"{x}_score", F.lit(0.0)) for x in ("new", "old")]
    strength = [F.coalesce(f"{x}_strength", F.lit(0.0)) for x in ("new", "old")]
    later = F.col("new_at").isNotNull() & (F.col("old_at").isNull() | (F.col("new_at") > F.col("old_at")))
    wins = F.when(score[0] != score[1], score[0] > score[1]).otherwise(F.coalesce(later, F.lit(False)))
    contradicts = F.coalesce("contradicts", F.lit(False))
    new_wins = F.when(contradicts, wins).otherwise(strength[0] >= strength[1])
    action = F.when(contradicts, F.when(wins, "contradiction_link").otherwise("keep_existing")).otherwise(F.when(new_wins, "replace").otherwise("merge"))
    return pairs.withColumns({"action": action, "winner": F.when(new_wins, F.col("new_id")).otherwise(F.col("old_id")), "loser": F.when(new_wins, F.col("old_id")).otherwise(F.col("new_id"))})
