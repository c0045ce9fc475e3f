"""Lifecycle of stored items: gate, promotion, decay, reconsolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scoring
from mnemospark.functions.constants import DIMENSIONS, GATE, RECONSOLIDATION_BUDGET
from mnemospark.operators.ranking import top_per

BUFFER_FLOOR = 0.05


def gate(items: DataFrame, mode: str) -> DataFrame:
    """Items whose overall score reaches the mode's threshold, with that score."""
    return items.withColumn("overall", scoring.overall(mode, *(F.col(d) for d in DIMENSIONS))).filter(F.col("overall") >= GATE[mode])


def with_sizes(items: DataFrame, bank: str = "bank_id") -> DataFrame:
    """bank_size of each item's bank, by an aggregate that combines before the shuffle."""
    return items.join(items.groupBy(bank).agg(F.count(F.lit(1)).alias("bank_size")), bank)


def composite(items: DataFrame, mode: str | None = None) -> DataFrame:
    """factor, rate, sessions_alive, decay and composite of each item.

    Needs the four dimensions, overall, access_count, created_session,
    session_count and bank_size.
    """
    dims = [F.coalesce(F.col(d), F.lit(0.5)) for d in DIMENSIONS]
    out = items.withColumn("factor", scoring.bank_factor(F.col("bank_size")))
    out = out.withColumn("rate", scoring.equilibrium_rate(mode, *dims, F.col("factor")))
    out = out.withColumn("sessions_alive", F.greatest(F.lit(0), F.col("session_count") - F.col("created_session")))
    out = out.withColumn("decay", scoring.decay(F.col("access_count"), F.col("sessions_alive"), F.col("rate")))
    return out.withColumn("composite", scoring.composite(F.col("overall"), F.col("decay")))


def promote(items: DataFrame, mode: str | None = None) -> DataFrame:
    """First consolidation: new layer, status and strength of working items.

    Novelty below 0.2 archives with strength 0 (unless it is missing); enough
    access and a composite above the tags' threshold move to the buffer; others
    only get their strength refreshed.
    """
    rated = composite(items, mode)
    dull = F.coalesce(F.col("novelty") < 0.2, F.lit(False))
    passed = (F.col("access_count") >= scoring.access_gate(F.col("factor"))) & (F.col("composite") >= scoring.promote_threshold(F.col("tags")))
    return rated.select(
        *items.columns,
        "composite",
        F.when(dull, "archived").when(passed, "promoted").otherwise("kept").alias("decision"),
        F.when(~dull & passed, "buffer").otherwise(F.lit("working")).alias("new_layer"),
        F.when(dull, "archived").otherwise("active").alias("new_status"),
        F.when(dull, F.lit(0.0)).otherwise(scoring.clamp(F.col("composite"))).alias("new_strength"),
    )


def decay_sweep(items: DataFrame) -> DataFrame:
    """Second consolidation: one session more, and items of a small composite are archived."""
    swept = composite(items.withColumn("session_count", F.col("session_count") + 1), None)
    gone = F.col("composite") < BUFFER_FLOOR
    return swept.select(*items.columns, "decay", "composite", F.when(gone, "archived").otherwise("active").alias("new_status"), F.when(gone, F.lit(0.0)).otherwise(scoring.clamp(F.col("composite"))).alias("new_strength"))


def reconsolidation_queue(items: DataFrame, mode: str, by: list[str], flagged: Column, id_: str, accessed: str) -> DataFrame:
    """Flagged items, then weak ones, then the rest; each by strength and last access, within the mode's budget."""
    strength = F.coalesce(F.col("strength"), F.lit(0.0))
    tier = F.when(flagged, 0).when(strength < 0.3, 1).otherwise(2)
    seen = F.coalesce(F.col(accessed).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = items.withColumn("tier", tier).withColumn("_s", strength).withColumn("_a", seen)
    return top_per(rows, by, [F.col("tier"), F.col("_s"), F.col("_a"), F.col(id_)], RECONSOLIDATION_BUDGET[mode]).drop("_s", "_a")


def resolve_duplicates(pairs: DataFrame) -> DataFrame:
    """KEEP, DROP or REPLACE of new items by their best match.

    pairs: new_id, old_id (null: no duplicate), new_score, old_score, old_strength.
    """
    wins = F.col("new_score") >= F.col("old_score") + 0.1 * F.coalesce("old_strength", F.lit(0.5))
    return pairs.withColumn("resolution", F.when(F.col("old_id").isNull(), "KEEP").when(wins, "REPLACE").otherwise("DROP"))


def evidence(sources: DataFrame, key: str, ids: str, items: DataFrame, item: str, n: int) -> DataFrame:
    """The first ``n`` active items of each declared list of ids, in its order, within the bank."""
    wanted = sources.select(key, "bank_id", F.posexplode(ids).alias("place", item))
    found = wanted.join(items.filter("status = 'active'"), [item, "bank_id"])
    return top_per(found, [key], [F.col("place")], n)


def aggregate_confidence(facts: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """mean(confidence) x max(0.5, 1 - 0.15 x the relevance of issues of 0.3 or more), 0 to 1."""
    mean = facts.groupBy(key).agg(F.avg("confidence").alias("mean"))
    lost = issues.groupBy(key).agg(F.sum(F.when(F.col("relevance") >= 0.3, F.col("relevance")).otherwise(0.0)).alias("lost"))
    return mean.join(lost, key, "left").select(key, scoring.clamp(F.col("mean") * F.greatest(F.lit(0.5), 1 - 0.15 * F.coalesce("lost", F.lit(0.0)))).alias("confidence"))


def promotion_reason(schemas: DataFrame) -> DataFrame:
    """Whether a schema may be shared: ten items, three cycles, reinforced in the last seven days."""
    reason = F.when(F.col("evidence") < 10, "evidence").when(F.col("cycles") < 3, "cycles").when(F.col("idle_days") > 7, "inactive").otherwise("eligible")
    return schemas.withColumn("reason", reason)


def archive_dead(schemas: DataFrame) -> DataFrame:
    """Schemas without reinforcement for over eight cycles and with fewer than three items."""
    return schemas.withColumn("dead", (scoring.cycles(F.col("idle_days")) > 8) & (F.col("evidence") < 3))


def session_counters(items: DataFrame, bank: str) -> DataFrame:
    """Items and sessions of each bank."""
    return items.groupBy(bank).agg(F.count(F.lit(1)).alias("n_items"), F.max("session_count").alias("sessions"))


def keep_last(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group (session history, tiers)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
