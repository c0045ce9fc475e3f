"""Entities: resolution by name, company and time; counts and lookups."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mnemospark.functions import scoring


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two names, for which Spark has no function."""
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def grams(name, n: int = 3):
    """Distinct character n-grams of a lower-case name; the whole name if it is shorter."""
    low = F.lower(name)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - n + 1)), lambda i: F.substring(low, i, F.lit(n)))
    return F.array_distinct(each)


def all_grams(name):
    """N-grams of one to three characters: what a shorter name's own n-grams are looked up among."""
    return F.array_union(F.array_union(grams(name, 1), grams(name, 2)), grams(name, 3))


def candidates(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions beside the entities of their bank whose lower name is equal, or contains or is contained in theirs.

    Containment both ways is met by equality on the rarest n-gram of the shorter
    name: either name that contains the other has all its n-grams, so joining
    on one chosen n-gram of each side against all of the other finds every pair.
    mentions: bank, mention_id, name; entities: bank, entity_id, canonical_name.
    """
    m = mentions.select("bank", "mention_id", "name", F.lower("name").alias("low"))
    e = entities.select("bank", "entity_id", "canonical_name", F.lower("canonical_name").alias("own"))
    every = e.select("bank", F.explode(all_grams(F.col("own"))).alias("gram")).groupBy("bank", "gram").agg(F.count(F.lit(1)).alias("often"))

    def rarest(rows: DataFrame, key: str, name: str) -> DataFrame:
        g = rows.select("bank", key, F.explode(grams(F.col(name))).alias("gram")).join(every, ["bank", "gram"], "left")
        w = Window.partitionBy("bank", key).orderBy(F.coalesce("often", F.lit(0)), "gram")
        return g.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("bank", key, "gram")

    # The mention inside the entity's name, then the entity's name inside the mention.
    inside = rarest(m, "mention_id", "low").join(e.select("bank", "entity_id", F.explode(all_grams(F.col("own"))).alias("gram")), ["bank", "gram"]).select("bank", "mention_id", "entity_id")
    around = rarest(e, "entity_id", "own").join(m.select("bank", "mention_id", F.explode(all_grams(F.col("low"))).alias("gram")), ["bank", "gram"]).select("bank", "mention_id", "entity_id")
    pairs = inside.union(around).distinct().join(m, ["bank", "mention_id"]).join(e, ["bank", "entity_id"])
    return pairs.filter(F.contains("own", "low") | F.contains("low", "own"))


def resolve(mentions: DataFrame, entities: DataFrame, company: DataFrame, least: float = 0.6) -> DataFrame:
    """The entity of each mention, or null where a new one is needed.

    mentions: bank, mention_id, name, nearby (array of names), seen; entities:
    bank, entity_id, canonical_name, last_seen; company: entity_id, names.

    A score depends on what is said and known, not on ids, so mentions that are
    alike are one row until the end, and of entities that are alike the smallest
    id stands for all, as it wins their tie. A name that a bank has very often is
    then one candidate and not the square of its copies.
    """
    said = ["bank", "name", "nearby", "seen"]
    kinds = mentions.groupBy(*said).agg(F.min("mention_id").alias("mention_id"))
    known = entities.join(company, "entity_id", "left").groupBy("bank", "canonical_name", "last_seen", "names").agg(F.min("entity_id").alias("entity_id"))
    found = candidates(kinds, known).join(kinds.select("bank", "mention_id", "nearby", "seen"), ["bank", "mention_id"]).join(known.select("bank", "entity_id", "canonical_name", "last_seen", "names"), ["bank", "entity_id", "canonical_name"])
    near = F.array_distinct(F.transform("nearby", lambda x: F.lower(x)))
    shared = F.when(F.size(near) > 0, F.size(F.array_intersect(near, F.coalesce("names", F.array().cast("array<string>")))) / F.size(near))
    days = F.abs(scoring.seconds(F.col("seen")) - scoring.seconds(F.col("last_seen"))) / 86400
    rated = found.withColumn("score", scoring.resolution(name_ratio("name", "canonical_name"), shared, days))
    best = rated.groupBy("bank", "mention_id").agg(F.max(F.struct("score", (-F.col("entity_id")).alias("id"))).alias("best"))
    best = best.filter(F.col("best.score") > least).select("bank", "mention_id", (-F.col("best.id")).alias("entity_id"), F.col("best.score").alias("score"))
    answers = kinds.join(best, ["bank", "mention_id"]).drop("mention_id")
    alike = reduce(lambda a, b: a & b, (F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")) for c in said))
    return mentions.alias("m").join(answers.alias("r"), alike, "left").select("m.bank", "m.mention_id", "m.name", "r.entity_id", "r.score")


def ambiguous(entities: DataFrame, bank: str, name: str) -> DataFrame:
    """Lower names that several entities of a bank have."""
    return entities.groupBy(bank, F.lower(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mention_counts(mentions: DataFrame, bank: str, name: str, seen: str) -> DataFrame:
    """Mentions and last appearance by lower name, with the latest spelling."""
    return mentions.groupBy(bank, F.lower(name).alias("key")).agg(F.count(F.lit(1)).alias("mention_count"), F.max(seen).alias("last_seen"), F.max_by(name, F.struct(seen, name)).alias("name"))
