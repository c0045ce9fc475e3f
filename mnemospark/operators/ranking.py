"""Ranking, fusion, normalisation and budgets."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scoring
from mnemospark.functions.constants import AGENT_WEIGHT, SHARED_WEIGHT

#: Parts that one set's rows are dealt into before a budget is applied to it.
SPREAD = 64
#: Most bytes of keys that go to every worker; more are joined by shuffle.
KEY_BYTES = 24 << 20


def few(keys: DataFrame, row_bytes: int = 100) -> bool:
    """Whether the rows of a checkpointed frame of keys may go to every worker."""
    return keys.count() * row_bytes <= KEY_BYTES


def members(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose ``on`` is among the (checkpointed) keys; they are read where they lie if the keys are few."""
    return rows.join(F.broadcast(keys) if few(keys) else keys, on, "left_semi")


def top_per(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark cuts groups before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def rrf(lists: list[DataFrame], by: list[str], id_: str, k: int = 60, first_rank: int = 1) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over lists with by, id and rank.

    ``rank`` starts at ``first_rank``; ``source`` is the first list that has the id.
    """
    rows = reduce(DataFrame.unionByName, [x.select(*by, id_, "rank", F.lit(n).alias("list")) for n, x in enumerate(lists)])
    return rows.groupBy(*by, id_).agg(F.sum(1.0 / (k + F.col("rank") + (1 - first_rank))).alias("rrf"), F.min("list").alias("source"))


def normalise(rows: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Min-max over each result set."""
    w = Window.partitionBy(*by)
    return rows.withColumn(out, scoring.min_max(F.col(column), F.min(column).over(w), F.max(column).over(w)))


def token_budget(rows: DataFrame, by: list[str], order: list[Column], tokens: str, most: int) -> DataFrame:
    """The leading rows of each set whose running token count stays within ``most``.

    A set is dealt into ``SPREAD`` parts first. A part's running count is never
    above the set's (no row has fewer than no tokens), so rows behind the one that
    crosses the budget in their part go before the set's rows meet in one task.
    The crossing row stays until then: it keeps what comes after it, in any part,
    beyond the budget.
    """
    first = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.withColumn("_part", F.spark_partition_id() % SPREAD)
    some = parts.withColumn("_before", F.sum(tokens).over(first)).filter(F.coalesce("_before", F.lit(0)) <= most).drop("_part", "_before")
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return some.withColumn("running_tokens", F.sum(tokens).over(run)).filter(F.col("running_tokens") <= most)


def text_budget(rows: DataFrame, by: list[str], order: list[Column], column: str, most: int) -> DataFrame:
    """Texts within a budget of characters; the one that crosses it is cut."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.length(column)).over(run) - F.length(column)
    return rows.withColumn("_before", before).filter(F.col("_before") < most).withColumn(column, F.expr(f"substring({column}, 1, cast({most} - _before as int))")).drop("_before")


def entity_budget(rows: DataFrame, per_entity: int, overall: int) -> DataFrame:
    """Nested greedy budget: each entity takes observations up to its own and the query's rest.

    ``rows``: query_id, entity_no, entity_id, obs_no, tokens. The fold depends on
    what earlier entities took, so each query's (few) rows are one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, keep = pdf.sort_values(["entity_no", "obs_no"]), overall, []
        for _, group in pdf.groupby("entity_no", sort=True):
            own, open_ = min(per_entity, left), True
            for t in group["tokens"]:
                open_ = open_ and t <= own
                keep.append(open_)
                if open_:
                    own, left = own - t, left - t
        return pdf[keep]

    return rows.groupBy("query_id").applyInPandas(fold, rows.schema)


def access_bump(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """Results near the top: score of 0.4 or more and of 0.7 of the best."""
    best = F.max(score).over(Window.partitionBy(*by))
    return rows.withColumn("_best", best).filter(F.col(score) >= F.greatest(F.lit(0.4), 0.7 * F.col("_best"))).drop("_best")


def merge_banks(agent: DataFrame, shared: DataFrame, mode: str, by: list[str], id_: str, score: str, boosted: Column | None = None) -> DataFrame:
    """Agent and shared results in one list: shared duplicates go, then bank weights, boost and penalty."""
    fresh = shared.join(agent.select(*by, id_), [*by, id_], "left_anti")
    both = agent.withColumn("tier", F.lit("agent")).unionByName(fresh.withColumn("tier", F.lit("shared")))
    weight = F.when(F.col("tier") == "agent", AGENT_WEIGHT[mode]).otherwise(SHARED_WEIGHT[mode])
    value = F.col(score) * weight
    if boosted is not None:
        value = F.when(boosted, (value + 0.2) * 0.95).otherwise(value)
    return both.withColumn("merged", value)


def keep_first(lists: list[DataFrame], by: list[str]) -> DataFrame:
    """Bag union by priority: of rows with equal keys the one of the earliest list stays."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("_list", F.lit(n)) for n, x in enumerate(lists)])
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_list"))).filter("_n = 1").drop("_n", "_list")
