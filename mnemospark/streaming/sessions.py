"""Sessions, working context and associations, in batch and as streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.constants import CAPACITY, TIER_DECAY
from mnemospark.operators.links import association_weight, near_in_time

#: Scores at which a tier is entered, left, or an item discarded.
PROMOTE = {"focus": 0.7, "supporting": 0.4}
DEMOTE = {"focus": 0.5, "supporting": 0.3}
DISCARD = 0.1
REINFORCE = 0.5
TIERS = ("focus", "supporting", "peripheral")


def sessions(events: DataFrame, user: str, ts: str, gap: str = "24 hours", late: str | None = None) -> DataFrame:
    """Sessions that end ``gap`` after their last event: user, start, end, n. With ``late`` also on a stream."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def mode_shift(rows: DataFrame, mode: str, explicit: str, error: str) -> DataFrame:
    """The mode after a signal: a prediction error of 0.3 or more goes to validation, unless the mode was set."""
    shifted = F.when(F.col(explicit), F.col(mode)).when(F.col(error) >= 0.3, "validation").otherwise(F.col(mode))
    return rows.withColumn("next_mode", shifted)


def decayed(rows: DataFrame, mode: str, tier: str = "tier", score: str = "relevance", minutes: str = "minutes") -> DataFrame:
    """Working context after some minutes: scores fade, tiers are left below their limit; discarded rows go.

    One pass lets an item fall several tiers, as its score demands.
    """
    out = rows.withColumn(score, F.greatest(F.lit(0.0), F.col(score) * F.pow(F.lit(TIER_DECAY.get(mode, 0.95)), F.col(minutes))))
    t = F.when((F.col(tier) == "focus") & (F.col(score) < DEMOTE["focus"]), "supporting").otherwise(F.col(tier))
    out = out.withColumn(tier, t)
    out = out.withColumn(tier, F.when((F.col(tier) == "supporting") & (F.col(score) < DEMOTE["supporting"]), "peripheral").otherwise(F.col(tier)))
    return out.filter(~((F.col(tier) == "peripheral") & (F.col(score) < DISCARD)))


class Context:
    """The tiers of one session: item to (score, order of activation)."""

    def __init__(self, tiers: dict[str, dict[str, tuple[float, int]]] | None = None):
        self.tiers = tiers or {t: {} for t in TIERS}

    def _insert(self, level: int, item: str, score: float, at: int) -> None:
        if level >= len(TIERS):
            return
        tier = self.tiers[TIERS[level]]
        if len(tier) >= CAPACITY[TIERS[level]]:
            weakest = min(tier, key=lambda i: tier[i])
            moved = tier.pop(weakest)
            tier[item] = (score, at)
            self._insert(level + 1, weakest, *moved)
        else:
            tier[item] = (score, at)

    def recall(self, results: list[tuple[str, float]], at: int) -> None:
        """Take in one recall, best first: known items gain and may rise, new ones enter by their place."""
        for place, (item, score) in enumerate(results):
            level = next((k for k, t in enumerate(TIERS) if item in self.tiers[t]), None)
            if level is None:
                self._insert(0 if place < CAPACITY["focus"] else 1 if place < CAPACITY["focus"] + CAPACITY["supporting"] else 2, item, score, at)
                continue
            gained = min(1.0, self.tiers[TIERS[level]][item][0] + REINFORCE * score)
            rise = 0 if gained >= PROMOTE["focus"] else 1 if gained >= PROMOTE["supporting"] else level
            if rise < level:
                del self.tiers[TIERS[level]][item]
                self._insert(rise, item, gained, at)
            else:
                self.tiers[TIERS[level]][item] = (gained, at)

    def replay(self, numbers: list, items: list, scores: list) -> None:
        """Take in the recalls of some rows: by number, each from its best score on, ties by item."""
        rows = [(n, math.nan if s is None else s, None if i is None else str(i)) for n, i, s in zip(numbers, items, scores, strict=True) if n is not None and n == n]
        rows.sort(key=lambda r: (r[0], r[1] != r[1], -r[1] if r[1] == r[1] else 0.0, r[2] is None, r[2] or ""))
        for n, part in groupby(rows, key=itemgetter(0)):
            self.recall([(str(i), s) for _, s, i in part], int(n))

    def rows(self) -> list[tuple[str, str, float]]:
        return [(t, i, s) for t in TIERS for i, (s, _) in sorted(self.tiers[t].items())]


def working_contexts(recalls: DataFrame) -> DataFrame:
    """The tiers of every session after all its recalls: session_id, tier, item, relevance.

    recalls: session_id, recall_no, item, score. The order of recalls decides,
    so a session is one group; a session's recalls are few. Sessions are many, so
    each is put in order as plain lists: a frame for each costs far more.
    """

    def run(table: pa.Table) -> pa.Table:
        context = Context()
        context.replay(*(table.column(c).to_pylist() for c in ("recall_no", "item", "score")))
        tiers, items, scores = zip(*context.rows(), strict=True) if context.rows() else ((), (), ())
        of = pa.array([str(table.column("session_id")[0].as_py())] * len(tiers), pa.string())
        return pa.Table.from_arrays([of, pa.array(tiers, pa.string()), pa.array(items, pa.string()), pa.array(scores, pa.float64())], ["session_id", "tier", "item", "relevance"])

    return recalls.groupBy("session_id").applyInArrow(run, "session_id string, tier string, item string, relevance double")


def working_context_stream(recalls: DataFrame, idle: str = "24 hours") -> DataFrame:
    """The same on a stream of recalls (session_id, recall_no, item, score): after each batch the tiers it changed.

    State is one context a session; a session without recalls for ``idle`` of
    processing time is dropped.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        context = Context()
        if state.exists:
            for t, i, s, a in zip(*state.get, strict=True):
                context.tiers[t][i] = (s, a)
        pdf = pd.concat(list(frames))
        context.replay(*(pdf[c].tolist() for c in ("recall_no", "item", "score")))
        flat = [(t, i, s, a) for t in TIERS for i, (s, a) in context.tiers[t].items()]
        state.update(tuple(list(c) for c in zip(*flat, strict=True)))
        state.setTimeoutDuration(idle_ms)
        out = pd.DataFrame(context.rows(), columns=["tier", "item", "relevance"])
        out.insert(0, "session_id", str(key[0]))
        yield out

    output = "session_id string, tier string, item string, relevance double"
    kept = "tier array<string>, item array<string>, relevance array<double>, activated array<long>"
    return recalls.groupBy("session_id").applyInPandasWithState(run, output, kept, "update", "ProcessingTimeTimeout")


def associations(events: DataFrame, session: str, item: str, ts: str, minutes: float = 5) -> DataFrame:
    """Unordered pairs of items seen within ``minutes`` in a session, how often and with what weight."""
    near = near_in_time(events, events.select(session, item, ts), session, item, ts, minutes * 60).filter(F.col("a") < F.col("b"))
    return near.groupBy("bank", "a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", association_weight(F.col("n")))


def association_stream(events: DataFrame, session: str, item: str, ts: str, minutes: float = 5, late: str = "1 hour") -> DataFrame:
    """Pairs within ``minutes`` as an interval join of the stream with itself; state ends with the watermark."""
    a = events.select(F.col(session).alias("session_a"), F.col(item).alias("a"), F.col(ts).alias("t")).withWatermark("t", late)
    b = events.select(F.col(session).alias("session_b"), F.col(item).alias("b"), F.col(ts).alias("u")).withWatermark("u", late)
    window = F.expr(f"u BETWEEN t - INTERVAL {int(minutes * 60)} SECONDS AND t + INTERVAL {int(minutes * 60)} SECONDS")
    return a.join(b, (F.col("session_a") == F.col("session_b")) & (F.col("a") < F.col("b")) & window)


def once(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each event once on a stream, as far back as the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window on a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def flush(rows: DataFrame, store, batch: int, query: str = "co_activation") -> bool:
    """``foreachBatch`` sink: the batch's co-activation links go to the store, weighted by the strongest pair of their bank.

    The links and a record of the batch are one version of the store, so a batch
    that is replayed after a failure adds nothing. False: it was there already.
    ``query`` tells the batches of several streams apart.
    """
    done = f"{query}-{batch}"
    if not store.read("operations").filter(F.col("operation_id") == done).isEmpty():
        return False
    n = rows.groupBy("bank_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy("bank_id").agg(F.max("n").alias("most"))
    links = n.join(most, "bank_id").select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.lit("co_activated").alias("type"), (F.col("n") / F.col("most")).alias("weight"), "bank_id")
    record = rows.sparkSession.createDataFrame([(done, "flush", "done")], "operation_id string, type string, status string")
    store.append({"links": links, "operations": record})
    return True


def inferences(rows: DataFrame) -> DataFrame:
    """Tentative inferences of an ended session at half their confidence."""
    return rows.withColumn("confidence", F.when(F.col("status") == "tentative", F.col("confidence") * 0.5).otherwise(F.col("confidence")))
