"""Toxicity by class-conditional Kneser-Ney language models.

Two models, of toxic and of ordinary labelled texts, share the counts that they
back off to. A word's probability in a class is its discounted share of the
class's continuation counts (the different words that it follows there) plus
the rest of the mass times its share of both classes' continuation counts
together, so expressions that are rare in either class say nothing. The
discount is larger than is usual (``DISCOUNT``): in each class a word needs more
than three different contexts before it says anything.

Continuation counts are taken of word pairs; the pairs' own frequencies are not
a level of the models. They were tried: what copies and templates repeat makes
ordinary pairs look toxic, and fewer held-out rows come out right (no figures
were kept).

Counting: each task counts pairs of words by full 64-bit hashes, Spark adds
them up in a shuffle dealt by the whole pair, so no word is a hot key, and then
counts contexts by word. All words below the discount in both classes are
alike, so one row stands for them. What is shuffled, and the model with it,
grows with the labelled rows; no word is left out.

Scoring: the difference of the two models' log-likelihoods, normalised by
length, and the same over the words that lean to the toxic class, are brought to
a probability by a logistic regression. It is fitted on labelled rows that the
models have not seen: at most ``FIT_ROWS`` rows, chosen by a hash of the id from
one fold of crc32(doc_id) mod 5. All others but the held-out fold are counted.

The most frequent ``HOT_WORDS`` words of the model are broadcast. Where there
are more, the rest stays a table: the documents' other words are joined with it
and each document gets what was found, which gives the same scores.

Defined cases: a null or empty text scores as the regression does without
evidence; several labels of one doc_id count by majority, ties as toxic; a null
id or label teaches nothing and is not held out; repeated rows give repeated
rows; without labels of both classes every score is the share of toxic labels
(0 if there are none); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import cut, fresh, small, text_of, tune
from mnemospark.llm.words import CACHES, claim, mix

#: Discount of continuation counts in a class.
DISCOUNT = 3.0
#: Words of the model that are broadcast, the most frequent ones; 12 bytes each. The others are joined.
HOT_WORDS = 2_000_000
#: A word leans to the toxic class from this difference of log probabilities on.
LEANS = 1.0
#: Words of the usual difference that every text is taken to have besides its own.
USUAL_WORDS = 20
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 1
#: Labelled rows that the regression is fitted on, at most.
FIT_ROWS = 40_000
#: Pairs that a counting task holds before it hands them on.
HELD_PAIRS = 1_000_000
_PUNCTUATION = bytes(32 if chr(b) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


class _Hashes(dict):
    """Word to its hash, as a signed number; emptied when full, which bounds its memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word) - 2**63
        return b


_WORDS = _Hashes()
CACHES["toxicity"] = _WORDS.clear
#: The context that stands before a text's first word.
START = xxhash.xxh3_64_intdigest(b"\0start") - 2**63


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case and ASCII marks as spaces."""
    words = text.encode().lower().translate(_PUNCTUATION).split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("toxicity")
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def emit() -> pa.RecordBatch:
        word, before, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        pair = mix(word.view(np.uint64) * np.uint64(3) + mix(before.astype(np.uint64)))
        order = np.argsort(pair)
        firsts = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
        n = np.diff(np.r_[firsts, len(order)])
        bad = np.add.reduceat(toxic[order].astype(np.int32), firsts)
        at = order[firsts]
        return pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(before[at]), pa.array(bad.astype(np.int32)), pa.array((n - bad).astype(np.int32))], ["word", "before", "toxic", "plain"])

    n = 0
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = word_hashes(text)
            if len(w):
                held.append((w, np.r_[START, w[:-1]], np.full(len(w), label, bool)))
                n += len(w)
        if n >= HELD_PAIRS:
            yield emit()
            n = 0
    if n:
        yield emit()


class Models:
    """Differences of log probabilities, toxic minus ordinary, of words; of an unknown one; and the mean in ordinary texts."""

    def __init__(self, words: np.ndarray, word: np.ndarray, unseen: float, usual: float):
        order = np.argsort(words)
        self.words, self.word, self.unseen, self.usual = words[order], word[order].astype(np.float32), unseen, usual

    def known(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words the model has, and where."""
        if not len(self.words):
            return np.zeros(len(w), bool), np.zeros(len(w), np.int64)
        k = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return self.words[k] == w, k

    def features(self, text: str, more: list[dict] | None = None) -> tuple[float, ...]:
        """Mean difference per known word; toxic-leaning evidence by length and in all (log), and its words by length.

        Words that neither model knows leave the mean where it usually is, so
        a text in another language is not taken for a toxic one. ``more`` has
        what the rest of the model says of this text's words.
        """
        w = word_hashes(text)
        seen, k = self.known(w)
        d = np.full(len(w), self.unseen, np.float32)
        if len(self.words):
            d[seen] = self.word[k[seen]]
        if more:
            rest = Models(np.array([m["word"] for m in more], np.int64), np.array([m["d"] for m in more]), 0.0, 0.0)
            also, k = rest.known(w)
            d[also], seen = rest.word[k[also]], seen | also
        mean = (float(d[seen].sum(dtype=float)) + USUAL_WORDS * self.usual) / (int(seen.sum()) + USUAL_WORDS)
        leaning = d[d > LEANS]
        lean, long = float(leaning.sum(dtype=float)), max(1, len(w)) ** 0.5
        return mean, lean / long, float(np.log1p(lean)), len(leaning) / long


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with halved steps; mean and scale of the features, and weights with the bias first."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, pull = np.zeros(z.shape[1]), np.r_[1e-6, np.full(x.shape[1], ridge)]

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * pull @ (w * w))

    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        while (new := loss(w + step)) > at and np.abs(step).max() > 1e-9:
            step /= 2
        if at - new < 1e-9:
            break
        w, at = w + step, new
    return mean, scale, w


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _features(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        m = models.value
        for batch in batches:
            more = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            f = np.array([m.features(t, x) for t, x in zip(batch.column(0).to_pylist(), more, strict=True)], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k]) for k in range(4)), batch.column(1)], ["a", "b", "c", "d", "label"])

    return run


class Scorer:
    """Fitted models: what brings a text to a probability, shipped to the workers."""

    def __init__(self, constant: float, models=None, fitted=None, rest: DataFrame | None = None):
        self.constant, self.models, self.fitted, self.rest = constant, models, fitted, rest

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}  # a table of the session, which workers do not have

    def of(self, texts: list[str | None], more: list[list | None]) -> np.ndarray:
        if self.models is None:
            return np.full(len(texts), self.constant)
        m, (mean, scale, w) = self.models.value, self.fitted
        f = np.array([m.features(t or "", x) for t, x in zip(texts, more, strict=True)], float).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(w[0] + ((f - mean) / scale) @ w[1:], -30, 30)))


def _rare(models):
    """The words of each text that are not among the broadcast ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        m = models.value
        for batch in batches:
            found = []
            for t in batch.column(2).to_pylist():
                w = np.unique(word_hashes(t))
                found.append(w[~m.known(w)[0]].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["own_id", "own_key", "words"])

    return run


def _with_rest(docs: DataFrame, models, rest: DataFrame | None, doc_id: str, text: str, more: str) -> DataFrame:
    """The documents with a column ``more``: what the joined part of the model says of their words."""
    if rest is None:
        return docs
    key = F.xxhash64(text_of(docs, text))
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("own_id"), key.alias("own_key"), text_of(docs, text).alias("t"))
    words = own.mapInArrow(_rare(models), "own_id long, own_key long, words array<long>").select("own_id", "own_key", F.explode("words").alias("word")).distinct()
    found = cut(words.join(rest, "word").groupBy("own_id", "own_key").agg(F.collect_list(F.struct("word", "d")).alias(more)))
    on = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("own_id")) & (key == F.col("own_key"))
    return docs.join(small(found, 32 + 16 * F.size(more)), on, "left").select(*(F.col(f"`{c}`") for c in docs.columns), more)


def _score(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in batches:
            more = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            p = scorer.of(batch.column(2).to_pylist(), more)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def _keep(scorer: Scorer, column: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in batches:
            more = batch.column(width).to_pylist() if batch.num_columns > width else [None] * batch.num_rows
            p = scorer.of(batch.column(column).to_pylist(), more)
            yield batch.select(list(range(width))).filter(pa.array(p < 0.5))

    return run


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scorer = fit(docs, labels, doc_id, text, label)
    key = F.col(f"`{doc_id}`").cast("long")
    held = F.coalesce(fold(key) == HELD_OUT, F.lit(False))
    source = docs.select(key.alias("doc_id"), held.alias("held_out"), F.col(f"`{text}`").alias("text"))
    source = _with_rest(source, scorer.models, scorer.rest, "doc_id", "text", "more")
    return source.mapInArrow(_score(scorer), "doc_id long, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The documents that score below 0.5; columns as they were."""
    scorer = fit(docs, labels, doc_id, text, label)
    with_rest = _with_rest(docs, scorer.models, scorer.rest, doc_id, text, fresh("more", docs.columns))
    return with_rest.mapInArrow(_keep(scorer, docs.columns.index(text), len(docs.columns)), docs.schema)


def _models(words: DataFrame, hot_words: int) -> tuple[Models, DataFrame | None]:
    """The models of a (checkpointed) table of counts by word: the broadcast part and the rest, if there is one.

    ``words``: word, n (tokens), n_plain, and continuation counts c_toxic, c_plain and c_both.
    """
    total = words.agg(*(F.sum(c).cast("double").alias(c) for c in ("c_toxic", "c_plain", "c_both")), *(F.sum(F.greatest(F.col(f"c_{c}") - DISCOUNT, F.lit(0.0))).alias(f"over_{c}") for c in ("toxic", "plain"))).first()
    rest = {c: 1 - total[f"over_{c}"] / total[f"c_{c}"] for c in ("toxic", "plain")}

    def p(c: str) -> Column:
        return F.greatest(F.col(f"c_{c}") - DISCOUNT, F.lit(0.0)) / total[f"c_{c}"] + rest[c] * F.col("c_both") / total["c_both"]

    seen = words.filter(F.greatest("c_toxic", "c_plain") > DISCOUNT).select("word", "n", "n_plain", F.log(p("toxic") / p("plain")).alias("d"))
    said = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("n_plain").alias("plain"), F.sum(F.col("n_plain") * F.col("d")).alias("d")).first()
    hot, others = seen, None
    if said["n"] > hot_words:
        # The least frequency of which at most hot_words words are; frequencies by powers of two, so a few dozen rows.
        ranks = sorted(((r["k"], r["m"]) for r in seen.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
        least, have = ranks[0][0] + 1, 0
        for k, m in ranks:
            if have + m > hot_words:
                break
            least, have = k, have + m
        hot, others = seen.filter(F.floor(F.log2("n")) >= least), cut(seen.filter(F.floor(F.log2("n")) < least).select("word", F.col("d").cast("float").alias("d")))
    table = hot.select("word", F.col("d").cast("float").alias("d")).toArrow()
    usual = (said["d"] or 0.0) / max(1, said["plain"] or 0)
    return Models(table.column("word").to_numpy(), table.column("d").to_numpy(), float(np.log(rest["toxic"] / rest["plain"])), float(usual)), others


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Models and regression learned from the labelled of ``docs``.

    ``labels`` has doc_id and ``label`` (0 or 1).
    """
    spark = docs.sparkSession
    tune(spark)
    teach = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    marks = labels.select(F.col(f"`{doc_id}`").cast("long").alias("marked"), F.col(f"`{label}`").alias("label")).filter("marked is not null and label is not null")
    marks = cut(marks.groupBy("marked").agg((F.avg("label") >= 0.5).cast("int").alias("label")).withColumn("fold", fold(F.col("marked"))).filter(F.col("fold") != HELD_OUT))
    sizes = {(r["fold"], r["label"]): r["n"] for r in marks.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, all_ = sum(n for (_, y), n in sizes.items() if y), sum(sizes.values())
    constant = toxic / max(1, all_)
    share = min(1.0, FIT_ROWS / max(1, sum(n for (f, _), n in sizes.items() if f == CALIBRATES)))
    fits_on = (F.col("fold") == CALIBRATES) & (F.pmod(F.xxhash64("marked"), F.lit(1 << 20)) < int(share * (1 << 20)))
    with_label = teach.join(small(marks, 32), F.col("doc_id") == F.col("marked"))
    if not 0 < toxic < all_:
        return Scorer(float(constant))
    counted = with_label.filter(~fits_on).select("text", "label").mapInArrow(_count, "word long, before long, toxic int, plain int")
    pairs = counted.groupBy("word", "before").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    words = cut(
        pairs.groupBy("word").agg(
            F.sum(F.col("toxic") + F.col("plain")).alias("n"),
            F.sum("plain").alias("n_plain"),
            F.sum((F.col("toxic") > 0).cast("long")).alias("c_toxic"),
            F.sum((F.col("plain") > 0).cast("long")).alias("c_plain"),
            F.count(F.lit(1)).alias("c_both"),
        )
    )
    have = words.agg(F.max("c_toxic").alias("toxic"), F.max("c_plain").alias("plain")).first()
    if not have["toxic"] or not have["plain"]:  # no words of one class
        return Scorer(float(constant))
    model, rest = _models(words, HOT_WORDS)
    models = spark.sparkContext.broadcast(model)
    own = with_label.filter(fits_on).select("doc_id", "text", "label")
    own = _with_rest(own, models, rest, "doc_id", "text", "more").drop("doc_id")
    seen = own.mapInArrow(_features(models), "a double, b double, c double, d double, label int").toArrow()
    x = np.column_stack([seen.column(c).to_numpy() for c in "abcd"]) if seen.num_rows else np.empty((0, 4))
    y = seen.column("label").to_numpy().astype(float) if seen.num_rows else np.empty(0)
    if len(set(y.tolist())) < 2:  # too few rows to fit on: evidence per word against an even chance
        fitted = (np.zeros(4), np.ones(4), np.array([np.log((constant + 1e-6) / (1 - constant + 1e-6)), 0.0, 1.0, 0.0, 0.0]))
    else:
        fitted = fit_logistic(x, y)
    return Scorer(float(constant), models, fitted, rest)
