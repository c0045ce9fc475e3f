"""Quality classifier: a sparse ensemble of rules over statistics of a text.

1. Statistics of every text are Spark column expressions (``statistics``).
2. A random forest is grown on the labelled rows' statistics. The path from its
   root to each node of a tree is a rule: a conjunction of comparisons, at most
   one lower and one upper bound for each statistic; equal rules of several trees
   are one.
3. Rules become 0/1 features of a logistic regression with a lasso penalty,
   which leaves few of them a weight. Of ``PENALTIES`` the one with the least
   log-loss on a fold that neither trees nor weights saw is taken.
4. What has a weight is compiled into one column expression: the sum of the
   weights of the rules that hold, brought to a probability. Scoring is a
   projection; no model is shipped and no Python worker runs.

Growing and weighing are distributed jobs over the checkpointed statistics of
the labelled rows: at most ``TRAIN_ROWS`` of them, chosen by a hash of the id (a
bounded sample of labels; statistics and scores are of all rows). The fold
crc32(doc_id) mod 5 = 0 is held out, fold 1 chooses the penalty.

Defined cases: a null or empty text has the statistics of no words and scores by
them; several labels of one doc_id count by majority, ties as good; a null id or
label teaches nothing and is not held out; repeated rows give repeated rows;
without labels of both classes every score is the share of good labels (0 if
there are none), and so it is where no tree finds a split; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import SPACE_CLASS, cut, small, text_of, tune

FOLDS, HELD_OUT, CHOOSES = 5, 0, 1
#: Labelled rows that are learned from, at most.
TRAIN_ROWS = 200_000
TREES, DEPTH, BINS, SEED = 24, 3, 48, 17
#: Lasso penalties that are tried.
PENALTIES = (0.01, 0.003, 0.001)
#: A document is good from this probability on.
THRESHOLD = 0.3
#: A node of fewer rows than this share makes no rule.
LEAST_SHARE = 0.002
#: Character classes.
SYMBOLS, MARKS = "#$%&*|<>~", ".,;:?"

#: A rule: bounds of statistics, as (statistic, ">" or "<=", threshold).
Rule = tuple[tuple[int, str, float], ...]


def _count(characters: str) -> Column:
    """Characters of a class in the text: what is left when all others go."""
    return F.length(F.regexp_replace("text", f"[^{characters}]+", ""))


#: Name and expression of each statistic, of a text and its words, lines and their numbers.
STATISTICS = {
    "n_words": lambda c: c["n"].cast("double"),
    "word_length": lambda c: c["letters"] / c["some"],
    "distinct_words": lambda c: F.size(F.array_distinct("words")) / F.sqrt(c["some"]),
    "short_words": lambda c: F.size(F.filter("words", lambda w: F.length(w) <= 3)) / c["some"],
    "repeated_lines": lambda c: 1 - F.size(F.array_distinct("lines")) / F.size("lines"),
    "line_words": lambda c: c["n"] / F.size("lines"),
    "capitals": lambda c: _count("A-Z") / F.greatest(c["letters"], F.lit(1)),
    "symbols": lambda c: _count(SYMBOLS) / c["some"],
    "digits": lambda c: _count("0-9") / c["some"],
    "marks": lambda c: _count(MARKS) / c["some"],
    "exclamations": lambda c: (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))) / c["some"],
}


def statistics(source: DataFrame) -> DataFrame:
    """``source`` with its column ``text`` (not null) replaced by an array ``stats`` of the statistics."""
    parts = source.withColumn("words", F.array_remove(F.split("text", SPACE_CLASS + "+"), "")).withColumn("lines", F.split("text", "\n"))
    parts = parts.withColumn("n", F.size("words"))
    parts = parts.withColumn("letters", F.length(F.array_join("words", "")))
    c = {"n": F.col("n"), "some": F.greatest(F.col("n"), F.lit(1)), "letters": F.col("letters")}
    keep = [x for x in source.columns if x != "text"]
    return parts.select(*keep, F.array(*(f(c).cast("double") for f in STATISTICS.values())).alias("stats"))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


_IF = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(tree: str) -> list[Rule]:
    """The rule of every node but the root, from a tree's description."""
    found, open_ = [], []
    for line in tree.split("\n"):
        if m := _IF.match(line):
            depth = len(m[1])
            open_ = [x for x in open_ if x[0] < depth] + [(depth, int(m[2]), m[3], float(m[4]))]
            bounds: dict[tuple[int, str], float] = {}
            for _, k, op, at in open_:
                bounds[k, op] = (min if op == "<=" else max)(at, bounds.get((k, op), at))
            found.append(tuple(sorted((k, op, at) for (k, op), at in bounds.items())))
    return found


def holds(rule: Rule, stats: Column) -> Column:
    """Whether a rule holds, as a column expression."""
    return reduce(lambda a, b: a & b, (stats[k] <= at if op == "<=" else stats[k] > at for k, op, at in rule))


class Ensemble:
    """Rules with their weights."""

    def __init__(self, constant: float, rules: list[tuple[Rule, float]] | None = None, bias: float = 0.0):
        self.constant, self.rules, self.bias = constant, rules or [], bias

    def score(self, stats: Column) -> Column:
        """The probability that a text is good, as one column expression."""
        if not self.rules:
            return F.lit(float(self.constant))
        z = reduce(lambda a, b: a + b, (F.when(holds(r, stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules), F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        """The rules in words, the heaviest first."""
        names = list(STATISTICS)
        return [f"{w:+.3f} if " + " and ".join(f"{names[k]} {op} {at:.6g}" for k, op, at in r) for r, w in sorted(self.rules, key=lambda x: (-abs(x[1]), x[0]))]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Ensemble:
    """The ensemble learned from the labelled of ``docs`` outside the held-out fold."""
    tune(docs.sparkSession)
    marks = labels.select(F.col(f"`{doc_id}`").cast("long").alias("marked"), F.col(f"`{label}`").alias("label")).filter("marked is not null and label is not null")
    marks = cut(marks.groupBy("marked").agg((F.avg("label") >= 0.5).cast("double").alias("label")).withColumn("fold", fold(F.col("marked"))).filter(F.col("fold") != HELD_OUT))
    n, good = marks.agg(F.count(F.lit(1)), F.sum("label")).first()
    constant = (good or 0) / max(1, n)
    if not 0 < constant < 1:
        return Ensemble(constant)
    share = min(1.0, rows / n)
    chosen = marks.filter(F.pmod(F.xxhash64("marked"), F.lit(1 << 20)) < int(share * (1 << 20)))
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    known = source.join(small(cut(chosen), 32), F.col("doc_id") == F.col("marked")).select("text", "label", "fold")
    table = cut(statistics(known))
    learn, choose = table.filter(F.col("fold") != CHOOSES), table.filter(F.col("fold") == CHOOSES)
    n_learn, n_good = learn.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not 0 < (n_good or 0) < n_learn:
        return Ensemble(constant)
    forest = RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, minInstancesPerNode=max(1, int(LEAST_SHARE * n_learn)), featureSubsetStrategy="onethird", seed=SEED)
    model = forest.fit(learn.select(array_to_vector("stats").alias("x"), "label"))
    found = sorted({r for t in model.trees for r in paths(t.toDebugString)})
    if not found:
        return Ensemble(constant)

    def features(part: DataFrame) -> DataFrame:
        return part.select(array_to_vector(F.array(*(holds(r, F.col("stats")).cast("double") for r in found))).alias("features"), "label")

    train, test = cut(features(learn)), cut(features(choose))
    best = None
    for penalty in PENALTIES:
        lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60).fit(train)
        p = F.greatest(F.least(F.element_at(_values("probability"), 2), F.lit(1 - 1e-9)), F.lit(1e-9))
        said = lasso.transform(test).agg(F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p)))).first()[0]
        if best is None or (said is not None and said < best[0]):
            best = (said if said is not None else 0.0, lasso)
    weights = best[1].coefficients.toArray().tolist()
    return Ensemble(constant, [(r, w) for r, w in zip(found, weights, strict=True) if w], float(best[1].intercept)) if any(weights) else Ensemble(constant)


def _values(vector: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(vector))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", ensemble: Ensemble | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    tune(docs.sparkSession)
    ensemble = ensemble or fit(docs, labels, doc_id, text, label)
    key = F.col(f"`{doc_id}`").cast("long")
    source = docs.select(key.alias("doc_id"), F.coalesce(fold(key) == HELD_OUT, F.lit(False)).alias("held_out"), text_of(docs, text).alias("text"))
    scored = statistics(source).select("doc_id", "held_out", ensemble.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents that score 0.3 or more; columns as they were."""
    ensemble = fit(docs, labels, doc_id, text, label)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of(docs, text).alias("text"))
    return statistics(row).filter(ensemble.score(F.col("stats")) >= THRESHOLD).select("row.*")
