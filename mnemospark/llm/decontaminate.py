"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is the hash of the tokens that a fixed mask selects in a window; tokens
at the other positions may differ. Seeds of every benchmark position are joined
with seeds of every document position, so any shared stretch meets a seed at
several places. For each hit the item is laid beside the document on the hit's
diagonal, and the best stretch is scored: one for an equal token, minus two for
a substituted one. A stretch of nine equal tokens always meets a seed.

Items shorter than a mask have one seed of all their tokens, and overlap where
all of them stand in a row.

Each document is cut into tokens twice, for the seeds and (only if it was hit)
for the stretches. Seeds are broadcast while their counted bytes allow it;
beyond that they are joined through a shuffle, dealt over ``SALTS`` parts a
seed by document, so that a passage found in very many documents is no one
task's work.

Defined cases: null and empty texts and items match nothing; a row is a
document, repeated rows give one row per (doc_id, item_id); items that share an
id are compared one by one and the best counts; ties between stretches go to
the earlier one in the document; a null item_id is an item; an empty table on
either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import cut, fits, fresh, small, text_of

#: Token offsets that a mask selects; fixed values.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8))
SPAN = 9
#: A stretch of this score is an overlap; an item of ``SPAN`` tokens or more needs this share of its tokens instead, and this at least.
MIN_SCORE = 12
MIN_SHARE = 0.6
LEAST_SCORE = 8
SUBSTITUTED = -2
#: Parts that a seed's documents are dealt over where seeds are shuffled.
SALTS = 64
#: Scripts written without spaces between words: each character is a token.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, their marks and digits; single characters in scripts without spaces."""
    low = F.lower(text)
    runs = F.split(low, r"[^\p{L}\p{M}\p{N}]+")
    apart = F.split(F.regexp_replace(low, f"({UNSPACED})", " $1 "), r"[^\p{L}\p{M}\p{N}]+")
    plain = (F.length(text) == F.octet_length(text)) | ~text.rlike(UNSPACED)
    return F.array_remove(F.when(plain, runs).otherwise(apart), "")


def _seeds(hashes: str, masks: tuple[tuple[int, ...], ...], span: int) -> Column:
    """The seeds of one mask after the other, each at every position."""
    n = F.size(hashes)
    starts = F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))

    def of(mask: tuple[int, ...]) -> Column:
        named = sum(1 << o for o in mask)
        return F.transform(starts, lambda i: F.xxhash64(F.lit(named), *(F.get(F.col(hashes), i + F.lit(o)) for o in mask)))

    return F.concat(*map(of, masks))


def _exploded(hashed: DataFrame, keys: list[str], masks: tuple[tuple[int, ...], ...] = MASKS, span: int = SPAN) -> DataFrame:
    """keys, seed and at (position in the text); ``hashed`` has the tokens' hashes."""
    seeded = hashed.select(*keys, _seeds("hashes", masks, span).alias("seeds")).withColumn("per_mask", (F.size("seeds") / len(masks)).cast("int"))
    # The outer form: for the inner one the optimizer adds a filter that computes every seed once more.
    rows = seeded.select(*keys, "per_mask", F.posexplode_outer("seeds").alias("n", "seed")).filter(F.col("n").isNotNull())
    return rows.select(*keys, "seed", (F.col("n") % F.col("per_mask")).alias("at"))


def _hits(hashed: DataFrame, items: DataFrame) -> DataFrame:
    """id, key, item, n_item and shift (document position of the item's first token) where a seed is shared."""
    long = items.filter(F.col("n_item") >= SPAN)
    sets = [(long, MASKS, SPAN)]
    for n in sorted(r["n_item"] for r in items.filter((F.col("n_item") > 0) & (F.col("n_item") < SPAN)).select("n_item").distinct().collect()):
        sets.append((items.filter(F.col("n_item") == n), (tuple(range(n)),), n))  # SPAN - 1 lengths at most
    found = None
    for some, masks, span in sets:
        theirs = cut(_exploded(some, ["item", "n_item"], masks, span).withColumnRenamed("at", "item_at"))
        own = _exploded(hashed, ["id", "key"], masks, span)
        if fits(theirs, 40):
            pairs = own.join(F.broadcast(theirs), "seed")
        else:
            dealt = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pairs = own.withColumn("salt", F.pmod(F.xxhash64("key", "id"), F.lit(SALTS)).cast("int")).join(dealt, ["seed", "salt"])
        hits = pairs.select("id", "key", "item", "n_item", (F.col("at") - F.col("item_at")).alias("shift"))
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def _stretch(same: Column) -> Column:
    """The best stretch of an array of equal or not: its score, equal tokens, start and end."""
    zero = F.struct(*(F.lit(0).alias(x) for x in ("at", "cur", "start", "same", "best", "from", "to", "equal")))

    def step(a: Column, equal: Column) -> Column:
        cur = a["cur"] + F.when(equal, 1).otherwise(SUBSTITUTED)
        begun = F.when(a["cur"] == 0, a["at"]).otherwise(a["start"])
        n = F.when(a["cur"] == 0, 0).otherwise(a["same"]) + equal.cast("int")
        better = cur > a["best"]
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.greatest(cur, F.lit(0)).alias("cur"),
            begun.alias("start"),
            n.alias("same"),
            F.when(better, cur).otherwise(a["best"]).alias("best"),
            F.when(better, begun).otherwise(a["from"]).alias("from"),
            F.when(better, a["at"] + 1).otherwise(a["to"]).alias("to"),
            F.when(better, n).otherwise(a["equal"]).alias("equal"),
        )

    return F.aggregate(same, zero, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, n_equal, doc_start, doc_end, item_start and item_end (tokens) of each overlap.

    Only documents that overlap an item are returned, one row per item.
    """
    found = _overlaps(docs, benchmark, doc_id, text, item_id, item_text)
    best = found.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.score").alias("score"),
        F.col("b.equal").alias("n_equal"),
        (-F.col("b.early")).alias("doc_start"),
        (F.col("b.to") - F.col("b.from") - F.col("b.early")).alias("doc_end"),
        F.col("b.from").alias("item_start"),
        F.col("b.to").alias("item_end"),
    )


def _once(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``keys`` and ``value``, computed once a row: the optimizer does not copy an expression out of a generator."""
    return df.select(*keys, F.explode_outer(F.array(value)).alias(name))


def _overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, key (the text's hash), item_id and the best stretch on each diagonal that is an overlap."""
    whole = text_of(docs, text)
    d = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(whole).alias("key"), whole.alias("text"))
    b = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), tokens(text_of(benchmark, item_text)).alias("theirs")).distinct()
    b = cut(b.withColumns({"item": F.xxhash64("item_id", "theirs"), "n_item": F.size("theirs"), "hashes": F.transform("theirs", lambda t: F.xxhash64(t))}))
    hits = cut(_hits(d.withColumn("hashes", F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t))), b))
    by_doc = cut(hits.groupBy(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).agg(F.collect_list(F.struct("item", "n_item", "shift")).alias("hits")))
    hit = d.join(small(by_doc, 32 + 24 * F.size("hits")), (F.col("key") == F.col("hit_key")) & F.col("id").eqNullSafe(F.col("hit_id")))
    hit = _once(hit, ["id", "key", "hits"], tokens(F.col("text")), "ours")
    # Of the document, only the tokens that stand beside the item go on.
    beside = F.transform("hits", lambda h: F.struct(h["item"].alias("item"), h["shift"].alias("shift"), F.slice("ours", F.greatest(h["shift"], F.lit(0)) + 1, h["n_item"] - F.greatest(-h["shift"], F.lit(0))).alias("ours")))
    rows = hit.select("id", "key", F.explode_outer(beside).alias("h")).select("id", "key", "h.*")
    items = b.select(F.col("item").alias("own_item"), "item_id", "theirs")
    rows = rows.join(small(items, 32 + 24 * F.size("theirs") + F.length(F.array_join("theirs", ""))), F.col("item") == F.col("own_item"))
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    same = F.zip_with("ours", F.slice("theirs", skipped + 1, F.size("ours")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    keys = ["id", "key", "item_id", "shift", F.size("theirs").alias("n_item"), skipped.alias("skipped")]
    scored = _once(rows, keys, _stretch(same), "s")
    enough = F.when(F.col("n_item") < SPAN, F.col("n_item")).otherwise(F.least(F.lit(float(MIN_SCORE)), F.greatest(F.lit(float(LEAST_SCORE)), MIN_SHARE * F.col("n_item"))))
    start, end = F.col("s.from") + F.col("skipped"), F.col("s.to") + F.col("skipped")
    best = F.struct(F.col("s.best").alias("score"), (-(start + F.col("shift"))).alias("early"), F.col("s.equal").alias("equal"), start.alias("from"), end.alias("to"))
    return scored.filter(F.col("s.best") >= enough).select(F.col("id").alias("doc_id"), "key", "item_id", best.alias("b"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that overlap no item; columns as they were. Rows that share an id, or have none, are told apart by their text."""
    names = [fresh("id", docs.columns), fresh("key", docs.columns)]
    hits = cut(_overlaps(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(names[0]), F.col("key").alias(names[1])).distinct())
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])) & (F.xxhash64(text_of(docs, text)) == F.col(names[1]))
    return docs.join(small(hits, 40), same, "left_anti")
