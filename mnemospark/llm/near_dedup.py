"""Near-duplicate documents by banded MinHash and odd sketches.

1. One pass over the texts gives, per document, the size and a 128-bit digest
   of its shingle set, 256 MinHash samples, of which 128 are 32 band hashes of
   4, and the odd sketch of all samples: a bitmap in which every sample flips
   one bit. Two sketches' XOR population count estimates the samples that differ.
2. Documents with equal sets are one class; only classes go on.
3. In each band bucket all classes are compared with the bucket's pivot, the
   class that shares most with others (of large buckets, each part has a pivot
   and the parts' pivots have one). Sketches drop hopeless pairs, the rest is
   confirmed on the full sets. Linked classes become components.
4. Buckets that still hold several components choose other pivots as long as
   many pairs remain and each turn leaves fewer; then the remaining pairs across
   components are compared inside the join, by sketch and then by set, each in
   its first shared band only. A bucket is cut into blocks of ``PART`` rows and
   each pair of blocks is a key of its own, so a large bucket is many tasks'
   work. So no link that shares a bucket is missed, and no group's pairs are
   all written out: within a component no further pair needs looking at.

At a similarity of 0.75 a pair shares no band with a probability below 1e-5.

Defined cases: a text without words has an empty set and is linked with
nothing; fewer words than a shingle are one shingle; repeated rows and rows
that share an id are one document; a null id takes part as a copy only and is
kept if nothing else has its set; ties go to the smallest id; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import cut, fresh, small, text_of, tune
from mnemospark.llm.components import components
from mnemospark.llm.words import claim, mix, shingle_set

SAMPLES, BANDS, ROWS = 256, 32, 4
SKETCH_BITS = 1024
#: Most bits in which two sketches may differ. At 0.75 a quarter of the samples differs, which flips
#: 113 bits with a deviation of 12; 168 is four and a half deviations above that.
MOST_FLIPS = 168
#: Rows of a bucket that share one pivot, and that make one block of the residual comparison.
PART = 4096
#: The residual comparison starts when it has at most so many pairs for each row of the buckets.
PAIRS_PER_ROW = 2048
#: Another turn of pivots is taken while a turn leaves at most this share of the pairs.
PAYS = 0.8
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
SIGNATURES = "doc_id long, key long, n int, d1 long, d2 long, " + ", ".join(f"{s} long" for s in SKETCH) + ", bands array<long>"


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        rng = np.random.default_rng(20240607)
        mult = rng.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1)
        add = rng.integers(0, 2**32, SAMPLES, np.uint32)
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int32)
            full = np.flatnonzero(sizes)
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            sketch = np.zeros((len(sets), SKETCH_BITS // 64), np.uint64)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            if len(full):
                x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                mins = np.empty((SAMPLES, len(full)), np.uint64)
                for j in range(SAMPLES):
                    mins[j] = np.minimum.reduceat(x * mult[j] + add[j], starts)
                tagged = mix(mins + (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32))[:, None])
                for j in range(SAMPLES):
                    bit = tagged[j] % np.uint64(SKETCH_BITS)
                    sketch[full, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
                grouped = tagged[: BANDS * ROWS].reshape(BANDS, ROWS, -1)
                key = grouped[:, 0].copy()
                for r in range(1, ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, r])
                bands[full] = key.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
            columns = [batch.column(0), batch.column(2), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *(pa.array(sketch[:, k].view(np.int64)) for k in range(len(SKETCH))), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "d1", "d2", *SKETCH, "bands"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        kept: dict[int, np.ndarray] = {}

        def of(doc: int, text: str) -> np.ndarray:
            if doc not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[doc] = shingle_set(text, width)
            return kept[doc]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for x, y, s, t in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = shingle_set(s, width), of(y, t)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "linked"])

    return run


def _flips(left: str, right: str) -> Column:
    """The bits in which two sketches differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(left + s).bitwiseXOR(F.col(right + s))) for s in SKETCH))


def _with_pivots(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a class and its part's pivot, and of the parts' pivots and their bucket's, that sketches allow.

    The pivot comes with its sketch from a window, so no join makes the pairs;
    a part has about ``PART`` rows at most, however large its bucket is.
    """
    score = F.col("degree") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    top = F.struct(score.alias("o"), (-F.col("rep")).alias("i"), "component", *SKETCH)
    parts = F.ceil(F.col("size") / PART)
    dealt = members.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(-1)), parts)).withColumn("p", F.max(top).over(Window.partitionBy("bucket", "part")))
    heads = dealt.filter((F.col("size") > PART) & (F.col("rep") == -F.col("p.i"))).withColumn("p", F.max("p").over(Window.partitionBy("bucket")))
    rows = dealt.select("rep", "component", *SKETCH, "p").unionByName(heads.select("rep", "component", *SKETCH, "p"))
    return rows.filter((F.col("component") != F.col("p.component")) & (_flips("", "p.") <= MOST_FLIPS)).select(F.col("rep").alias("a"), (-F.col("p.i")).alias("b")).distinct()


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of some documents; the others are dropped before any shuffle while the ids are few enough."""
    ids = cut(ids.select(F.col("doc_id").alias("_id")).distinct())
    return texts.join(small(ids, 32), F.col("doc_id") == F.col("_id"), "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a and b of the (checkpointed) pairs whose full sets are similar."""
    needed = _texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), texts)
    one = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    beside = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return cut(beside.mapInArrow(_confirm(width, percent), "a long, b long, linked boolean")).filter("linked").select("a", "b")


def _short_sets(width: int):
    """Sets of 32 bits of each shingle's hash, and the full sets' sizes; shingles that fall together leave a set smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for batch in batches:
            full = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            sets = [np.unique(s.astype(np.uint32)).view(np.int32) for s in full]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([len(s) for s in full], pa.int32())], ["rep", "set", "n"])

    return run


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    return _find(docs, doc_id, text, width, percent).drop("key")


def _find(docs: DataFrame, doc_id: str, text: str, width: int = 5, percent: int = 75) -> DataFrame:
    """The same with ``key``, the hash of the row's text."""
    tune(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    signed = cut(source.withColumn("key", F.xxhash64("text")).mapInArrow(_signatures(width), SIGNATURES))
    # The sketch and the bands follow from the set, so as grouping keys they need no aggregate of their own.
    classes = signed.filter("n > 0").groupBy("d1", "d2", "n", *SKETCH, "bands").agg(F.min("doc_id").alias("rep"))
    classes = cut(classes)
    sketches = classes.filter("rep is not null").select("rep", *SKETCH)
    rows = classes.filter("rep is not null").select("rep", F.explode_outer("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(rows.join(shared, "bucket").select("bucket", "rep", "size"))
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    # What the pivots and the residual comparison need, once per row of a bucket.
    members = cut(members.join(sketches.join(degree, "rep"), "rep").withColumn("component", F.col("rep")))
    links, active = None, members
    turn, before = 0, None
    while True:
        new = _confirmed(cut(_with_pivots(active, turn)), source, width, percent)
        links = new if links is None else links.union(new)
        found = components(links)
        named = members.drop("component").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        parts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("bucket").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("within"), F.count(F.lit(1)).alias("parts"))
        split = cut(parts.filter("parts > 1"))
        left = split.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2), F.lit(0)).alias("pairs"), F.coalesce(F.sum("all"), F.lit(0)).alias("rows")).first()
        active = named.drop("size").join(split.select("bucket", F.col("all").alias("size")), "bucket")
        if left["pairs"] <= PAIRS_PER_ROW * left["rows"] or (before is not None and left["pairs"] > PAYS * before):
            break
        turn, before = turn + 1, left["pairs"]
    if left["pairs"]:
        bands = classes.filter("rep is not null").select("rep", "bands")
        active = cut(active.join(bands, "rep").withColumn("band", F.array_position("bands", F.col("bucket")).cast("int")).select("bucket", "rep", "component", "size", *SKETCH, "bands", "band"))
        sets = cut(_texts_of(active.select(F.col("rep").alias("doc_id")), source).mapInArrow(_short_sets(width), "rep long, set array<int>, n int"))
        # A row meets the rows of every block of its bucket, in the pair of both blocks' numbers.
        blocks = F.ceil(F.col("size") / PART).cast("int")
        active = active.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(-2)), blocks).cast("int"))
        active = active.join(sets, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        active = active.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "size")
        x, y = active.alias("x"), active.alias("y")
        # Two classes that met in an earlier band are compared there.
        earlier = F.exists(F.zip_with(F.slice("x.bands", 1, F.col("x.band") - 1), F.slice("y.bands", 1, F.col("x.band") - 1), lambda s, t: s == t), lambda same: same)
        same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
        met = same & ((F.col("x.low") == F.col("x.high")) | (F.col("x.block") != F.col("y.block"))) & (F.col("x.component") < F.col("y.component")) & (_flips("x.", "y.") <= MOST_FLIPS) & ~earlier
        # 100 i >= p (n + m - i), put so that the intersection is taken once; what fell together in x counts as shared.
        shared = F.size(F.array_intersect("x.set", "y.set")) + F.col("x.n") - F.size("x.set")
        alike = shared * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
        across = cut(x.join(y, met & alike).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
        links = links.union(_confirmed(across, source, width, percent))
        found = components(links)
    by_class = classes.select("d1", "d2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "key", "n", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are near copies of one with a smaller id; columns as they were."""
    names = [fresh("id", docs.columns), fresh("key", docs.columns)]
    dropped = _find(docs, doc_id, text).filter("not kept").select(F.col("doc_id").alias(names[0]), F.col("key").alias(names[1])).distinct()
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])) & (F.xxhash64(text_of(docs, text)) == F.col(names[1]))
    return docs.join(small(cut(dropped), 40), same, "left_anti")
