"""Complete-linkage clusters of banks of any size.

Clusters that are each other's nearest merge, all of them in one round: with
complete linkage no merge elsewhere brings anything nearer, so this gives what
merging the nearest pair of all, one at a time, gives. No pairs are kept: a
cluster knows its nearest one, and seeks it again, among the vectors, when either
of them has merged. A cluster with none within the cut is done. A bank of up to
``ALONE`` rows is one task's work, with memory that grows with its rows; in a
larger one the nearest clusters are sought by many tasks until what is not done
is small enough (``dealt``). How a bank is dealt changes nothing.

Distances are cosine distances rounded to nine digits; of equal ones the pair
with the smaller ids comes first, everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import Rewritten, checkpointed

#: Rows that a cell has about, and rows of a block of a cell.
CELL, BLOCK = 1000, 1024
#: Rows, and bytes of their vectors, that one task clusters; rows of a block that seek, or are sought by, the nearest clusters.
ALONE, ALONE_BYTES, WIDE = 40_960, 20 << 20, 8192
#: Products that a task holds at a time while it seeks, and members of a cluster that are compared one by one.
PRODUCTS, RANKS = 1 << 19, 16
#: Cells a row may be a guest in on average; beyond that cells spare too little.
SPREAD = 8
#: Bytes of pivots that go to every worker; of more, cells are made larger.
PIVOT_BYTES = 24 << 20
PAIRS = "of string, a long, b long, d double"


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    m = np.asarray(vectors, float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def complete_linkage(vectors: np.ndarray, cut: float) -> np.ndarray:
    """Labels of agglomerative clusters: complete linkage on cosine distance, cut at ``cut``."""
    n = len(vectors)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    d = np.round(1 - unit @ unit.T, 9)
    np.fill_diagonal(d, np.inf)
    label = np.arange(n)
    if n < 2:
        return label
    nearest = d.argmin(1)
    gap = d[label, nearest]  # of each cluster to its nearest one; only a merge changes it
    while True:
        i = int(np.argmin(gap))
        j = int(nearest[i])
        if gap[i] > cut:  # also when one cluster is left, which has none
            return label
        i, j = min(i, j), max(i, j)
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        label[label == label[j]] = label[i]
        again = np.flatnonzero((nearest == i) | (nearest == j) | np.isin(np.arange(n), (i, j)))
        nearest[again] = d[again].argmin(1)
        gap[again] = d[again, nearest[again]]


def _homes(pivots):
    """The cell of each row: its nearest pivot, and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, node, v = (c.to_pylist() for c in batch.columns)
            home, angle = [0] * len(of), [0.0] * len(of)
            for b, rows in _by(of).items():
                if (p := pivots.value.get(b)) is not None:
                    c = _unit([v[k] for k in rows]) @ p.T
                    best = c.argmax(1)
                    for k, h, x in zip(rows, best.tolist(), np.arccos(np.clip(c.max(1), -1, 1)).tolist(), strict=True):
                        home[k], angle[k] = h, x
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(home, pa.int32()), pa.array(angle)], ["of", "node", "v", "home", "angle"])

    return run


def _by(keys: list) -> dict:
    found: dict = {}
    for k, x in enumerate(keys):
        found.setdefault(x, []).append(k)
    return found


def _guests(pivots, radii, theta: float):
    """The cells in which a row may have a neighbour: by the triangle inequality no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, v, home = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cells: list[list[int]] = [[h] for h in home]
            for b, rows in _by(of).items():
                if (p := pivots.value.get(b)) is not None:
                    angle = np.arccos(np.clip(_unit([v[k] for k in rows]) @ p.T, -1, 1))
                    near = angle <= radii.value[b] + theta + 1e-6
                    for k, ok in zip(rows, near, strict=True):
                        cells[k] = sorted({home[k], *np.flatnonzero(ok).tolist()})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(cells, pa.list_(pa.int32()))], ["of", "node", "v", "home", "cells"])

    return run


def numbers(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, without a Python object for each number."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(flat), -1)


def _pairs(cut: float):
    """Pairs within the cut of a block of a cell's own rows and a block of all rows in it, from the smaller id."""

    def run(own: pa.Table, all_: pa.Table) -> pa.Table:
        if not len(own) or not len(all_):
            return pa.Table.from_pydict({"of": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        a, b = own.column("node").to_numpy(), all_.column("node").to_numpy()
        d = np.round(1 - _unit(numbers(own.column("v"))) @ _unit(numbers(all_.column("v"))).T, 9)
        i, j = np.nonzero((d <= cut) & (a[:, None] < b[None, :]))
        of = pa.repeat(own.column("of")[0], len(i))
        return pa.Table.from_arrays([of, pa.array(a[i]), pa.array(b[j]), pa.array(d[i, j])], ["of", "a", "b", "d"])

    return run


def _cells(points: DataFrame, cut: float, cell: int) -> DataFrame:
    """of, node, v, home (a row's own cell) and cells (all in which it may have a neighbour)."""
    spark = points.sparkSession
    total, width = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    cell = max(cell, -(-total * 8 * (width or 1) // PIVOT_BYTES))
    large = points.groupBy("of").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    chosen = points.filter(F.pmod(F.xxhash64("node"), F.lit(cell)) == 0).join(large, "of").select("of", "v")
    pivots: dict[str, list] = {}
    for r in chosen.collect():  # about one in ``cell`` rows
        pivots.setdefault(r["of"], []).append(r["v"])
    shared = spark.sparkContext.broadcast({b: _unit(v) for b, v in pivots.items()})
    homes = checkpointed(points.select("of", "node", "v").mapInArrow(_homes(shared), "of string, node long, v array<double>, home int, angle double"))
    reach = {b: np.full(len(v), -np.inf) for b, v in pivots.items()}
    for r in homes.filter(F.col("of").isin(list(pivots))).groupBy("of", "home").agg(F.max("angle").alias("angle")).collect() if pivots else []:
        reach[r["of"]][r["home"]] = r["angle"]
    theta = float(np.arccos(np.clip(1 - cut, -1, 1)))
    return homes.select("of", "node", "v", "home").mapInArrow(_guests(shared, spark.sparkContext.broadcast(reach), theta), "of string, node long, v array<double>, home int, cells array<int>")


def within(points: DataFrame, cut: float, cell: int = CELL, block: int = BLOCK, asks: DataFrame | None = None) -> DataFrame:
    """of, a, b and d of every pair a < b of a bank whose distance is at most ``cut``, each once; with ``asks`` (of, node) those whose a is in it.

    points (checkpointed): of (bank), node, v (not zero). A bank of more than
    ``cell`` rows has a pivot for each ``cell`` of them; a row's home is the cell
    of its nearest pivot, and it is a guest in every cell whose radius it may
    reach. Own rows and all rows of a cell are dealt into blocks, and a pair of
    blocks is one matrix product, so no cell is one task's work.
    """
    placed = checkpointed(_cells(points, cut, cell).select("of", "node", "v", "home", F.explode("cells").alias("cell")))
    owns = F.col("home") == F.col("cell")
    if asks is not None:
        placed = checkpointed(placed.join(asks.select("of", "node", F.lit(True).alias("asks")), ["of", "node"], "left"))
        owns = owns & F.col("asks")
    sizes = placed.groupBy("of", "cell").agg(F.ceil(F.count_if(owns) / block).cast("int").alias("n_own"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_all"))

    def dealt(rows: DataFrame, n: str, name: str) -> DataFrame:
        return rows.join(sizes.filter("n_own > 0"), ["of", "cell"]).withColumn(name, F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = ["of", "cell", "own", "all"]
    own = dealt(placed.filter(owns), "n_own", "own").withColumn("all", upto("n_all")).select(*(F.col(c).alias(c) for c in (*met, "node", "v")))
    all_ = dealt(placed, "n_all", "all").withColumn("own", upto("n_own")).select(*met, "node", "v")
    # A worker holds one pair of blocks at a time.
    return own.groupBy(*met).cogroup(all_.groupBy(*met)).applyInArrow(_pairs(cut), PAIRS)


def _ranked(cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters, largest first, their sizes, and the rows' order for ``_least``: every cluster's first row, then the second ones and so on, those beyond ``RANKS`` by cluster."""
    ids, at, size = np.unique(cluster, return_inverse=True, return_counts=True)
    by = np.argsort(-size, kind="stable")
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    ids, size = ids[by], size[by]
    rows = np.argsort(place[at], kind="stable")
    rank = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    return ids, size, rows[np.argsort(np.minimum(rank, RANKS), kind="stable")]


def _least(cos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of each cluster's columns, which stand in the order of ``_ranked``."""
    at = len(size)
    out = cos[:, :at]
    for rank in range(1, RANKS + 1):
        m = int(np.count_nonzero(size > rank))
        if not m:
            break
        if rank < RANKS:
            more, at = cos[:, at : at + m], at + m
        else:
            more = np.minimum.reduceat(cos[:, at:], np.cumsum(size[:m] - RANKS) - (size[:m] - RANKS), axis=1)
        np.minimum(out[:, :m], more, out=out[:, :m])
    return out


def _nearest(own: np.ndarray, mine: np.ndarray, all_: np.ndarray, theirs: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the clusters ``mine`` of the rows ``own`` that have another of ``theirs`` within the cut, the nearest one, and its distance."""
    ids, size, order = _ranked(theirs)
    columns = np.ascontiguousarray(all_[order].T)
    known = np.argsort(ids)
    asking, n, _ = _ranked(mine)
    itself = known[np.minimum(np.searchsorted(ids, asking, sorter=known), len(ids) - 1)]
    place = np.empty(len(n), np.int64)
    place[np.argsort(asking)] = np.arange(len(n))
    rows = np.argsort(np.argsort(place)[np.searchsorted(np.sort(asking), mine)], kind="stable")
    upto, step, k, found = np.cumsum(n), max(1, PRODUCTS // len(theirs)), 0, []
    while k < len(asking):
        first = upto[k] - n[k]
        end = max(k + 1, int(np.searchsorted(upto, first + step, "right")))
        part, sizes = rows[first : upto[end - 1]], n[k:end]
        if end == k + 1:  # its rows may be more than a step
            cos = reduce(np.minimum, ((own[part[x : x + step]] @ columns).min(0) for x in range(0, len(part), step)))[None]
        else:
            cos = _least((own[part[_ranked(np.repeat(np.arange(end - k), sizes))[2]]] @ columns).T, sizes).T
        cos = _least(cos, size)
        x = np.flatnonzero(ids[itself[k:end]] == asking[k:end])
        cos[x, itself[k:end][x]] = -2
        # Rounding decides among those that are nearly the best.
        i, j = np.nonzero(cos >= np.maximum(cos.max(1), 1 - cut)[:, None] - 3e-9)
        d, near = np.round(1 - cos[i, j], 9), ids[j]
        best = np.lexsort((near, d, i))
        best = best[(np.diff(i[best], prepend=-1) > 0) & (d[best] <= cut)]
        found.append((asking[k:end][i[best]], near[best], d[best]))
        k = end
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


def linked(rows: np.ndarray, label: np.ndarray, cut: float) -> np.ndarray:
    """Complete linkage of rows of unit length from the clusters ``label`` on, each named by the place of its first row."""
    n = len(rows)
    near, gap, seeks = np.full(n, -1), np.full(n, np.inf), np.zeros(n, bool)
    live = np.zeros(n, bool)
    live[label] = seeks[label] = True
    while seeks.any():
        there = np.flatnonzero(live[label])
        own = there[seeks[label[there]]]
        who, whom, d = _nearest(rows[own], label[own], rows[there], label[there], cut)
        near[seeks] = -1
        near[who], gap[who] = whom, d
        live[seeks & (near < 0)] = False
        of = np.flatnonzero(live)
        a = of[(near[near[of]] == of) & (of < near[of])]
        if not len(a) and len(of):  # of one pair two products may differ in the last digit
            a = of[np.lexsort((np.maximum(of, near[of]), np.minimum(of, near[of]), gap[of]))[:1]]
        a, b = np.minimum(a, near[a]), np.maximum(a, near[a])
        to, merged = np.arange(n), np.zeros(n, bool)
        to[b] = a
        merged[a] = merged[b] = True
        label, live[b] = to[label], False
        seeks = live & (merged | merged[near])
    return label


def _sought(cut: float):
    """The nearest clusters of a block, for the clusters of another; only those all of whose rows came."""

    def run(own: pa.Table, all_: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if len(own) and len(all_):
            theirs = all_.column("cluster").to_numpy()
            _, at, n = np.unique(theirs, return_inverse=True, return_counts=True)
            whole = np.flatnonzero(n[at] == all_.column("size").to_numpy())
            if len(whole):
                found = _nearest(_unit(numbers(own.column("v"))), own.column("cluster").to_numpy(), _unit(numbers(all_.column("v"))[whole]), theirs[whole], cut)
        of = pa.repeat(own.column("of")[0], len(found[0])) if len(own) else pa.array([], pa.string())
        return pa.Table.from_arrays([of, *map(pa.array, found)], ["of", "cluster", "near", "d"])

    return run


def dealt(points: DataFrame, cut: float, most: int) -> DataFrame:
    """of, node, cluster and live: rounds of merges by many tasks, until no bank has more than ``most`` rows in clusters that may merge further.

    points (checkpointed): of, node, v. A cluster seeks in the cell of its first
    row, where all rows within the cut of that row are guests. Both sides are
    dealt into blocks by cluster, so a cluster is whole in its block. Where rows
    are guests in many cells, as vectors without groups are, the bank is one cell.
    """
    spark = points.sparkSession
    placed = checkpointed(_cells(points, cut, CELL))
    wide = checkpointed(placed.groupBy("of").agg(F.avg(F.size("cells")).alias("n")).filter(F.col("n") > SPREAD).select("of", F.lit(True).alias("wide")))
    one = lambda c, x: F.when(F.col("wide"), x).otherwise(F.col(c)).alias(c)
    placed = checkpointed(placed.join(F.broadcast(wide), "of", "left").select("of", "node", "v", one("home", F.lit(0)), one("cells", F.array(F.lit(0)))))
    tables = [Rewritten(spark, x) for x in ("rows", "near", "labels", "clusters")]
    label = points.select("of", "node", F.col("node").alias("cluster"))
    live = points.select("of", F.col("node").alias("cluster"), F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("d"))
    home = placed.select("of", F.col("node").alias("cluster"), F.col("home").alias("cell"))
    met = ["of", "cell", "own", "all"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("cluster"), F.col(n)).cast("int")
    blocks = F.ceil(F.count(F.lit(1)) / WIDE).cast("int")
    while True:
        sizes = label.groupBy("of", "cluster").agg(F.count(F.lit(1)).alias("size"))
        state = live.join(sizes, ["of", "cluster"]).join(home, ["of", "cluster"]).select("of", "cluster", "size", "cell", F.col("near").isNull().alias("seeks"))
        rows = tables[0].put(placed.drop("home").join(label, ["of", "node"]).join(state, ["of", "cluster"]))
        own = rows.filter("seeks").select("of", "cell", "cluster", "v")
        all_ = rows.select("of", F.explode("cells").alias("cell"), "cluster", "size", "v")
        n = checkpointed(own.groupBy("of", "cell").agg(blocks.alias("n_own")).join(all_.groupBy("of", "cell").agg(blocks.alias("n_all")), ["of", "cell"]))
        own = own.join(n, ["of", "cell"]).withColumn("own", block("n_own")).withColumn("all", upto("n_all")).select(*(F.col(c).alias(c) for c in (*met, "cluster", "v")))
        all_ = all_.join(n, ["of", "cell"]).withColumn("all", block("n_all")).withColumn("own", upto("n_own")).select(*met, "cluster", "size", "v")
        sought = own.groupBy(*met).cogroup(all_.groupBy(*met)).applyInArrow(_sought(cut), "of string, cluster long, near long, d double")
        sought = sought.groupBy("of", "cluster").agg(F.min(F.struct("d", "near")).alias("p")).select("of", "cluster", "p.near", "p.d")
        near = tables[1].put(live.filter("near is not null").select("of", "cluster", "near", "d").unionByName(sought))
        pair = F.struct("d", F.least("cluster", "near").alias("a"), F.greatest("cluster", "near").alias("b"))
        mutual = near.select("of", F.least("cluster", "near").alias("a"), F.greatest("cluster", "near").alias("b")).groupBy("of", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
        merges = checkpointed(mutual.select("of", "a", "b"))
        if merges.isEmpty():
            merges = checkpointed(near.groupBy("of").agg(F.min(pair).alias("p")).select("of", "p.a", "p.b"))
        moves = checkpointed(merges.select("of", F.explode(F.array("a", "b")).alias("from"), F.col("a").alias("to")))
        at = lambda x, to: moves.select("of", F.col("from").alias(x), F.col("to").alias(to))
        label = tables[2].put(label.join(at("cluster", "to"), ["of", "cluster"], "left").select("of", "node", F.coalesce("to", "cluster").alias("cluster")))
        # Who merged, and whose nearest did, seeks again.
        rests = F.col("to").isNull() & F.col("gone").isNull()
        live = near.join(at("cluster", "to"), ["of", "cluster"], "left").join(at("near", "gone"), ["of", "near"], "left")
        live = tables[3].put(live.select("of", F.coalesce("to", "cluster").alias("cluster"), F.when(rests, F.col("near")).alias("near"), F.when(rests, F.col("d")).alias("d")).distinct())
        left = label.join(live.select("of", "cluster"), ["of", "cluster"], "left_semi").groupBy("of").count().agg(F.max("count")).first()[0]
        if (left or 0) <= most:
            return label.join(live.select("of", "cluster", F.lit(True).alias("live")), ["of", "cluster"], "left").select("of", "node", "cluster", F.coalesce("live", F.lit(False)).alias("live"))


def _together(cut: float):
    """The clusters of a bank, by itself."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        node = rows.column("node").to_numpy()
        label = linked(_unit(numbers(rows.column("v"))), np.searchsorted(node, rows.column("cluster").to_numpy()), cut)
        return pa.Table.from_arrays([rows.column("of"), pa.array(node), pa.array(node[label])], ["of", "node", "cluster"])

    return run


def clusters(rows: DataFrame, bank: str, id_: str, vector_column: str, cut: float = 0.25, least: int = 3, most: int = ALONE) -> DataFrame:
    """Clusters of each bank: bank, id, cluster (its smallest id), of ``least`` rows or more.

    Exactly the clusters of the whole bank, whatever its size: ``most``, the rows
    that one task clusters (fewer if their vectors are long), decides how the
    work is done and not what comes out. Rows of one vector are one point. Rows
    with a null or zero vector are in no cluster; ids are numbers, once in a bank.
    """
    c = F.col(bank)
    base = rows.select(c.alias("bank"), F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias("of"), F.col(id_).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    base = checkpointed(base.filter(F.exists("v", lambda x: x != 0)))
    points = checkpointed(base.groupBy("of", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
    width, banks = points.agg(F.max(F.size("v")), F.count_distinct("of")).first()
    most = min(most, max(1, ALONE_BYTES // (8 * (width or 1))))
    large = checkpointed(points.groupBy("of").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most))
    open_ = points.select("of", "node", F.col("node").alias("cluster"), "v")
    found = None
    if not large.isEmpty():
        begun = dealt(checkpointed(points.join(large, "of", "left_semi").select("of", "node", "v")), cut, most)
        open_ = open_.join(large, "of", "left_anti").unionByName(begun.filter("live").join(points.select("of", "node", "v"), ["of", "node"]).drop("live"))
        found = begun.filter("not live").drop("live")
    # By ranges smaller than a large bank, so that two of them are not one task's work.
    alone = open_.repartitionByRange(min(4 * banks + 1, 2000), "of").groupBy("of").applyInArrow(_together(cut), "of string, node long, cluster long")
    found = alone if found is None else alone.unionByName(found)
    label = checkpointed(points.select("of", "node", "n").join(found, ["of", "node"]).select("of", "node", "n", "cluster"))
    kept = label.groupBy("of", "cluster").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= least)
    label = label.join(kept, ["of", "cluster"], "left_semi")
    one = label.filter("n = 1").select("of", F.col("node").alias("id"), "cluster").join(base.select("of", "bank", "id"), ["of", "id"]).select("bank", "id", "cluster")
    copies = label.filter("n > 1").join(points.select("of", "node", "v"), ["of", "node"]).select("of", "v", "cluster")
    return one.unionByName(base.join(copies, ["of", "v"]).select("bank", "id", "cluster"))
