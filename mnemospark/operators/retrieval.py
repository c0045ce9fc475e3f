"""Retrieval channels: vector, keyword, temporal and tag search for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scoring, text, time
from mnemospark.operators.clustering import numbers
from mnemospark.operators.ranking import few, top_per
from mnemospark.session import checkpointed

#: Vectors in one block of a blocked search.
BLOCK = 2048
#: Bytes of query vectors that go to every worker; more are searched block against block.
QUERY_BYTES = 24 << 20
#: Keyword queries that go to every worker at once; more take further passes.
QUERIES_AT_ONCE = 4096
#: A node of the tree that ranges stand in has 2 ** this many of the level below.
RANGE_BITS = 2
_TOKEN = regex.compile(r"[\p{L}\p{N}_]+")
_ASCII = bytes(b if chr(b).isalnum() or chr(b) == "_" else 32 for b in range(128)) + bytes(128)


def _tokens(text_: str | None) -> list[str]:
    """The lower-case tokens of a text; most texts are ASCII, and quicker without the expression."""
    low = (text_ or "").lower()
    return low.encode().translate(_ASCII).decode().split() if low.isascii() else _TOKEN.findall(low)


def _unit(ids: list, vectors: list, metric: str) -> tuple[list[str], np.ndarray]:
    kept = [(i, v) for i, v in zip(ids, vectors, strict=True) if v is not None]
    m = np.array([v for _, v in kept], float).reshape(len(kept), -1)
    if metric == "cosine":
        n = np.sqrt((m * m).sum(1, keepdims=True))
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return [i for i, _ in kept], m


def _places(ids: list[str]) -> np.ndarray:
    """What ids are ordered by where scores are equal: their numbers, or their places as strings."""
    try:
        return np.array(ids, np.int64)
    except ValueError:
        return np.argsort(np.argsort(np.array(ids)))


def _best(s: np.ndarray, places: np.ndarray, k: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row of scores the columns of the ``k`` greatest; of equal ones (to nine digits) those first in order."""
    for i, row in enumerate(s):
        bound = max(least, np.partition(row, -k)[-k] - 2e-9 if k < len(row) else least)
        at = np.flatnonzero(row >= bound)
        yield i, at[np.lexsort((places[at], -np.round(row[at], 9)))[:k]]


def _rows(found: list[tuple[list[str], list[str], np.ndarray]]) -> pa.RecordBatch:
    q, i, s = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x for y in q for x in y], pa.string()), pa.array([x for y in i for x in y], pa.string()), pa.array(np.concatenate(s), pa.float64())], ["query_id", "item_id", "score"])


def _match(ids: list[str], x: np.ndarray, qids: list[str], q: np.ndarray, k: int, least: float) -> list[tuple[list[str], list[str], np.ndarray]]:
    if not len(ids) or not len(qids):
        return []
    s, places = q @ x.T, _places(ids)
    return [([qids[i]] * len(at), [ids[j] for j in at], s[i, at]) for i, at in _best(s, places, k, least)]


def _by_batch(shared, k: int, least: float, metric: str):
    """Batches of items against all queries of their bank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            rows: dict[str, tuple[list, list]] = {}
            for b, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b in queries:
                    ids, vectors = rows.setdefault(b, ([], []))
                    ids.append(i)
                    vectors.append(v)
            found = [f for b, (ids, vectors) in rows.items() for f in _match(*_unit(ids, vectors, metric), *queries[b], k, least)]
            if found:
                yield _rows(found)

    return run


def _by_block(k: int, least: float, metric: str):
    """A block of items against a block of queries; with a column ``least``, a query's own least score holds too."""

    def matrix(rows: pa.Table) -> tuple[list[str], np.ndarray]:
        rows = rows.filter(pc.is_valid(rows.column("v")))
        m = numbers(rows.column("v")) if len(rows) else np.zeros((0, 0))
        return _unit(rows.column("id").to_pylist(), list(m), metric)

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        (ids, x), (qids, q) = matrix(items), matrix(queries)
        found = _match(ids, x, qids, q, k, least)
        if not found:
            return pa.Table.from_pydict({"query_id": pa.array([], pa.string()), "item_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        rows = pa.Table.from_batches([_rows(found)])
        if "least" in queries.column_names:
            own = dict(zip(queries.column("id").to_pylist(), queries.column("least").to_pylist(), strict=True))
            rows = rows.filter(pa.array(rows.column("score").to_numpy() >= np.array([own[i] for i in rows.column("query_id").to_pylist()])))
        return rows

    return run


def vector_search(items: DataFrame, queries: DataFrame, key: str, vector: str, k: int, threshold: float = -1.0, query_key: str | None = None, exclude_same: bool = True, block: int = BLOCK, bank: str | None = None, metric: str = "cosine") -> DataFrame:
    """The ``k`` nearest items of every query, exact; with ``bank``, a column of both sides, among the items of its bank.

    While the queries' vectors fit in ``QUERY_BYTES`` they go to every worker and
    items are read where they lie, a batch at a time. Beyond that both sides are
    dealt into blocks within their bank, and every pair of blocks is one matrix
    product and all that a worker holds at a time; no bank is one task's work.
    Only ``k`` rows a query leave a product. Columns: query_id, item_id
    (strings), score, rank. Ties go to the smaller id. ``metric``: cosine or dot.
    """
    most = k + 1 + int(exclude_same)  # a query's own row is dropped afterwards, and rounding may swap the last two
    schema = "query_id string, item_id string, score double"

    def shaped(df: DataFrame, id_: str) -> DataFrame:
        of = F.lit("") if bank is None else F.col(bank).cast("string")
        return df.select(of.alias("bank"), F.col(id_).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    i, q = shaped(items, key), shaped(queries, query_key or key)
    if (q.agg(F.sum(8 * F.size("v") + 40)).first()[0] or 0) <= QUERY_BYTES:
        by_bank: dict[str, list] = {}
        for r in q.collect():
            by_bank.setdefault(r["bank"], []).append(r)
        shared = items.sparkSession.sparkContext.broadcast({b: _unit([r["id"] for r in rows], [r["v"] for r in rows], metric) for b, rows in by_bank.items()})
        found = i.mapInArrow(_by_batch(shared, most, threshold - 1e-9, metric), schema)
    else:
        blocks = lambda df, name: df.groupBy("bank").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
        sizes = blocks(i, "n_items").join(blocks(q, "n_queries"), "bank")

        def dealt(df: DataFrame, n: str, name: str) -> DataFrame:
            return df.join(sizes, "bank").withColumn(name, F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))

        met = ["bank", "query", "item"]
        a = dealt(i, "n_items", "item").withColumn("query", F.explode(F.sequence(F.lit(0), F.col("n_queries") - 1))).select(*met, "id", "v")
        b = dealt(q, "n_queries", "query").withColumn("item", F.explode(F.sequence(F.lit(0), F.col("n_items") - 1))).select(*met, "id", "v")
        found = a.groupBy(*met).cogroup(b.groupBy(*met)).applyInArrow(_by_block(most, threshold - 1e-9, metric), schema)
    found = found.filter(F.col("score") >= threshold)
    if exclude_same:
        found = found.filter(F.col("query_id") != F.col("item_id"))
    return top_per(found, ["query_id"], [F.round("score", 9).desc(), F.expr("try_cast(item_id AS bigint)"), F.col("item_id")], k)


def _passes(queries: DataFrame, key: str, at_once: int) -> list[DataFrame]:
    """The queries in parts of about ``at_once``, dealt by hash."""
    n = max(1, -(-queries.count() // at_once))
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == p) for p in range(n)]


def keyword_search(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text", bank: str | None = None, at_once: int | None = None) -> DataFrame:
    """The ``k`` documents of every query with most hits: 0.1 for each token that the query names.

    Frequent tokens would make a join of tokens write a row for nearly every
    document and query, so queries go to the workers as an index from token to
    queries, ``at_once`` of them a pass, and each batch of documents yields at
    most ``k`` rows a query. With ``bank``, a column of both sides, a query meets
    the documents of its bank. Columns: query_id, doc_id (as in ``docs``), score,
    rank. No token: no result.
    """
    of = "''" if bank is None else f"cast(`{bank}` AS string)"
    wanted = queries.selectExpr(f"{of} AS bank", f"cast(`{query_id}` AS bigint) AS id", f"`{query_text}` AS text")
    kind = docs.schema[doc_id].dataType
    source = docs.selectExpr(f"{of} AS bank", f"cast(`{doc_id}` AS string) AS id", f"`{doc_text}` AS text")
    found = None
    for part in _passes(wanted, "id", at_once or QUERIES_AT_ONCE):
        index: dict[str, tuple[list[int], dict[str, list[int]]]] = {}
        for r in part.collect():
            ids, tokens = index.setdefault(r["bank"], ([], {}))
            for t in set(_tokens(r["text"])):
                tokens.setdefault(t, []).append(len(ids))
            ids.append(r["id"])
        index = {b: (ids, {t: np.array(x, np.int32) for t, x in tokens.items()}) for b, (ids, tokens) in index.items()}
        hits = source.mapInArrow(_hits(docs.sparkSession.sparkContext.broadcast(index), k), "query_id long, doc_id string, hits long").withColumn("doc_id", F.col("doc_id").cast(kind))
        found = hits if found is None else found.unionByName(hits)
    return top_per(found, ["query_id"], [F.col("hits").desc(), F.col("doc_id")], k).select("query_id", "doc_id", (F.col("hits") / 10).alias("score"), "rank")


def _hits(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows: dict[str, list[tuple[int, np.ndarray]]] = {}
            for b, i, text_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b not in index:
                    continue
                ids, tokens = index[b]
                met = [x for w in _tokens(text_) if (x := tokens.get(w)) is not None]
                if met:
                    rows.setdefault(b, []).append((i, np.bincount(np.concatenate(met), minlength=len(ids)).astype(np.int32)))
            for b, found in rows.items():
                docs_, s = np.array([i for i, _ in found], object), np.stack([n for _, n in found])
                order = np.lexsort((np.broadcast_to(_places(docs_.tolist())[:, None], s.shape), -s), axis=0)[:k]
                best = np.take_along_axis(s, order, 0)
                at, query = np.nonzero(best)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(index[b][0], np.int64)[query]), pa.array(docs_[order[at, query]], pa.string()), pa.array(best[at, query].astype(np.int64))], ["query_id", "doc_id", "hits"])

    return run


def temporal_entries(units: DataFrame, queries: DataFrame, k: int, id_: str, start: str, end: str, mentioned: str, bank: str | None = None) -> DataFrame:
    """The ``k`` latest units that meet each query's window (query_id, low, high), with their proximity.

    Time is a tree (``time.cover``), and units and windows meet by equality
    on (bank, node), so one pass serves any number of windows:

    - a date inside the window's whole cells: every date stands at the nodes
      above it, the window asks the few nodes that cover it;
    - a range that began before the window and ends after its start: the range
      stands at the few nodes that cover it, the window asks those above its start;
    - dates and ends of ranges in the two cells that hold the window's own ends
      are compared with it as they are.

    Few windows go to every worker, and units that none of them can meet end
    where they are read. A node keeps its ``k`` latest units only, which loses
    nothing, as a window takes a node whole. So a long window in a large bank meets ``k`` rows for each
    of its nodes. With ``bank``, a column of both sides, a query meets the units
    of its bank. A window without an end, or that ends before it begins, meets none.
    """
    of = lambda c: F.lit("") if bank is None else F.col(c).cast("string")
    u = units.select(of(bank).alias("of"), F.col(id_).alias("unit_id"), F.coalesce(start, mentioned, end).alias("best"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(mentioned).alias("m"))
    cells = F.array_except(F.array(*(time.cell(F.col(c)) for c in "mse")), F.array(F.lit(None).cast("long")))
    q = checkpointed(queries.filter(F.col("low") <= F.col("high")).select(of(bank).alias("of"), "query_id", "low", "high"))
    first, last = time.cell(F.col("low")), time.cell(F.col("high"))
    late = [F.col("best").desc(), F.col("unit_id")]
    at, node = ["of", "level", "node"], ["of", "unit_id", "best", F.explode("nodes").alias("n")]

    inside = q.select("query_id", "low", "high", "of", F.explode(time.cover(first + 1, last - 1)).alias("n")).select("query_id", "low", "high", "of", "n.*")
    asked = checkpointed(inside.select(*at).distinct())
    near = few(q) and few(asked)
    if near and bank is not None:
        u = u.join(F.broadcast(q.select("of").distinct()), "of", "left_semi")
    points = u.filter(F.size(cells) > 0).select("of", "unit_id", "best", F.explode(cells).alias("cell"))
    points = points if near else top_per(points, ["of", "cell"], late, k)
    points = points.select("of", "unit_id", "best", time.above(F.col("cell")).alias("nodes")).select(*node).select("of", "unit_id", "best", "n.*")
    points = points.join(F.broadcast(asked) if near else asked, at, "left_semi").distinct()
    points = top_per(points, at, late, k).drop("rank")

    # A range stands at the nodes that cover it, so its tree has narrow nodes; and only where a window asks.
    begun = q.select("query_id", "low", "high", "of", F.explode(time.above(first, RANGE_BITS)).alias("n")).select("query_id", "low", "high", "of", "n.*")
    ranges = u.filter(F.col("s") < F.col("e")).select("of", "unit_id", "best", (time.cell(F.col("s")) + 1).alias("first"), (time.cell(F.col("e")) - 1).alias("last"))
    ranges = time.covered(ranges, "first", "last", RANGE_BITS).drop("first", "last")
    ranges = top_per(ranges.join(begun.select(*at).distinct(), at, "left_semi"), at, late, k).drop("rank")

    edges = q.select("query_id", "low", "high", "of", F.explode(F.array_distinct(F.array(first, last))).alias("cell"))
    beside = u.select("*", F.explode(cells).alias("cell")).join(F.broadcast(edges) if near else edges, ["of", "cell"]).filter(time.overlaps(F.col("s"), F.col("e"), F.col("m"), F.col("low"), F.col("high")))
    shown = ["query_id", "low", "high", "unit_id", "best"]
    met = inside.join(points, at).select(*shown).unionByName(begun.join(ranges, at).select(*shown)).unionByName(beside.select(*shown))
    # Every way's own k latest are enough, and a unit counts once however many ways it came.
    proximity = scoring.window_proximity(scoring.seconds(F.col("best")), scoring.seconds(F.col("low")), scoring.seconds(F.col("high")))
    return top_per(met.distinct().select("query_id", "unit_id", "best", proximity.alias("proximity")), ["query_id"], late, k)


def tag_filter(rows: DataFrame, tags: str, wanted: list[str]) -> DataFrame:
    """Rows whose tags contain all wanted ones."""
    return rows.filter(text.contains_all(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.array(*map(F.lit, wanted)).cast("array<string>")))


def scan(rows: DataFrame, bank: str | None = None, least_strength: float | None = None, layer: str | None = None, status: str | None = None, tags: list[str] | None = None, k: int | None = None, offset: int = 0) -> DataFrame:
    """Dictionary scan with optional predicates, by strength; a page of it if ``k`` is given."""
    for column, value in (("bank_id", bank), ("layer", layer), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if least_strength is not None:
        rows = rows.filter(F.col("strength") >= least_strength)
    if tags:
        rows = tag_filter(rows, "tags", tags)
    if k is None:
        return rows
    return rows.orderBy(F.desc("strength"), "engram_id").offset(offset).limit(k)


def strength_filter(found: DataFrame, dictionary: DataFrame, key: str, least: float) -> DataFrame:
    """Results whose strength is ``least`` or more; a missing row counts as 0.5."""
    return found.join(dictionary.select(key, "strength"), key, "left").filter(F.coalesce("strength", F.lit(0.5)) >= least)


def floor_with_fallback(scored: DataFrame, by: list[str], score: str, least: float, keyword: str) -> DataFrame:
    """Results above the reranker's floor; where a query keeps none, those with a keyword match."""
    all_ = Window.partitionBy(*by)
    kept = F.max(F.when(F.col(score) >= least, 1).otherwise(0)).over(all_)
    return scored.withColumn("_any", kept).filter((F.col(score) >= least) | ((F.col("_any") == 0) & (F.col(keyword) > 0))).drop("_any")


def search_text(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows in which a column contains the needle, in any case."""
    pattern = "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    match: Column = F.lit(False)
    for c in columns:
        match = match | F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False))
    return rows.filter(match)


def point_lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
