"""Vector codes by Lloyd's rounds that look again only at what bounds leave open.

A vector is cut into equal parts; each part position has a codebook, and a
vector's code is the index of the nearest entry of each of its parts.

Vectors are dealt into blocks of ``BLOCK`` within their Spark partitions. A block
keeps, for every part position and entry, a heap of the parts assigned to it. A
part enters with its slack, the lower bound of its distance to any other entry
minus the upper bound of that to its own, as of then. As entries move, slack
shrinks by the way of the own entry plus the longest way of any other; these ways
are added up per entry, and a part's key is its slack plus what its entry's sum
was when it entered. So a key never changes, and the parts whose bounds the
moves may have violated are those at the top of the heap whose key is not above
the entry's present sum. Only these are popped, compared with all entries exactly
and pushed again; the assignment is that of a full scan, at every round.

A round is one Spark job over the blocks: they are read from a Parquet table in
the shared checkpoint folder and written to the next one, and the table before
goes. Each block keeps the sums of its parts by entry and changes them by what
moved; Spark adds up the blocks' sums, so a round sends the driver one sum for
each entry and component, whatever the number of rows.

Everything that decides is in integers: components are floor(4096 * x), squared
distances are longs, ties go to the lower index and new entries are floored
means. Bounds are floating-point numbers with a margin to the safe side.

Defined cases: rows whose vector is null or has a null or non-finite component
are left out; the first entries are those of the smallest ids, null ids last,
equal ids by their vectors, and fewer rows are fewer entries; repeated rows count
each; the number of components is that of the smallest id's vector, and a vector
of another length (an empty one too) teaches nothing and has a null code and
error; components beyond 2**27 after scaling are an error, because their
distances do not fit a long; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import cut, join_counted, tune

#: Fixed values of the code: scale of components, parts, entries and rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block; a row's number takes the low bits of a heap's items.
BLOCK, ROW_BITS = 1024, 16
#: Largest absolute component after scaling.
MOST = 1 << 27
#: Relative margin of the bounds, far above what rounding of doubles can add.
MARGIN = 1e-9
STATE = "ids array<long>, keys array<string>, wide int, parts binary, codes binary, sizes binary, heaps binary, sums array<long>, scanned long"


def kept(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label (as a string that null has of its own) and x (scaled whole numbers) of the rows that have a code."""
    x, c = F.col(f"`{vector}`"), F.col(f"`{label}`").cast("string")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")).cast("long"))
    return vectors.filter(x.isNotNull()).filter(finite).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias("label"), whole.alias("x"))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts to all entries, as whole numbers."""
    d = x[:, None, :] - book[None, :, :]
    return np.einsum("nkc,nkc->nk", d, d)


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower index) and its slack, rounded down."""
    d = _distances(x, book)
    best = d.argmin(1)
    rows = np.arange(len(x))
    own = np.sqrt(d[rows, best].astype(float))
    d[rows, best] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(1).astype(float))  # of a single entry nothing else is near
    return best, np.floor(other * (1 - MARGIN) - own * (1 + MARGIN) - MARGIN)


class Books:
    """Codebooks of a round, int64 of (part, entry, component), and each entry's summed ways."""

    def __init__(self, entries: np.ndarray, ways: np.ndarray | None = None):
        self.entries = entries
        self.ways = np.zeros(entries.shape[:2]) if ways is None else ways

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """New entries: floored means of their parts; unused ones stay."""
        used = counts > 0
        new = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], self.entries)
        step = np.sqrt(((new - self.entries).astype(float) ** 2).sum(2)) * (1 + MARGIN)
        ways = self.ways.copy()
        for p, s in enumerate(step):
            # The longest way of any other entry: the longest, or for that one itself the second.
            top = np.argsort(-s, kind="stable")
            other = np.full(len(s), s[top[0]])
            other[top[0]] = s[top[1]] if len(s) > 1 else 0.0
            ways[p] = (ways[p] + s + other) * (1 + MARGIN)
        return Books(new, ways)


class Block:
    """Vectors with their codes, heaps and sums."""

    def __init__(self, ids: list, labels: list, x: np.ndarray, n_parts: int, n_entries: int):
        self.ids, self.labels, self.x = ids, labels, x
        n, wide = x.shape[0], x.shape[1] // n_parts
        self.parts = x.reshape(n, n_parts, wide)
        self.codes = np.zeros((n, n_parts), np.uint16)
        self.heaps: list[list[list[int]]] = [[[] for _ in range(n_entries)] for _ in range(n_parts)]
        self.sums = np.zeros((n_parts, n_entries, wide + 1), np.int64)
        self.scanned = 0

    def _look(self, p: int, rows: np.ndarray, books: Books, pushed: bool) -> None:
        """Scan rows of a part position and push them to the heap of their entry."""
        x = self.parts[rows, p].astype(np.int64)
        best, slack = _scan(x, books.entries[p])
        self.codes[rows, p] = best
        np.add.at(self.sums[p], best, np.hstack([x, np.ones((len(x), 1), np.int64)]))
        self.scanned += len(rows)
        keys = np.floor(np.minimum(slack + books.ways[p][best], 2.0**46)).astype(np.int64)
        items = (keys << ROW_BITS | rows).tolist()
        heaps = self.heaps[p]
        if pushed:
            for c, item in zip(best.tolist(), items, strict=True):
                heapq.heappush(heaps[c], item)
            return
        for c, item in zip(best.tolist(), items, strict=True):
            heaps[c].append(item)
        for heap in heaps:
            heapq.heapify(heap)

    def first(self, books: Books) -> None:
        rows = np.arange(len(self.x))
        for p in range(self.parts.shape[1]):
            self._look(p, rows, books, pushed=False)

    def again(self, books: Books) -> None:
        """Pop what the moves may have violated, and look at it again."""
        self.scanned = 0
        low = (1 << ROW_BITS) - 1
        for p, heaps in enumerate(self.heaps):
            open_: list[int] = []
            for heap, way in zip(heaps, np.floor(books.ways[p]).astype(np.int64).tolist(), strict=True):
                while heap and heap[0] >> ROW_BITS <= way:
                    open_.append(heapq.heappop(heap) & low)
            if open_:
                rows = np.array(open_, np.int64)
                x = self.parts[rows, p].astype(np.int64)
                np.subtract.at(self.sums[p], self.codes[rows, p], np.hstack([x, np.ones((len(x), 1), np.int64)]))
                self._look(p, rows, books, pushed=True)

    def errors(self, books: Books) -> np.ndarray:
        """Squared distances to the own entries, summed over the parts."""
        total = np.zeros(len(self.x), np.int64)
        for p in range(self.parts.shape[1]):
            d = self.parts[:, p].astype(np.int64) - books.entries[p][self.codes[:, p]]
            total += np.einsum("nc,nc->n", d, d)
        return total

    def row(self) -> tuple:
        heaps = [h for heaps in self.heaps for h in heaps]
        small = len(self.x) == 0 or max(self.x.max(), -self.x.min()) < 1 << 15
        x = self.x.astype(np.int16 if small else np.int32)
        flat = np.array([i for h in heaps for i in h], np.int64)
        return self.ids, self.labels, x.dtype.itemsize, x.tobytes(), self.codes.tobytes(), np.array([len(h) for h in heaps], np.int32).tobytes(), flat.tobytes(), self.sums.ravel().tolist(), self.scanned

    @classmethod
    def of(cls, r: dict, books: Books) -> Block:
        n_parts, n_entries, wide = books.entries.shape
        x = np.frombuffer(r["parts"], np.int16 if r["wide"] == 2 else np.int32).reshape(len(r["ids"]), n_parts * wide)
        b = cls(r["ids"], r["keys"], x, n_parts, n_entries)
        b.codes = np.frombuffer(r["codes"], np.uint16).reshape(len(x), n_parts).copy()
        ends = np.cumsum(np.frombuffer(r["sizes"], np.int32)).tolist()
        flat = np.frombuffer(r["heaps"], np.int64).tolist()  # a heap is written as it lies and is a heap again
        lists = [flat[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        b.heaps = [lists[p * n_entries : (p + 1) * n_entries] for p in range(n_parts)]
        b.sums = np.array(r["sums"], np.int64).reshape(n_parts, n_entries, wide + 1)
        return b


_STATE_NAMES = [f.strip().split(" ")[0] for f in STATE.split(",")]
_STATE_KINDS = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]


def _state(blocks: list[Block]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(b.row() for b in blocks), strict=True), _STATE_KINDS, strict=True)], _STATE_NAMES)


def _start(books):
    """Rows to blocks: the first assignment, of all parts."""

    def block(ids: list, labels: list, xs: list[np.ndarray]) -> Block:
        b = books.value
        made = Block(ids, labels, np.concatenate(xs), b.entries.shape[0], b.entries.shape[1])
        made.first(b)
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = books.value.entries.shape[0] * books.value.entries.shape[2]
        ids, labels, xs = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(-1, dims)
            if len(x) and (x.max() > MOST or x.min() < -MOST):
                raise OverflowError(f"a component of a vector is beyond {MOST} after scaling: its distances do not fit a long")
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            xs.append(x)
            while len(ids) >= BLOCK:
                all_ = np.concatenate(xs)
                yield _state([block(ids[:BLOCK], labels[:BLOCK], [all_[:BLOCK]])])
                ids, labels, xs = ids[BLOCK:], labels[BLOCK:], [all_[BLOCK:]]
        if ids:
            yield _state([block(ids, labels, xs)])

    return run


def _next(books):
    """Blocks to blocks: one more assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block.of(r, books.value)
                b.again(books.value)
                yield _state([b])

    return run


def _codes(books):
    """Blocks to rows: the last assignment, with codes and exact errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block.of(r, books.value)
                b.again(books.value)
                digits = max(2, len(f"{books.value.entries.shape[1] - 1:x}"))
                code = ["".join(f"{c:0{digits}x}" for c in row) for row in b.codes.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.labels, pa.string()), pa.array(code, pa.string()), pa.array(b.errors(books.value))], ["vec_id", "label", "code", "error"])

    return run


class _Tables:
    """The blocks' tables in the shared checkpoint folder; only the last is kept."""

    def __init__(self, spark):
        self.spark, self.at = spark, f"{spark.sparkContext.getCheckpointDir()}/vector-codes-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, blocks: DataFrame) -> DataFrame:
        blocks.write.parquet(f"{self.at}/{self.n}")
        if self.n:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{self.n - 1}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.n += 1
        return self.spark.read.parquet(f"{self.at}/{self.n - 1}")


def _summed(blocks: DataFrame, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of every entry's parts, over all blocks: as many rows as there are numbers in the codebooks."""
    shape = (*books.entries.shape[:2], books.entries.shape[2] + 1)
    total = np.zeros(int(np.prod(shape)), np.int64)
    for r in blocks.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    total = total.reshape(shape)
    return total[..., :-1], total[..., -1]


def fit(rows: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Books | None, DataFrame | None, DataFrame, list[int]]:
    """Codebooks after ``rounds`` rounds, the blocks as assigned before the last, rows without a code, and the parts scanned in each round.

    ``rows`` as of ``kept``.
    """
    spark = rows.sparkSession
    tune(spark)
    first = rows.filter(F.size("x") > 0).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(n_entries).collect()
    if not first:
        return None, None, rows, []
    dims = len(first[0]["x"])
    if dims % n_parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {n_parts} equal parts")
    x = np.array([r["x"] for r in first if len(r["x"]) == dims], np.int64)
    if x.max() > MOST or x.min() < -MOST:
        raise OverflowError(f"a component of a vector is beyond {MOST} after scaling: its distances do not fit a long")
    books = Books(x.reshape(len(x), n_parts, -1).swapaxes(0, 1).copy())
    if len(x) < n_entries and len(first) == n_entries:  # vectors of other lengths stood among the first
        more = rows.filter(F.size("x") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(n_entries).collect()
        books = Books(np.array([r["x"] for r in more], np.int64).reshape(len(more), n_parts, -1).swapaxes(0, 1).copy())
    tables, scanned, blocks = _Tables(spark), [], None
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        made = rows.filter(F.size("x") == dims).mapInArrow(_start(shared), STATE) if k == 0 else blocks.mapInArrow(_next(shared), STATE)
        blocks = tables.write(made)
        scanned.append(blocks.agg(F.sum("scanned")).first()[0] or 0)
        books = books.moved(*_summed(blocks, books))
    return books, blocks, rows.filter(F.size("x") != dims), scanned


def digest(books: Books) -> str:
    """Of all entries' whole numbers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that is kept."""
    tune(vectors.sparkSession)
    books, blocks, other, _ = fit(kept(vectors, vec_id, vector, label), n_parts, n_entries, rounds)
    none = other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books is None:
        coded = none
    else:
        shared = vectors.sparkSession.sparkContext.broadcast(books)
        coded = blocks.mapInArrow(_codes(shared), "vec_id long, label string, code string, error long").unionByName(none)
    coded = cut(coded)
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    return join_counted(coded, sums, ["label"], "rows", 64, ["vec_id"]).select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books else None).cast("string").alias("codebooks_sha256"))
