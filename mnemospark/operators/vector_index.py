"""An inverted file over vectors: cells around learned centroids, searched exactly.

``build`` learns a centroid for each ``cell`` rows of a bank by a few of Lloyd's
rounds as Spark jobs and gives every row the cell of its nearest one; with a
folder the rows lie in it by bank and cell, so a search reads the cells it needs.

``search`` takes each query's nearest cells first. Their ``k``-th best score
bounds what can still come in: by the triangle inequality no row of a cell is
nearer to the query than the cell's centroid less its radius, so only cells whose
bound is within that score are read in a second pass. So the result is that of
``retrieval.vector_search`` for any data; how many cells are spared depends on
how far the data fall into groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.clustering import _homes, _unit
from mnemospark.operators.consolidation import means
from mnemospark.operators.ranking import top_per
from mnemospark.operators.retrieval import _by_block
from mnemospark.session import checkpointed

#: Rows that a cell has about, rounds of learning, cells that a query takes first, and rows of a block.
CELL, ROUNDS, PROBES, BLOCK = 1000, 3, 4, 2048
#: Bytes of centroids that go to every worker; of more, cells are made larger.
CENTROID_BYTES = 24 << 20


class Index:
    """Rows by bank and cell, and the cells' centroids and radii.

    rows: of (bank), cell, id, v; cells: of, cell, centroid (null: a bank of one
    cell), radius.
    """

    def __init__(self, rows: DataFrame, cells: DataFrame):
        self.rows, self.cells = rows, cells

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/cells"))

    def search(self, queries: DataFrame, key: str, vector: str, k: int, threshold: float = -1.0, bank: str | None = None, exclude_same: bool = True, probes: int = PROBES) -> DataFrame:
        """The ``k`` nearest rows of every query by cosine, exact: query_id, item_id (strings), score, rank."""
        most = k + 1 + int(exclude_same)
        q = checkpointed(_shaped(queries, key, vector, bank))
        centres: dict[str, list] = {}
        for r in self.cells.filter("centroid is not null").collect():  # as many as CENTROID_BYTES allows
            centres.setdefault(r["of"], []).append((r["cell"], r["centroid"], r["radius"]))
        shared = q.sparkSession.sparkContext.broadcast({b: (np.array([c for c, _, _ in x], np.int32), _unit([v for _, v, _ in x]), np.array([r for _, _, r in x])) for b, x in centres.items()})
        asked = checkpointed(q.mapInArrow(_bounds(shared), "of string, id string, v array<double>, cells array<int>, bounds array<double>"))
        first = self._found(asked.select("of", "id", "v", F.explode(F.slice("cells", 1, probes)).alias("cell")), most, threshold)
        first = checkpointed(first)
        worst = top_per(first.filter(F.col("query_id") != F.col("item_id")) if exclude_same else first, ["query_id"], [F.desc("score"), F.col("item_id")], k)
        worst = worst.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("worst"))
        least = F.greatest(F.coalesce("worst", F.lit(-1.0)), F.lit(threshold))
        more = asked.join(worst, "id", "left").withColumn("reach", F.acos(F.greatest(least - 2e-9, F.lit(-1.0))) + 1e-6)
        rest = F.transform(F.slice(F.arrays_zip("cells", "bounds"), probes + 1, F.greatest(F.size("cells") - probes, F.lit(0))), lambda c: F.struct(c["cells"].alias("cell"), c["bounds"].alias("bound")))
        # What is below a query's k-th score so far cannot come in, and does not leave the workers.
        more = more.select("of", "id", "v", "reach", (least - 2e-9).alias("least"), F.explode(rest).alias("c")).filter(F.col("c.bound") <= F.col("reach")).select("of", "id", "v", "least", "c.cell")
        found = first.unionByName(self._found(more, most, threshold))
        if exclude_same:
            found = found.filter(F.col("query_id") != F.col("item_id"))
        return top_per(found.filter(F.col("score") >= threshold), ["query_id"], [F.round("score", 9).desc(), F.expr("try_cast(item_id AS bigint)"), F.col("item_id")], k)

    def _found(self, asked: DataFrame, most: int, threshold: float) -> DataFrame:
        """The best of the asked cells' rows for each query: blocks of a cell's rows against blocks of its queries."""

        def dealt(rows: DataFrame, name: str, other: DataFrame, across: str) -> DataFrame:
            """Rows with their own block, once for each block of the other side in their cell."""
            blocks = lambda df, n: df.groupBy("of", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
            put = rows.join(blocks(rows, "_own"), ["of", "cell"]).join(blocks(other, "_other"), ["of", "cell"])
            return put.withColumn(name, F.pmod(F.xxhash64("id"), F.col("_own"))).withColumn(across, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_other") - 1))).drop("_own", "_other")

        items = self.rows.join(asked.select("of", "cell").distinct(), ["of", "cell"], "left_semi")
        met = ["of", "cell", "item", "query"]
        a, b = dealt(items, "item", asked, "query").groupBy(*met), dealt(asked, "query", items, "item").groupBy(*met)
        # A worker holds one pair of blocks at a time.
        return a.cogroup(b).applyInArrow(_by_block(most, threshold - 1e-9, "cosine"), "query_id string, item_id string, score double")


def _shaped(rows: DataFrame, key: str, vector: str, bank: str | None) -> DataFrame:
    of = F.lit("=") if bank is None else F.concat(F.lit("="), F.col(bank).cast("string"))
    return rows.select(of.alias("of"), F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("of").isNotNull() & F.exists("v", lambda x: x != 0))


def _bounds(centres):
    """The cells of each query's bank, nearest first, with the least angle that a row in it can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, bounds = [], []
            for of, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (c := centres.value.get(of)) is None:
                    cells.append([0])
                    bounds.append([0.0])
                    continue
                number, centre, radius = c
                least = np.maximum(np.arccos(np.clip(centre @ _unit([v])[0], -1, 1)) - radius, 0.0)
                order = np.argsort(least + 1e-3 * np.arccos(np.clip(centre @ _unit([v])[0], -1, 1)), kind="stable")
                cells.append(number[order].tolist())
                bounds.append(least[order].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.float64()))], ["of", "id", "v", "cells", "bounds"])

    return run


def build(items: DataFrame, key: str, vector: str, bank: str | None = None, cell: int = CELL, rounds: int = ROUNDS, folder: str | None = None) -> Index:
    """Cells of about ``cell`` rows in each bank; with ``folder``, stored there by bank and cell.

    The first centroids are a sample by a hash of the id, one in ``cell`` rows;
    every row is indexed. Rows without a vector, or with a zero one, are in none.
    """
    rows = checkpointed(_shaped(items, key, vector, bank))
    total, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    cell = max(cell, -(-total * 8 * (width or 1) // CENTROID_BYTES))
    large = rows.groupBy("of").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    centres: dict[str, list] = {}
    for r in rows.filter(F.pmod(F.xxhash64("id"), F.lit(cell)) == 0).join(large, "of").select("of", "v").collect():
        centres.setdefault(r["of"], []).append(r["v"])
    homed = "of string, id string, v array<double>, home int, angle double"
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast({b: _unit(v) for b, v in centres.items()})
        moved = means(rows.mapInArrow(_homes(shared), homed), ["of", "home"], "v")
        for r in moved.filter(F.col("of").isin(list(centres))).collect() if centres else []:
            if any(r["mean"]):
                centres[r["of"]][r["home"]] = r["mean"]
    shared = rows.sparkSession.sparkContext.broadcast({b: _unit(v) for b, v in centres.items()})
    placed = checkpointed(rows.mapInArrow(_homes(shared), homed))
    radii = {(r["of"], r["home"]): r["radius"] for r in placed.filter(F.col("of").isin(list(centres))).groupBy("of", "home").agg(F.max("angle").alias("radius")).collect()} if centres else {}
    listed = [(b, k, [float(x) for x in v], float(radii[b, k]) + 1e-6) for b, vs in centres.items() for k, v in enumerate(vs) if (b, k) in radii]
    cells = rows.sparkSession.createDataFrame(listed, "of string, cell int, centroid array<double>, radius double")
    placed = placed.select("of", F.col("home").alias("cell"), "id", "v")
    if folder is None:
        return Index(placed, cells)
    placed.repartition("of", "cell").write.mode("overwrite").partitionBy("of", "cell").parquet(f"{folder}/rows")
    cells.write.mode("overwrite").parquet(f"{folder}/cells")
    return Index.load(rows.sparkSession, folder)
