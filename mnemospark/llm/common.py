"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import ship

#: The white space that separates words: fixed values of the word contract.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Most bytes a side may have to be broadcast.
BROADCAST_BYTES = 24 << 20


def tune(spark: SparkSession) -> None:
    """Prepare a session: the package on the workers, a checkpoint folder and small Arrow batches.

    The folder that the cluster names in ``spark.checkpoint.dir`` is used as
    it is. Where none is set, a local session gets a temporary one; on a
    cluster that would be lost with its node, so there it is an error.
    """
    ship(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith(("local[", "local-")) and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mnemospark-checkpoint-"))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the driver's folder, through Spark's own reader."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are in the shared checkpoint folder after this."""
    tune(df.sparkSession)
    return df.checkpoint(eager=True)


def common_bytes() -> int:
    """The most bytes of a broadcast side."""
    return BROADCAST_BYTES


def fits(df: DataFrame, row_bytes: int | Column, limit: int | None = None) -> bool:
    """Whether the rows of a checkpointed frame take ``limit`` bytes at most.

    ``row_bytes``: the bytes of a row, or a column that says them; then they
    are added up, so rows of any length are counted as what they are.
    """
    limit = common_bytes() if limit is None else limit
    if isinstance(row_bytes, int):
        return df.count() * row_bytes <= limit
    return (df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= limit


def small(df: DataFrame, row_bytes: int | Column, limit: int | None = None) -> DataFrame:
    """Mark a checkpointed frame for broadcast if its rows fit ``limit``.

    Beyond the limit the frame is returned as it is and Spark shuffles it, so
    a plan built on this works at every size.
    """
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


def join_counted(left: DataFrame, right: DataFrame, on: list[str], weight: str, row_bytes: int, spread: list[str]) -> DataFrame:
    """Inner join with a (checkpointed) ``right`` that has each key once and, in ``weight``, how often ``left`` has it.

    ``right`` is broadcast if it fits. If not, its heaviest keys still are, as
    many as fit; ``left`` is shuffled for the others only, and its rows of heavy
    keys are dealt by the columns ``spread``, so no key is one task's work.
    """
    if fits(right, row_bytes):
        return left.join(F.broadcast(right), on)
    # Of the keys of this weight or more there are no more than fit.
    least = (right.agg(F.sum(weight)).first()[0] * row_bytes) // max(1, common_bytes()) + 1
    names = {c: fresh(c, [*left.columns, *right.columns]) for c in [*on, "hot", "cold", "dealt"]}
    values = F.struct(*(c for c in right.columns if c not in on))
    hot = right.filter(F.col(weight) >= least).select(*on, values.alias(names["hot"]))
    cold = right.filter(F.col(weight) < least).select(*(F.col(c).alias(names[c]) for c in on), values.alias(names["cold"]))
    marked = left.join(F.broadcast(hot), on, "left").withColumn(names["dealt"], F.when(F.col(names["hot"]).isNull(), F.lit(0)).otherwise(F.xxhash64(*spread)))
    same = [F.col(c) == F.col(names[c]) for c in on]
    joined = marked.join(cold.withColumn(names["dealt"] + "_", F.lit(0).cast("long")), [*same, F.col(names["dealt"]) == F.col(names["dealt"] + "_")], "left")
    value = F.coalesce(names["hot"], names["cold"])
    joined = joined.filter(F.col(names["hot"]).isNotNull() | F.col(names["cold"]).isNotNull())
    return joined.select(*left.columns, *(value[c].alias(c) for c in right.columns if c not in on))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` has a fast path for pure ASCII; other strings need ``translate``
    because ``lower`` would change letters beyond A-Z too.
    """
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken``."""
    low = {t.lower() for t in taken}
    while (name := f"{prefix}_{uuid.uuid4().hex[:8]}").lower() in low:
        pass
    return name


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))
