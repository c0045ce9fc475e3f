"""Sessions for local work; on a cluster the caller's own session is used."""

from __future__ import annotations

import os
import tempfile
import zipfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "mnemospark", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings the plans are written for."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let the workers import this package, once a context, where their path does not have it."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    here = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if getattr(sc, "_mnemospark_shipped", False) or str(package.parent) in here:
        return
    path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._mnemospark_shipped = True


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder, and that the workers have the package.

    The folder is the one that the session has or ``spark.checkpoint.dir`` names;
    a local session without one gets a temporary folder, a cluster an error.
    """
    ship(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith(("local[", "local-")) and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mnemospark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: their lineage ends here."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Rewritten:
    """A Parquet table in the shared checkpoint folder that a loop writes anew in every round.

    A checkpoint keeps the size that the optimizer estimated, and over rounds of
    joins that number doubles its digits each time; what is read from files has
    the files' size. The version before the last is deleted, so use a frame only
    until the next but one is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        checkpoint_folder(spark)
        self.spark, self.at, self.n = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.at}/{self.n}")
        if self.n > 1:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{self.n - 2}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{self.n - 1}")
