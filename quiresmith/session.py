"""Sessions, shared working folders and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: Rows that go to Python together have about so many bytes, unless the session says otherwise: 10,000 whole texts may have 64 MiB, in JVM and worker, in and out.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


#: Rows of ids that are broadcast at most.
FEW = 100_000


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on every executor, once per Spark context, and bound the bytes of Arrow batches.

    Workers that already share the driver's PYTHONPATH lose nothing; on a real
    cluster the executors fetch the archive from the driver's file server.
    """
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_quiresmith_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="quiresmith-")
    path = os.path.join(folder, "quiresmith_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    sc.addPyFile(path)
    sc._quiresmith_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, else, with a local master, one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + os.path.join(tempfile.gettempdir(), f"quiresmith-{os.getpid()}")
        os.makedirs(known.removeprefix("file://"), exist_ok=True)
        spark.sparkContext.setCheckpointDir(known)
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quiresmith/{name}-{uuid.uuid4().hex}"


def written(df, name: str, partition_by: list[str] | None = None):
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df, name: str):
    """``df`` written; with at most FEW rows it is broadcast to what it is joined with, so that a large side needs no shuffle."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= FEW else out


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
