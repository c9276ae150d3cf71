"""Session helpers: table access, lineage cuts and partition sizing."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Make the package known to the Python workers, once for each context.

    Nothing is to do on one machine where the workers find it themselves, by PYTHONPATH or their
    working folder.  Elsewhere a zip of the sources goes out by ``addPyFile``, which copies it from
    the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pointgate", False):
        return
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep) if sc.master.startswith("local") else []
    if not sc.master.startswith("local-cluster") and known:
        known.append(os.getcwd())
    if ROOT in [Path(p).resolve() for p in known if p]:
        return
    base = Path(tempfile.mkdtemp(prefix="pointgate-src-"))
    sc.addPyFile(shutil.make_archive(str(base / "pointgate"), "zip", ROOT, "pointgate"))
    sc._pointgate = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; the schema comes from the Parquet footer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session that names none gets a
    temporary folder; elsewhere its executors would not share it, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pointgate-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's heap is collected, which it may otherwise not be for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of one call, as compressed columns in the shared folder; all go at the end of the ``with``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def drop(self) -> None:
        """Delete the tables before the end, once nothing reads them any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)

    def keep(self, df: DataFrame) -> DataFrame:
        """Cut the lineage like ``cut``, in a fraction of the disk, until the end of the ``with``."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
