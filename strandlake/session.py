"""Session helpers: shared scratch space that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none gets a fresh folder under the system's temporary
    folder; elsewhere a missing setting is an error, as no executor could read another's folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-strandlake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new, unused path for a written table below :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder that exists removed when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts the lineage: a lost executor costs no recomputation of what lies before. The table is
    removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if nothing else does."""
    here = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{here}:{known}".rstrip(":")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
