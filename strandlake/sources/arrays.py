"""Matrices in npy files, read by ranges of rows and written as one file per task."""

from __future__ import annotations

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import reach_workers

READ_ROWS = 65_536  #: rows that a task reads at a time


def read_npy(spark: SparkSession, pattern: str, columns: int | None = None, rows: int = READ_ROWS) -> DataFrame:
    """block (file name without ending), pos, v (array of doubles; at most the first ``columns``) of each row of each matrix.

    The driver reads only headers. Tasks map ranges of rows from the file, which all executors must be able to
    open. Vectors come as rows of one value; other shapes are refused. No file, or none with rows, gives no rows.
    """
    ranges = []
    for path in sorted(glob.glob(pattern)):
        m = np.load(path, mmap_mode="r")
        if m.ndim not in (1, 2):
            raise ValueError(f"{path}: neither a vector nor a matrix")
        ranges += [(path, a, min(a + rows, len(m))) for a in range(0, len(m), rows)]
    reach_workers(spark)
    schema = "block string, pos long, v array<double>"
    if not ranges:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for path, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "a", "b"))):
                m = np.load(path, mmap_mode="r")[a:b].astype(np.float64)
                m = (m if m.ndim == 2 else m[:, None])[:, :columns]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))
                name = os.path.splitext(os.path.basename(path))[0]
                for k in range(0, len(m), 4096):
                    part = lists.slice(k, 4096)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a + k, a + k + len(part))), part], ["block", "pos", "v"])

    return spark.createDataFrame(ranges, "path string, a long, b long").repartition(min(len(ranges), 10_000)).mapInArrow(read, schema)


def write_npy(df: DataFrame, vector: str, order: list[str], folder: str) -> DataFrame:
    """Write the vectors in order as files part-000000.npy, ... that follow each other: part, rows, columns of each.

    ``folder`` must be reachable from all executors. A task holds its own part; ranges of ``order`` decide the parts. Writing
    happens when the result is used; a task that runs again replaces its file. Null vectors are left out.
    """
    sorted_rows = df.filter(F.col(vector).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), F.col(vector).cast(T.ArrayType(T.DoubleType())).alias("v"))

    def write(batches):
        parts, number = [], None
        for batch in batches:
            if batch.num_rows:
                number = batch.column("part")[0].as_py()
                parts.append(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1))
        if parts:
            os.makedirs(folder, exist_ok=True)
            whole, path = np.concatenate(parts), os.path.join(folder, f"part-{number:06d}.npy")
            with open(f"{path}.{os.getpid()}", "wb") as f:
                np.save(f, whole)
            os.replace(f"{path}.{os.getpid()}", path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "rows": pa.array([len(whole)], pa.int64()), "columns": pa.array([whole.shape[1]], pa.int32())})

    return sorted_rows.mapInArrow(write, "part int, rows long, columns int")
