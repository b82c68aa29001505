"""One-dimensional variables of classic netCDF files, read by ranges of values."""

from __future__ import annotations

import struct
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlake.session import reach_workers

READ_VALUES = 4_000_000  #: values that a task reads at a time

# Number types of the format (big-endian) and the sizes of all types.
NUMBERS = {3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8}


class Variable(NamedTuple):
    name: str
    kind: str  #: numpy's name of the number type, "" for others
    dimensions: int
    length: int
    begin: int
    step: int  #: bytes from one value to the next


def _number(f: BinaryIO, form: str = ">i") -> int:
    return struct.unpack(form, f.read(struct.calcsize(form)))[0]


def _name(f: BinaryIO) -> str:
    n = _number(f)
    return f.read(n + -n % 4)[:n].decode()


def _skip_attributes(f: BinaryIO) -> None:
    f.read(4)
    for _ in range(_number(f)):
        _name(f)
        size = SIZES[_number(f)] * _number(f)
        f.read(size + -size % 4)


def variables(path: str) -> list[Variable]:
    """What the header says of each variable."""
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic not in (b"CDF\x01", b"CDF\x02"):
            raise ValueError(f"{path}: not a classic netCDF file")
        records = _number(f)
        f.read(4)
        sizes = [(_name(f), _number(f))[1] for _ in range(_number(f))]
        _skip_attributes(f)
        f.read(4)
        found = []
        for _ in range(_number(f)):
            name = _name(f)
            dims = [_number(f) for _ in range(_number(f))]
            _skip_attributes(f)
            kind, size = _number(f), _number(f)
            found.append((name, dims, kind, size, _number(f, ">i" if magic[3] == 1 else ">q")))
    in_record = [v for v in found if v[1] and sizes[v[1][0]] == 0]
    # A lone record variable is packed; else each record holds all of them, padded.
    record = SIZES[in_record[0][2]] if len(in_record) == 1 and len(in_record[0][1]) == 1 else sum(v[3] for v in in_record)
    out = []
    for name, dims, kind, _, begin in found:
        grows = bool(dims) and sizes[dims[0]] == 0
        out.append(Variable(name, NUMBERS.get(kind, ""), len(dims), records if grows else sizes[dims[0]] if dims else 1, begin, record if grows else SIZES[kind]))
    return out


def _values(path: str, v: Variable, a: int, b: int) -> np.ndarray:
    kind = np.dtype(v.kind)
    raw = np.memmap(path, dtype=np.uint8, mode="r", offset=v.begin + a * v.step, shape=((b - a - 1) * v.step + kind.itemsize,))
    return np.ndarray((b - a,), kind, raw, strides=(v.step,)).astype(np.float64)


def read_netcdf(spark: SparkSession, path: str, y: str, x: str | None = None, values: int = READ_VALUES) -> DataFrame:
    """pos, x, y: two one-dimensional variables side by side; without ``x`` the position takes its place.

    Only the header is read on the driver; tasks map ranges of values from the file, which all executors must be
    able to open. Variables of characters or bytes, of other shapes or of unequal length are refused.
    """
    known = {v.name: v for v in variables(path)}
    chosen = [known[name] for name in (x, y) if name is not None]
    if any(v.dimensions != 1 or not v.kind for v in chosen) or len({v.length for v in chosen}) > 1:
        raise ValueError("needs one-dimensional variables of numbers, of equal length")
    n = chosen[0].length
    reach_workers(spark)
    schema = "pos long, x double, y double"
    if not n:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                for a in range(k * values, min(n, (k + 1) * values), 65_536):
                    b = min(a + 65_536, n, (k + 1) * values)
                    pos = np.arange(a, b)
                    series = [_values(path, v, a, b) for v in chosen]
                    yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(pos.astype(np.float64) if x is None else series[0]), pa.array(series[-1])], ["pos", "x", "y"])

    blocks = -(-n // values)
    return spark.range(0, blocks, 1, min(blocks, 10_000)).mapInArrow(read, schema)
