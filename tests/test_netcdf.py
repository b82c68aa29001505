"""Classic netCDF files written by hand."""

import struct

import numpy as np
import pytest

from strandlake.sources import netcdf


def text(s):
    return struct.pack(">i", len(s)) + s.encode().ljust(len(s) + -len(s) % 4, b"\0")


def make(path, fixed, growing, version=1):
    """fixed, growing: name -> array; the growing ones share the record dimension."""
    n, records = (len(next(iter(g.values()))) if g else 0 for g in (fixed, growing))
    kinds = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}
    pad = lambda b: b + b"\0" * (-len(b) % 4)

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", records) + struct.pack(">ii", 10, 2) + text("n") + struct.pack(">i", n) + text("time") + struct.pack(">i", 0)
        out += struct.pack(">ii", 12, 1) + text("title") + struct.pack(">ii", 2, 3) + pad(b"abc") + struct.pack(">ii", 11, len(fixed) + len(growing))
        for name, a in {**fixed, **growing}.items():
            size = a.dtype.itemsize * (len(a) if name in fixed else 1)
            out += text(name) + struct.pack(">ii", 1, 0 if name in fixed else 1) + struct.pack(">ii", 0, 0) + struct.pack(">ii", kinds[a.dtype.str[1:]], size + -size % 4)
            out += struct.pack(">i" if version == 1 else ">q", begins.get(name, 0))
        return out

    at, begins = len(header({})), {}
    body = b""
    for name, a in fixed.items():
        begins[name] = at + len(body)
        body += pad(a.astype(a.dtype.newbyteorder(">")).tobytes())
    packed = (lambda b: b) if len(growing) == 1 else pad
    for k in range(records):
        for name, a in growing.items():
            begins.setdefault(name, at + len(body))
            body += packed(a[k : k + 1].astype(a.dtype.newbyteorder(">")).tobytes())
    path.write_bytes(header(begins) + body)
    return str(path)


@pytest.mark.parametrize("version", [1, 2])
def test_read(spark, tmp_path, version):
    fixed = {"x": np.arange(1000) / 8, "count": (np.arange(1000) - 500).astype("i2")}
    growing = {"t": np.linspace(0, 1, 77).astype("f4"), "s": np.arange(77).astype("i2"), "v": np.arange(77).astype("i4")}
    path = make(tmp_path / "a.nc", fixed, growing, version)
    got = netcdf.read_netcdf(spark, path, "count", "x", values=300).orderBy("pos").toPandas()
    assert np.array_equal(got.x, fixed["x"]) and np.array_equal(got.y, fixed["count"]) and list(got.pos) == list(range(1000))
    got = netcdf.read_netcdf(spark, path, "s", "t").orderBy("pos").toPandas()
    assert np.array_equal(got.x, growing["t"].astype(float)) and np.array_equal(got.y, growing["s"])
    assert np.array_equal(netcdf.read_netcdf(spark, path, "v").orderBy("pos").toPandas().x, np.arange(77))
    with pytest.raises(ValueError):
        netcdf.read_netcdf(spark, path, "v", "x")


def test_lone_record_variable_and_none(spark, tmp_path):
    path = make(tmp_path / "b.nc", {}, {"s": np.arange(9).astype("i2")})
    assert [r.y for r in netcdf.read_netcdf(spark, path, "s").orderBy("pos").collect()] == list(map(float, range(9)))
    assert netcdf.read_netcdf(spark, make(tmp_path / "c.nc", {}, {"s": np.zeros(0, "i2")}), "s").count() == 0
    (tmp_path / "d.nc").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        netcdf.variables(str(tmp_path / "d.nc"))
