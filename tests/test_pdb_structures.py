"""Many structures in few PDB files: as many files as tasks, every atom under its own title again, unknown names included."""

import gzip
from pathlib import Path

from strandlake.plans import files
from strandlake.sources import structure


def test_structures_share_files(spark, tmp_path):
    rows = [(None if s == 7 else f"s{s}", i, i + 1, "GLY", "BB", "A", s / 10, i / 10, -1.0) for s in range(300) for i in range(1 + s % 4)]
    atoms = spark.createDataFrame(rows, "s string, idx long, resid long, resname string, name string, chain string, x double, y double, z double")
    structure.write_pdb_structures(atoms, f"{tmp_path}/pdb", "s", (4.0, 6.0, 5.0))
    written = sorted(Path(tmp_path, "pdb").glob("*.gz"))
    assert 0 < len(written) <= 16
    lines = [x for p in written for x in gzip.open(p, "rt").read().split("\n")]
    assert sum(x.startswith("TITLE") for x in lines) == sum(x.startswith("CRYST1   40.000   60.000   50.000") for x in lines) == lines.count("END") == 300
    got = {(r.structure, r.line - 2, r.resid, r.x, r.y, r.z) for r in structure.read_pdb_structures(spark, f"{tmp_path}/pdb").collect()}
    assert got == {(r[0], r[1], r[2], r[6] * 10 / 10, r[7] * 10 / 10, -1.0) for r in rows} and len(got) == len(rows)


def test_plain_file_in_blocks(spark, tmp_path):
    atom = "ATOM  %5d CA   GLY A%4d    %8.3f%8.3f%8.3f  1.00  0.00"
    text = "REMARK none\n" + atom % (1, 9, 0, 0, 0) + "\n" + "".join(f"TITLE     p {k}\nTITLE    2 goes on\n" + "".join(atom % (i, i, k, 0, 0) + "\n" for i in range(5)) + "END\n" for k in range(40))
    Path(tmp_path, "a.pdb").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = [(r.structure, r.line, r.resid) for r in structure.read_pdb_structures(spark, f"{tmp_path}/a.pdb").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got, key=str) == sorted([(None, 1, 9), *((f"p {k}", i + 2, i) for k in range(40) for i in range(5))], key=str)


def test_query_writes_few_files(spark, small, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "shared_path", lambda spark, what: f"{tmp_path}/{what}")
    assert files.pdb_files(spark, small).count() == 1000
    assert len([p for p in Path(tmp_path).rglob("part-*") if p.is_file()]) <= 8
