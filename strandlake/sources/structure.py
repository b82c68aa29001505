"""Fixed-width structure files: positions in nm (GRO) or Angstrom (PDB)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.sources.text import lines


def _cut(a: int, b: int) -> Column:
    return F.trim(F.substring("text", a + 1, b - a))


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """Atoms: file, idx, resid, resname, name, x, y, z. The box is read by :func:`read_gro_box`."""
    rows = lines(spark, path)
    count = F.max(F.when(F.col("line") == 1, F.trim("text").try_cast("int"))).over(Window.partitionBy("file"))
    atoms = rows.withColumn("_n", count).filter((F.col("line") >= 2) & (F.col("line") < F.col("_n") + 2))
    x, y, z = (_cut(a, a + 8).try_cast("double") for a in (20, 28, 36))
    return atoms.select("file", (F.col("line") - 2).alias("idx"), _cut(0, 5).try_cast("int").alias("resid"), _cut(5, 10).alias("resname"), _cut(10, 15).alias("name"), x.alias("x"), y.alias("y"), z.alias("z"))


def read_gro_box(spark: SparkSession, path: str) -> DataFrame:
    """file, box: 3 or 9 numbers of the last line."""
    rows = lines(spark, path)
    count = F.max(F.when(F.col("line") == 1, F.trim("text").try_cast("int"))).over(Window.partitionBy("file"))
    last = rows.withColumn("_n", count).filter(F.col("line") == F.col("_n") + 2)
    return last.select("file", F.transform(F.split(F.trim("text"), r"\s+"), lambda v: v.cast("double")).alias("box"))


def _pdb_atoms(rows: DataFrame, *place: str) -> DataFrame:
    rows = rows.withColumn("_r", _cut(0, 6)).filter(F.col("_r").isin("ATOM", "HETATM"))
    x, y, z = ((_cut(a, a + 8).try_cast("double") / 10) for a in (30, 38, 46))
    return rows.select(
        *place, "line", F.col("_r").alias("record"), _cut(6, 11).try_cast("int").alias("serial"), _cut(12, 16).alias("name"), _cut(17, 20).alias("resname"), _cut(21, 22).alias("chain"),
        _cut(22, 26).try_cast("int").alias("resid"), x.alias("x"), y.alias("y"), z.alias("z"), _cut(54, 60).try_cast("double").alias("occupancy"), _cut(60, 66).try_cast("double").alias("b"),
    )


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms: file, line, record, serial, name, resname, chain, resid, x, y, z (nm), occupancy, b (radius in sphere files)."""
    return _pdb_atoms(lines(spark, path), "file")


_TITLE = "TITLE     "  #: begins a structure; lines that go on with its title have a number there


def read_pdb_structures(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of files that hold many structures: file, structure (its title, null if blank), line (0: that of the title), then as :func:`read_pdb`.

    Parting a file into structures sorts its lines in one task, which spills but doesn't hold them. Lines before the first title have no structure.
    """
    titled = F.when(F.col("text").startswith(_TITLE), F.struct(F.col("line").alias("at"), F.nullif(F.trim(F.substring("text", len(_TITLE) + 1, 1 << 20)), F.lit("")).alias("name")))
    last = F.last(titled, ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines(spark, path).withColumn("_t", last)
    return _pdb_atoms(rows.select("file", F.col("_t.name").alias("structure"), (F.col("line") - F.coalesce("_t.at", F.lit(0))).alias("line"), "text"), "file", "structure")


def _gro_text() -> Column:
    return F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.col("resid") % 100000, "resname", "name", (F.col("idx") + 1) % 100000, "x", "y", "z")


def gro_lines(atoms: DataFrame) -> DataFrame:
    """Fixed-width lines of atoms (idx, resid, resname, name, x, y, z): idx, text. Numbers wrap at 100000."""
    return atoms.select("idx", _gro_text().alias("text"))


def _pdb_text() -> Column:
    return F.format_string(
        "ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", (F.col("idx") + 1) % 100000, "name", "resname", "chain", F.col("resid") % 10000, F.col("x") * 10, F.col("y") * 10, F.col("z") * 10, F.lit(1.0), F.lit(0.0)
    )


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """ATOM lines of atoms in nm: idx, text. Numbers wrap at 100000 and 10000."""
    return atoms.select("idx", _pdb_text().alias("text"))


def gro_file_lines(atoms: DataFrame, by: str, title: str, box: tuple[float, ...]) -> DataFrame:
    """Lines of whole GRO files from ``by`` and the atoms of :func:`gro_lines`: title, number of atoms, atoms, box: ``by``, line, text."""
    rows = atoms.select(by, (F.col("idx") + 2).cast("long").alias("line"), _gro_text().alias("text"))
    size = atoms.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    last = " ".join(f"{v:.5f}" for v in box)
    frame = F.array(*(F.struct(line.cast("long").alias("line"), text.cast("string").alias("text")) for line, text in ((F.lit(0), F.lit(title)), (F.lit(1), F.col("n")), (F.col("n") + 2, F.lit(last)))))
    return rows.unionByName(size.select(by, F.explode(frame).alias("f")).select(by, "f.line", "f.text"))


def _pdb_cell(box: tuple[float, float, float]) -> str:
    return "CRYST1" + "".join(f"{10 * v:9.3f}" for v in box) + "  90.00  90.00  90.00 P 1           1"


def pdb_file_lines(atoms: DataFrame, by: str, box: tuple[float, float, float]) -> DataFrame:
    """Lines of whole PDB files from ``by`` and the atoms of :func:`pdb_lines`: cell, atoms, end: ``by``, line, text."""
    rows = atoms.select(by, (F.col("idx") + 1).cast("long").alias("line"), _pdb_text().alias("text"))
    ends = F.array(F.struct(F.lit(0).cast("long").alias("line"), F.lit(_pdb_cell(box)).alias("text")), F.struct((F.col("n") + 1).alias("line"), F.lit("END").alias("text")))
    return rows.unionByName(atoms.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select(by, F.explode(ends).alias("f")).select(by, "f.line", "f.text"))


def write_pdb_structures(atoms: DataFrame, path: str, by: str, box: tuple[float, float, float]) -> None:
    """Write the atoms of :func:`pdb_lines` as structures, one for each ``by``: its title, cell, atoms, end. Each task writes all of its own to one compressed file."""
    w = Window.partitionBy(by).orderBy("idx")
    head = F.concat(F.lit(_TITLE), F.coalesce(F.col(by).cast("string"), F.lit("")), F.lit(f"\n{_pdb_cell(box)}\n"))
    marked = atoms.withColumns({"_first": F.row_number().over(w) == 1, "_last": F.lead(F.lit(True)).over(w).isNull()})
    text = F.concat(F.when(F.col("_first"), head).otherwise(""), _pdb_text(), F.when(F.col("_last"), F.lit("\nEND")).otherwise(""))
    marked.sortWithinPartitions(by, "idx").select(text.alias("text")).write.text(path, compression="gzip")


def selected(atoms: DataFrame, names: list[str] | None = None, residues: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Atoms of these names, residue names and residue numbers from ``first`` to ``last``; a null doesn't count as any."""
    for column, wanted in (("name", names), ("resname", residues)):
        atoms = atoms if wanted is None else atoms.filter(F.col(column).isin(wanted))
    if first is not None:
        atoms = atoms.filter(F.col("resid") >= first)
    return atoms if last is None else atoms.filter(F.col("resid") <= last)
