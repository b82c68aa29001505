"""Plain-text sets: columns of numbers, sets parted by separator lines, comments and quoted strings.

Lines are read in blocks and numbered per file. Parting a file into sets sorts its lines in one task,
which spills but doesn't hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.text import number

# Number columns of each type of set.
SET_TYPES = {
    "xy": 2, "bar": 2, "xydx": 3, "xydy": 3, "xyz": 3, "bardy": 3, "xyr": 3, "xycolor": 3, "xysize": 3, "xydxdx": 4, "xydydy": 4, "xydxdy": 4, "bardydy": 4, "xycolpat": 4, "xyvmap": 4,
    "xyhilo": 5, "xydxdxdydy": 6, "xyboxplot": 6,
}
COLUMNS = ("x", "y", "y1", "y2", "y3", "y4")

_TOKEN = r'"(?:[^"\\]|\\.)*"|[^\s"]+'


def tokens(line: Column) -> Column:
    """Words of a line; a quoted string is one word, kept with its quotes."""
    return F.regexp_extract_all(line, F.lit(f"({_TOKEN})"), 1)


def unquoted(word: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(word, '^"|"$', ""), r'\\(.)', "$1")
    return F.when(word.startswith('"'), inner)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (0-based), text of every line of every file.

    Files are read in Spark's blocks. Lines are numbered in each block, from the number of lines in the blocks before.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))  # a block's ids follow each other
    first = blocks.select("file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_first"))
    return raw.join(F.broadcast(first), ["file", "_block"]).select("file", (F.col("_first") + F.col("_at")).alias("line"), F.regexp_replace("value", r"\r$", "").alias("text"))


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of numbers with the set they belong to: file, set, pos, words. Comments (#) and commands (@) are left out."""
    w = Window.partitionBy("file").orderBy("line")
    text = F.trim("text")
    rows = lines(spark, path).withColumn("_t", text).filter(~(F.col("_t").startswith("#") | F.col("_t").startswith("@")))
    rows = rows.withColumn("_gap", ((F.col("_t") == "") | (F.col("_t") == "&")).cast("int"))
    rows = rows.withColumn("_block", F.sum("_gap").over(w)).filter("_gap = 0")
    rows = rows.withColumn("set", F.dense_rank().over(Window.partitionBy("file").orderBy("_block")) - 1)
    return rows.select("file", "set", (F.row_number().over(Window.partitionBy("file", "set").orderBy("line")) - 1).alias("pos"), tokens(F.col("_t")).alias("words"))


def commands(spark: SparkSession, path: str) -> DataFrame:
    """Command lines (@) inside data files, as text: file, line, command. They are never executed."""
    return lines(spark, path).filter(F.ltrim("text").startswith("@")).select("file", "line", F.trim(F.substring_index(F.ltrim("text"), "@", -1)).alias("command"))


def read_sets(spark: SparkSession, path: str, kind: str = "xy") -> DataFrame:
    """Typed sets: file, set, pos, the type's columns, s (the string column).

    Where a row has one number too few, x is the row's position. Words that aren't numbers come out as null.
    """
    n = SET_TYPES[kind]
    rows = data_lines(spark, path)
    text = F.filter("words", lambda t: t.startswith('"'))
    plain = F.filter("words", lambda t: ~t.startswith('"'))
    values = F.transform(plain, lambda t: number(t))
    rows = rows.withColumn("_v", F.when(F.size(values) == n - 1, F.concat(F.array(F.col("pos").cast("double")), values)).otherwise(values)).withColumn("_s", F.get(text, 0))
    return rows.select("file", "set", "pos", *(F.get("_v", k).alias(COLUMNS[k]) for k in range(n)), unquoted(F.col("_s")).alias("s"))


def read_nxy(spark: SparkSession, path: str) -> DataFrame:
    """One x and many y columns as sets that share x: file, set, pos, x, y."""
    rows = data_lines(spark, path).withColumn("_v", F.transform("words", lambda t: number(t)))
    spread = rows.select("file", "pos", F.get("_v", 0).alias("x"), F.posexplode(F.slice("_v", F.lit(2), F.size("_v"))).alias("set", "y"))
    return spread.select("file", "set", "pos", "x", "y")


def read_block(spark: SparkSession, path: str, columns: Sequence[int], string: int | None = None) -> DataFrame:
    """Chosen columns (1-based, 0: the row's position) of a whole table: file, pos, c0, c1, ..., s."""
    rows = data_lines(spark, path)
    made = [(F.col("pos").cast("double") if c == 0 else number(F.get("words", c - 1))).alias(f"c{k}") for k, c in enumerate(columns)]
    return rows.select("file", "pos", *made, *([unquoted(F.get("words", string - 1)).alias("s")] if string else []))


def write_sets(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], kind: str = "xy") -> None:
    """Write sets as text, one file per task: a header line, the rows and a closing ``&`` for each set."""
    row = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.select(*keys, *order, row.alias("_row"), (F.row_number().over(w) == 1).alias("_first"), F.lead(F.lit(True)).over(w).isNull().alias("_last"))
    target = F.concat_ws(".", *(F.col(k).cast("string") for k in keys))
    text = F.concat(F.when(F.col("_first"), F.concat(F.lit("@target "), target, F.lit(f"\n@type {kind}\n"))).otherwise(""), F.col("_row"), F.when(F.col("_last"), F.lit("\n&")).otherwise(""))
    marked.withColumn("text", text).sortWithinPartitions(*keys, *order).select("text").write.text(path)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files in sections ``[ name ]``, comments (;) cut: file, section, line, words. Lines before the first have none."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    clean = F.trim(F.substring_index("text", ";", 1))
    rows = lines(spark, path).withColumn("_t", clean)
    name = F.nullif(F.trim(F.regexp_extract("_t", r"^\[\s*([^\]]+?)\s*\]$", 1)), F.lit(""))
    rows = rows.withColumn("section", F.last(name, ignorenulls=True).over(w))
    return rows.filter((F.col("_t") != "") & ~F.col("_t").startswith("[") & ~F.col("_t").startswith("#")).select("file", "section", "line", F.split("_t", r"\s+").alias("words"))


def write_files(rows: DataFrame, key: str, path: str) -> None:
    """Write lines (``key``, line, text) as one file for each key, below ``key=...``, in order of ``line``."""
    rows.repartition(key).sortWithinPartitions(key, "line").select(key, "text").write.partitionBy(key).text(path)


def key_of(key: str) -> Column:
    """The key of a row's ``file`` as :func:`write_files` named it."""
    return F.regexp_extract("file", f"{key}=([^/]+)/", 1)


def read_itp_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of topologies: file, molecule, nr, kind, resnr, residue, atom, cgnr, charge, mass (null where it isn't given).

    ``molecule`` is the name that the section ``moleculetype`` before the atoms gives.
    """
    rows = sections(spark, path).filter(F.col("section").isin("moleculetype", "atoms"))
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("molecule", F.last(F.when(F.col("section") == "moleculetype", F.get("words", 0)), ignorenulls=True).over(before)).filter("section = 'atoms'")
    word = lambda k, kind: F.get("words", k).try_cast(kind)
    return rows.select(
        "file", "molecule", word(0, "long").alias("nr"), F.get("words", 1).alias("kind"), word(2, "long").alias("resnr"), F.get("words", 3).alias("residue"), F.get("words", 4).alias("atom"),
        word(5, "long").alias("cgnr"), word(6, "double").alias("charge"), word(7, "double").alias("mass"),
    )


def read_contact_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Nonbonded pair parameters of topologies: file, line, kind_i, kind_j, form, sigma, epsilon."""
    rows = sections(spark, path).filter("section = 'nonbond_params'")
    return rows.select("file", "line", F.get("words", 0).alias("kind_i"), F.get("words", 1).alias("kind_j"), F.get("words", 2).try_cast("int").alias("form"), *(F.get("words", k).try_cast("double").alias(n) for k, n in ((3, "sigma"), (4, "epsilon"))))


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """Molecules of systems, in order: file, line, molecule, count."""
    rows = sections(spark, path).filter("section = 'molecules'")
    return rows.select("file", "line", F.get("words", 0).alias("molecule"), F.get("words", 1).try_cast("long").alias("count"))


def topology_lines(molecules: DataFrame, by: str, title: str, include: Sequence[str] = ()) -> DataFrame:
    """Lines of whole topologies from ``by``, pos, molecule, count: ``by``, line, text."""
    head = [*(f'#include "{name}"' for name in include), "", "[ system ]", title, "", "[ molecules ]"]
    first = F.posexplode(F.array(*(F.lit(t) for t in head))).alias("line", "text")
    rows = molecules.select(by, (F.col("pos") + len(head)).cast("int").alias("line"), F.format_string("%-15s %10d", "molecule", "count").alias("text"))
    return molecules.select(by).distinct().select(by, first).unionByName(rows)
