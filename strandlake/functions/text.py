"""Text functions: numbers, names, sequences, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter and one-letter codes of the amino acids.
AMINO_ACIDS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def number(text: Column) -> Column:
    """A double from text; exponents may be written with d or D. Null where it isn't a number."""
    return F.regexp_replace(F.trim(text), "(?<=[0-9.])[dD](?=[+-]?[0-9])", "e").try_cast("double")


def general(v: Column, digits: int = 6) -> Column:
    """A number as C's %g writes it: ``digits`` significant ones, no trailing zeros, exponent where short.

    NaN and infinities come out as nan, inf, -inf.
    """
    size = F.abs(v)
    scientific = F.format_string(f"%.{digits - 1}e", v)
    exponent = F.regexp_extract(scientific, "e([+-][0-9]+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(scientific, "e.*$", ""), r"(\.[0-9]*?)0+$", "$1")
    mantissa = F.regexp_replace(mantissa, r"\.$", "")
    scale = F.when(exponent.between(-4, digits - 1), digits - 1 - exponent)
    fixed = F.coalesce(*(F.when(scale == k, F.format_string(f"%.{k}f", v)) for k in range(digits + 4)))
    fixed = F.regexp_replace(F.when(F.contains(fixed, F.lit(".")), F.regexp_replace(fixed, "0+$", "")).otherwise(fixed), r"\.$", "")
    short = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    plain = F.when(v == 0, F.lit("0")).when(scale.isNotNull(), fixed).otherwise(short)
    special = F.when(F.isnan(v), F.lit("nan")).when(size == float("inf"), F.when(v > 0, F.lit("inf")).otherwise(F.lit("-inf")))
    return F.when(v.isNotNull(), F.coalesce(special, plain))


def amino_acid(code: Column) -> Column:
    """One-letter code from one or three letters in any case; null for anything else."""
    pairs = [x for three, one in AMINO_ACIDS.items() for x in (F.lit(three), F.lit(one))] + [F.lit(one) for one in AMINO_ACIDS.values() for _ in (0, 1)]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(code)))


def mutation_label(wildtype: Column, position: Column, mutant: Column) -> Column:
    return F.concat(wildtype, position.cast("string"), mutant)


def identity(a: Column, b: Column) -> Column:
    """struct(mismatches, percent) of two texts of equal length, position by position; null for unequal ones.

    Two empty texts are identical.
    """
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    n = F.length(a)
    whole = F.struct((n - same).alias("mismatches"), (100.0 * same / n).alias("percent"))
    return F.when(n != F.length(b), None).when(n == 0, F.struct(F.lit(0).alias("mismatches"), F.lit(100.0).alias("percent"))).otherwise(whole)


def composition(spec: Column) -> Column:
    """struct(name, n_abs, w_rel) of NAME, NAME=count or NAME:weight; a bare name weighs 1."""
    part = lambda k: F.regexp_extract(spec, r"^([^=:]+)(?:=(\d+))?(?::([0-9.]+))?$", k)
    absolute, relative = part(2).try_cast("int"), part(3).try_cast("double")
    return F.struct(
        F.trim(part(1)).alias("name"), F.coalesce(absolute, F.lit(0)).alias("n_abs"), F.coalesce(relative, F.when(absolute.isNull(), 1.0).otherwise(0.0)).alias("w_rel")
    )


def int_list(text: Column) -> Column:
    """array<int> from ``[1, 2, 3]``."""
    inner = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.split(inner, ",").cast("array<int>"))


def box_numbers(text: Column) -> Column:
    """The numbers of a box: one (a cube, given as three equal lengths), three, six or nine; null for any other count or a word that isn't a number."""
    values = F.transform(F.split(F.regexp_replace(F.trim(text), "[,;]", " "), r"\s+"), lambda v: v.try_cast("double"))
    whole = F.size(values).isin(1, 3, 6, 9) & ~F.exists(values, lambda v: v.isNull())
    return F.when(whole, F.when(F.size(values) == 1, F.array_repeat(F.get(values, 0), 3)).otherwise(values))


def with_prefix(name: Column, prefix: str) -> Column:
    """``prefix.name``, unless the name has a prefix already."""
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(F.lit(prefix + "."), name))


def without_prefix(name: Column) -> Column:
    """What follows the first dot; the whole name where there is none."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name)
