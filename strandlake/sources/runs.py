"""Files of exchange runs: checkpoints as JSON, ladders, mutation lists, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.text import number
from strandlake.operators.exchange import parsed_log, parsed_reports
from strandlake.sources.text import lines

CHECKPOINT = """
system string, cycle long, n_replicas int, lambdas array<double>, temperature double, permutation array<int>, total_exchanges_attempted long, total_exchanges_accepted long,
pair_attempts map<string, long>, pair_accepts map<string, long>, replica_states array<struct<index int, state_index int, lam double, potential_energy double>>"""


def read_checkpoints(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """One row per file; without ``latest`` the second copy of the last state is left out."""
    df = spark.read.schema(CHECKPOINT).json(path, multiLine=True).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df if latest else df.filter(~F.contains("file_name", F.lit("latest")))


def read_ladder(spark: SparkSession, path: str) -> DataFrame:
    """replica, lam: the second word of each line that isn't a comment."""
    rows = lines(spark, path).filter(~F.ltrim("text").startswith("#") & (F.trim("text") != "")).withColumn("_w", F.split(F.trim("text"), r"\s+"))
    return rows.select("file", F.get("_w", 0).try_cast("int").alias("replica"), number(F.get("_w", 1)).alias("lam"))


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """chain, position, wildtype, mutant; comments and malformed lines are passed over."""
    rows = lines(spark, path).filter(~F.ltrim("text").startswith("#")).withColumn("_w", F.split(F.trim("text"), r"\s+")).filter(F.size("_w") == 4)
    out = rows.select("file", F.col("_w")[0].alias("chain"), F.col("_w")[1].try_cast("int").alias("position"), F.upper(F.col("_w")[2]).alias("wildtype"), F.upper(F.col("_w")[3]).alias("mutant"))
    return out.filter("position IS NOT NULL")


STRETCH = 200_000  #: lines of a log that are numbered on their own


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Pair lines of log files with the cycle reported before them; see :func:`parsed_log`."""
    return parsed_log(lines(spark, path), ["file"], "line", F.floor(F.col("line") / STRETCH))


def read_log_reports(spark: SparkSession, path: str) -> DataFrame:
    """Cycle reports of log files; see :func:`parsed_reports`."""
    return parsed_reports(lines(spark, path), ["file"], "line", F.floor(F.col("line") / STRETCH))


def read_energies(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """file, line, name, value: lines of an energy tool that name one of ``terms`` and carry a number as second word."""
    rows = lines(spark, path).withColumn("_w", F.split(F.trim("text"), r"\s+"))
    named = rows.filter(F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains("text", t)))
    return named.select("file", "line", F.get("_w", 0).alias("name"), number(F.get("_w", 1)).alias("value")).filter("value IS NOT NULL")


def scaled_contacts(rows: DataFrame, lam: float, native: float) -> DataFrame:
    """Contact lines (column ``text``) with the fifth word replaced by ``native`` times ``lam``; all other lines as they are."""
    body, note = F.split_part("text", F.lit(";"), F.lit(1)), F.regexp_extract("text", "(;.*)$", 1)
    words = F.split(F.trim(body), r"\s+")
    data = ~F.ltrim("text").startswith(";") & ~F.ltrim("text").startswith("[") & (F.size(words) >= 5)
    new = F.format_string("%30s %30s %2s %14s %14s %s", *(F.get(words, k) for k in range(4)), F.format_string("%.8f", F.lit(native * lam)), note)
    return rows.withColumn("text", F.when(data, new).otherwise(F.col("text")))


def checkpoint_lines(states: DataFrame) -> DataFrame:
    """Saved states, with columns as in ``hremc_checkpoint``, as one JSON text for each file: file_name, line, text."""
    replica = F.transform("replica_states", lambda s: F.struct(s["replica_index"].alias("index"), s["state_index"].alias("state_index"), s["lam"].alias("lam"), s["potential_energy"].alias("potential_energy")))
    body = F.struct(
        F.col("run_id").alias("system"), F.col("cycle_no").alias("cycle"), "n_replicas", "lambdas", "permutation", F.col("total_attempted").alias("total_exchanges_attempted"),
        F.col("total_accepted").alias("total_exchanges_accepted"), "pair_attempts", "pair_accepts", replica.alias("replica_states"),
    )
    return states.select("file_name", F.lit(0).alias("line"), F.to_json(body).alias("text"))
