"""Analytics of replica-exchange runs: rates, flow, round trips, acceptance probabilities, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.aggregates import rate

Names = Sequence[str]
GAS_CONSTANT = 0.00831446261815324  #: kJ/(mol K)


def acceptance(messages: DataFrame, by: Names) -> DataFrame:
    """Attempts, accepted ones and their rate for each pair and for all together (null pair): by, pair_i, pair_j, ..."""
    total = messages.rollup(*by, F.struct("pair_i", "pair_j").alias("pair")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("accepted"), F.grouping_id().alias("_g")
    )
    whole = total.filter(F.col("_g") <= 1)
    return whole.select(*by, "pair.pair_i", "pair.pair_j", "attempts", "accepted", rate(F.col("accepted"), F.col("attempts")).alias("rate"))


def flagged_rates(rates: DataFrame, low: float = 0.10, high: float = 0.60, least: int = 10) -> DataFrame:
    """Pairs with more than ``least`` attempts whose rate is under ``low`` or over ``high``: adds flag."""
    flag = F.when(F.col("rate") < low, "low").when(F.col("rate") > high, "high")
    return rates.filter(F.col("attempts") > least).withColumn("flag", flag).filter("flag IS NOT NULL")


def metropolis(delta: Column, temperature: Column) -> Column:
    """min(1, exp(-delta / RT)); 1 where delta is not positive, null where it is null or NaN."""
    return F.when(delta <= 0, 1.0).when(delta.isNotNull() & ~F.isnan(delta), F.least(F.lit(1.0), F.exp(-delta / (GAS_CONSTANT * temperature))))


def checkpoints(df: DataFrame) -> DataFrame:
    """Saved states without the second copy of the last one, by the file name."""
    return df.filter(~F.coalesce(F.contains("file_name", F.lit("latest")), F.lit(False)))


def pair_rates(df: DataFrame) -> DataFrame:
    """Per checkpoint and neighbouring pair: attempts, accepted, rate; pairs absent from the maps have 0."""
    pairs = df.withColumn("pair_i", F.explode(F.expr("CASE WHEN n_replicas > 1 THEN sequence(0, n_replicas - 2) ELSE array() END")))
    key = F.concat_ws("-", F.col("pair_i"), F.col("pair_i") + 1)
    counts = pairs.select(
        "run_id", "cycle_no", "pair_i", (F.col("pair_i") + 1).alias("pair_j"),
        F.coalesce(F.try_element_at("pair_attempts", key), F.lit(0)).alias("attempts"), F.coalesce(F.try_element_at("pair_accepts", key), F.lit(0)).alias("accepted"),
    )
    return counts.withColumn("rate", rate(F.col("accepted"), F.col("attempts")))


def flow(df: DataFrame) -> DataFrame:
    """Which replica stands in which slot at each checkpoint: run_id, cycle_no, slot, replica."""
    return df.select("run_id", "cycle_no", F.posexplode("permutation").alias("slot", "replica"))


def energy_series(df: DataFrame) -> DataFrame:
    """Energies per checkpoint and replica, without nulls and zeros: run_id, cycle_no, replica_index, energy."""
    rows = df.select("run_id", "cycle_no", F.explode("replica_states").alias("s"))
    return rows.select("run_id", "cycle_no", "s.replica_index", F.col("s.potential_energy").alias("energy")).filter("energy IS NOT NULL AND energy <> 0")


def round_trips(df: DataFrame, keys: Names, order: str, state: str, top: Column) -> DataFrame:
    """Trips of each walker from the top state down to state 0: keys, trips, first_end, last_end.

    Only visits to the two ends matter; a visit to 0 after one to the top ends a trip.
    Walkers without a trip have 0.
    """
    marked = df.withColumn("_end", F.when(F.col(state) == 0, 0).when(F.col(state) == top, 1))
    visits = marked.filter("_end IS NOT NULL").withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy(order)))
    trips = visits.filter("_end = 0 AND _before = 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("trips"), F.min(order).alias("first_end"), F.max(order).alias("last_end"))
    walkers = df.select(*keys).distinct()
    return walkers.join(trips, list(keys), "left").withColumn("trips", F.coalesce("trips", F.lit(0)))


# The log of a run: a line for each attempted pair, and every few cycles, after its pairs, a report of the cycle with the
# pairs' rates and the permutation. A pair's line doesn't tell its cycle: what can be read is the cycle reported last before it.

# The patterns of a log's lines.
_NUMBER = r"(\S+)"
CYCLE_LINE = r"Cycle\s+(\d+)\s+\|.*Accept:\s+([0-9.]+)%\s+\|.*Elapsed:\s+([0-9.]+)s"
PAIR_LINE = rf"Pair \((\d+),(\d+)\): V_go_i={_NUMBER} V_go_j={_NUMBER} ΔΔU={_NUMBER} P={_NUMBER} (\w+)"
PERMUTATION_LINE = r"Permutation: \[([-0-9, ]*)\]"
RATES_LINE = r"Pair rates: (.+)"


def log_lines(messages: DataFrame, every: int = 10, segment_ps: float = 100.0) -> DataFrame:
    """Messages as log lines: run_id, line (order), text.

    The lines of a cycle's pairs come first; its report follows where the cycle's number from 1 is divisible by ``every``, and after
    a run's first cycle. Reports print that number and the acceptance so far. Columns ``energy_i`` and ``energy_j`` are printed if there are any, else 0.
    """
    shown = lambda c: F.coalesce((F.col(c) if c in messages.columns else F.lit(0.0)).cast("string"), F.lit("nan"))
    pair = messages.select(
        "run_id", F.struct("cycle_no", F.lit(0).alias("kind"), F.col("pair_i").alias("pair"), F.col("launch_no").alias("launch")).alias("line"),
        F.concat(
            F.lit("  Pair ("), F.col("pair_i"), F.lit(","), F.col("pair_j"), F.lit("): V_go_i="), shown("energy_i"), F.lit(" V_go_j="), shown("energy_j"), F.lit(" ΔΔU="), shown("delta_energy"),
            F.lit(" P="), shown("probability"), F.when(F.col("accepted"), F.lit(" SWAP")).otherwise(F.lit(" keep")),
        ).alias("text"),
    )
    cycles = messages.groupBy("run_id", "cycle_no").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("k"))
    w = Window.partitionBy("run_id").orderBy("cycle_no").rowsBetween(Window.unboundedPreceding, 0)
    cycles = cycles.withColumns({"rate": 100 * F.sum("k").over(w) / F.sum("n").over(w), "first": F.first("cycle_no").over(w)})
    number = F.col("cycle_no") + 1
    text = F.format_string("Cycle %6d | Time: %8.1f ns | Accept: %5.1f%% | Elapsed: %6.1fs", number, number * segment_ps / 1000, "rate", F.lit(0.0))
    report = cycles.filter((number % every == 0) | (F.col("cycle_no") == F.col("first")))
    report = report.select("run_id", F.struct("cycle_no", F.lit(1).alias("kind"), F.lit(0).alias("pair"), F.lit(0).alias("launch")).alias("line"), text.alias("text"))
    return pair.unionByName(report)


def _cycle_of() -> Column:
    return F.nullif(F.regexp_extract("text", CYCLE_LINE, 1), F.lit("")).try_cast("bigint")


def reported_cycle(lines: DataFrame, keys: Names, order: str, stretch: Column) -> DataFrame:
    """Lines with ``attributed_cycle``: that of the last report before each in its log, 0 before the first.

    ``stretch`` never falls as ``order`` rises and cuts a log into pieces that are filled on their own; only the last report of
    each piece passes on to the pieces after it, so no log has to pass through one task.
    """
    rows = lines.withColumns({"_stretch": stretch, "_cycle": _cycle_of()})
    last = F.max_by("_cycle", F.when(F.col("_cycle").isNotNull(), F.col(order)))
    pieces = rows.groupBy(*keys, "_stretch").agg(last.alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*keys, "_stretch", F.last("_c", ignorenulls=True).over(before).alias("_carried"))
    own = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.last("_cycle", ignorenulls=True).over(own)).join(pieces, [*keys, "_stretch"])
    return rows.withColumn("attributed_cycle", F.coalesce("_own", "_carried", F.lit(0))).drop("_stretch", "_cycle", "_own", "_carried")


def parsed_log(lines: DataFrame, keys: Names = ("run_id",), order: str = "line", stretch: Column | None = None) -> DataFrame:
    """Pair lines of logs: keys, attributed_cycle, pair_i, pair_j, energy_i, energy_j, delta_energy, probability, accepted.

    See :func:`reported_cycle`. Lines of other kinds are passed over; a number that can't be read is null. Logs without lines of pairs give no rows.
    """
    text = F.col("text")
    part = lambda k: F.regexp_extract(text, PAIR_LINE, k)
    rows = lines.filter(text.contains("Pair (") | text.contains("Cycle"))
    rows = reported_cycle(rows, keys, order, F.lit(0) if stretch is None else stretch).filter(text.rlike(PAIR_LINE))
    return rows.select(
        *keys, "attributed_cycle", part(1).try_cast("int").alias("pair_i"), part(2).try_cast("int").alias("pair_j"), *(part(k).try_cast("double").alias(n) for k, n in ((3, "energy_i"), (4, "energy_j"), (5, "delta_energy"), (6, "probability"))),
        (part(7) == "SWAP").alias("accepted"),
    )


def parsed_reports(lines: DataFrame, keys: Names = ("run_id",), order: str = "line", stretch: Column | None = None) -> DataFrame:
    """Reports of logs, one row for each: keys, cycle_no, accept (percent), elapsed (s), rates (percent, by pair), permutation.

    The rates and the permutation stand in lines of their own after the cycle's; null where a report lacks them.
    """
    text = F.col("text")
    rows = lines.filter(text.contains("Cycle") | text.contains("Pair rates:") | text.contains("Permutation:"))
    rows = reported_cycle(rows, keys, order, F.lit(0) if stretch is None else stretch)
    value = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    rates = F.transform(F.split(value(RATES_LINE, 1), r"\s*\|\s*"), lambda v: F.rtrim(F.regexp_replace(v, "%", "")).try_cast("double"))
    permutation = F.transform(F.split(value(PERMUTATION_LINE, 1), r"\s*,\s*"), lambda v: F.trim(v).try_cast("int"))
    first = lambda c: F.first(c, ignorenulls=True)
    out = rows.groupBy(*keys, F.col("attributed_cycle").alias("cycle_no")).agg(
        first(value(CYCLE_LINE, 2).try_cast("double")).alias("accept"), first(value(CYCLE_LINE, 3).try_cast("double")).alias("elapsed"), first(rates).alias("rates"), first(permutation).alias("permutation")
    )
    return out.filter("accept IS NOT NULL")
