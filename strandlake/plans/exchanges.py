"""Queries of the replica-exchange analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import exchange as X
from strandlake.operators.messages import one_copy
from strandlake.plans.common import STATES_SQL, rounded, trajectories
from strandlake.session import shared_path, table
from strandlake.sources import runs as R
from strandlake.sources.text import key_of, write_files

QUERIES, SQL = {}, {}


def _messages(spark, d):
    return one_copy(table(spark, d, "exchange_record"), "delta_energy", "accepted").filter("pair_i IS NOT NULL")


_MESSAGES = r"""
WITH r AS (
  SELECT *, CAST(regexp_extract(pair, '(\d+)\D+(\d+)', 1) AS INTEGER) AS a, CAST(regexp_extract(pair, '(\d+)\D+(\d+)', 2) AS INTEGER) AS b
  FROM exchange_record),
k AS (SELECT *, least(a, b) AS pair_i, greatest(a, b) AS pair_j, row_number() OVER (
    PARTITION BY run_id, launch_no, cycle_no, least(a, b), greatest(a, b) ORDER BY received_at NULLS LAST, record_id) AS n FROM r),
m AS (SELECT * FROM k WHERE n = 1)"""


def acceptance_rollup(spark, d):
    return rounded(X.acceptance(_messages(spark, d), []), "rate")


SQL["acceptance_rollup"] = (
    _MESSAGES
    + """SELECT pair_i, pair_j, count(*) AS attempts, count(*) FILTER (accepted) AS accepted, round(count(*) FILTER (accepted) / count(*), 6) + 0.0 AS rate
FROM m GROUP BY GROUPING SETS ((pair_i, pair_j), ())"""
)


def acceptance_by_run(spark, d):
    return rounded(X.acceptance(_messages(spark, d), ["run_id"]), "rate")


SQL["acceptance_by_run"] = (
    _MESSAGES
    + """SELECT run_id, pair_i, pair_j, count(*) AS attempts, count(*) FILTER (accepted) AS accepted, round(count(*) FILTER (accepted) / count(*), 6) + 0.0 AS rate
FROM m GROUP BY GROUPING SETS ((run_id, pair_i, pair_j), (run_id))"""
)


def acceptance_flags(spark, d):
    rates = X.acceptance(_messages(spark, d), ["run_id"]).filter("pair_i IS NOT NULL")
    return rounded(X.flagged_rates(rates), "rate")


SQL["acceptance_flags"] = (
    _MESSAGES
    + """, q AS (SELECT run_id, pair_i, pair_j, count(*) AS attempts, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted) / count(*) AS rate FROM m GROUP BY 1, 2, 3)
SELECT run_id, pair_i, pair_j, attempts, accepted, round(rate, 6) + 0.0 AS rate, CASE WHEN rate < 0.1 THEN 'low' ELSE 'high' END AS flag FROM q WHERE attempts > 10 AND (rate < 0.1 OR rate > 0.6)"""
)


def metropolis_probability(spark, d):
    """Probability of each attempt from its energy difference and the run's temperature."""
    runs = table(spark, d, "hremc_run").select("run_id", "temperature")
    p = _messages(spark, d).join(runs, "run_id").select("run_id", "launch_no", "cycle_no", "pair_i", "pair_j", X.metropolis(F.col("delta_energy"), F.col("temperature")).alias("p"))
    return rounded(p, "p")


SQL["metropolis_probability"] = (
    _MESSAGES
    + f"""SELECT run_id, launch_no, cycle_no, pair_i, pair_j,
  round(CASE WHEN delta_energy <= 0 THEN 1.0 WHEN NOT isnan(delta_energy) THEN least(1.0, exp(-delta_energy / ({X.GAS_CONSTANT!r}::DOUBLE * temperature))) END, 6) + 0.0 AS p
FROM m JOIN hremc_run USING (run_id)"""
)


def checkpoint_pair_rates(spark, d):
    return rounded(X.pair_rates(X.checkpoints(table(spark, d, "hremc_checkpoint"))), "rate")


_SAVED = "WITH c AS (SELECT * FROM hremc_checkpoint WHERE NOT contains(coalesce(file_name, ''), 'latest'))"
SQL["checkpoint_pair_rates"] = (
    _SAVED
    + """, p AS (SELECT run_id, cycle_no, pair_attempts, pair_accepts, unnest(generate_series(0, n_replicas - 2))::INTEGER AS pair_i FROM c),
q AS (SELECT run_id, cycle_no, pair_i, pair_i + 1 AS pair_j, coalesce(pair_attempts[pair_i || '-' || (pair_i + 1)], 0) AS attempts, coalesce(pair_accepts[pair_i || '-' || (pair_i + 1)], 0) AS accepted FROM p)
SELECT *, round(CASE WHEN attempts > 0 THEN accepted / attempts ELSE 0 END, 6) + 0.0 AS rate FROM q"""
)


def replica_flow(spark, d):
    return X.flow(X.checkpoints(table(spark, d, "hremc_checkpoint")))


SQL["replica_flow"] = _SAVED + " SELECT run_id, cycle_no, (generate_subscripts(permutation, 1) - 1)::INTEGER AS slot, unnest(permutation) AS replica FROM c"


def replica_occupancy(spark, d):
    """How often each replica stood in each slot of its run: the flow matrix, summed up."""
    return X.flow(X.checkpoints(table(spark, d, "hremc_checkpoint"))).groupBy("run_id", "slot", "replica").agg(F.count(F.lit(1)).alias("n"))


SQL["replica_occupancy"] = (
    _SAVED + ", f AS (SELECT run_id, (generate_subscripts(permutation, 1) - 1)::INTEGER AS slot, unnest(permutation) AS replica FROM c) SELECT run_id, slot, replica, count(*) AS n FROM f GROUP BY 1, 2, 3"
)


def checkpoint_energies(spark, d):
    e = X.energy_series(X.checkpoints(table(spark, d, "hremc_checkpoint"))).filter("NOT isnan(energy) AND abs(energy) < 1e12")
    return rounded(e, "energy", digits=2)


SQL["checkpoint_energies"] = (
    _SAVED
    + """, s AS (SELECT run_id, cycle_no, unnest(replica_states) AS s FROM c)
SELECT run_id, cycle_no, s.replica_index AS replica_index, round(s.potential_energy, 2) + 0.0 AS energy FROM s
WHERE s.potential_energy <> 0 AND NOT isnan(s.potential_energy) AND abs(s.potential_energy) < 1e12"""
)


def checkpoint_totals(spark, d):
    """Overall acceptance at each checkpoint, per run, with the gain since the one before."""
    c = X.checkpoints(table(spark, d, "hremc_checkpoint")).select("run_id", "cycle_no", "total_attempted", "total_accepted")
    w = X.Window.partitionBy("run_id").orderBy("cycle_no")
    c = c.withColumn("new_attempts", F.col("total_attempted") - F.coalesce(F.lag("total_attempted").over(w), F.lit(0)))
    return rounded(c.withColumn("rate", X.rate(F.col("total_accepted"), F.col("total_attempted"))), "rate")


SQL["checkpoint_totals"] = (
    _SAVED
    + """SELECT run_id, cycle_no, total_attempted, total_accepted, total_attempted - coalesce(lag(total_attempted) OVER (PARTITION BY run_id ORDER BY cycle_no), 0) AS new_attempts,
  round(CASE WHEN total_attempted > 0 THEN total_accepted / total_attempted ELSE 0 END, 6) + 0.0 AS rate FROM c"""
)


def round_trips(spark, d):
    runs = table(spark, d, "hremc_run").select("run_id", (F.col("n_replicas") - 1).alias("top"))
    return X.round_trips(trajectories(spark, d).join(runs, "run_id"), ["run_id", "replica_index"], "cycle_no", "state", F.col("top"))


SQL["round_trips"] = (
    STATES_SQL
    + """, v AS (SELECT run_id, replica_index, cycle_no, state, n_replicas - 1 AS top FROM t JOIN hremc_run USING (run_id)),
e AS (SELECT run_id, replica_index, cycle_no, CASE WHEN state = 0 THEN 0 ELSE 1 END AS e FROM v WHERE state IN (0, top)),
b AS (SELECT *, lag(e) OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no) AS p FROM e),
r AS (SELECT run_id, replica_index, count(*) AS trips, min(cycle_no) AS first_end, max(cycle_no) AS last_end FROM b WHERE e = 0 AND p = 1 GROUP BY 1, 2)
SELECT w.run_id, w.replica_index, coalesce(trips, 0) AS trips, first_end, last_end FROM (SELECT DISTINCT run_id, replica_index FROM v) w LEFT JOIN r USING (run_id, replica_index)"""
)


def _logged(spark, d):
    messages = one_copy(table(spark, d, "exchange_record"), "delta_energy", "probability", "accepted").filter("pair_i IS NOT NULL")
    return X.log_lines(messages)


def log_parse(spark, d):
    """The messages written as log lines and read back, each pair with the cycle reported before it."""
    found = X.parsed_log(_logged(spark, d), stretch=F.floor(F.col("line.cycle_no") / 512))
    return rounded(found.drop("energy_i", "energy_j"), "delta_energy", "probability", digits=7)


def log_files(spark, d):
    """The same by way of files, one log for each run, read in blocks."""
    path = shared_path(spark, "logs")
    write_files(_logged(spark, d), "run_id", path)
    found = R.read_log(spark, path).withColumn("run_id", key_of("run_id"))
    return rounded(found.drop("file", "energy_i", "energy_j"), "delta_energy", "probability", digits=7)


_REPORTED = (
    _MESSAGES
    + """, c AS (SELECT run_id, cycle_no, min(cycle_no) OVER (PARTITION BY run_id) AS first FROM (SELECT DISTINCT run_id, cycle_no FROM m)),
rp AS (SELECT run_id, cycle_no FROM c WHERE (cycle_no + 1) % 10 = 0 OR cycle_no = first)"""
)
SQL["log_parse"] = SQL["log_files"] = (
    _REPORTED
    + """SELECT m.run_id, coalesce(rp.cycle_no + 1, 0) AS attributed_cycle, pair_i, pair_j, coalesce(accepted, false) AS accepted, round(coalesce(delta_energy, 'nan'::DOUBLE), 7) + 0.0 AS delta_energy,
  round(coalesce(probability, 'nan'::DOUBLE), 7) + 0.0 AS probability FROM m ASOF LEFT JOIN rp ON m.run_id = rp.run_id AND m.cycle_no > rp.cycle_no"""
)


def effective_temperatures(spark, d):
    """Each run's ladder: the printed factor, and temperature over factor."""
    runs = table(spark, d, "hremc_run").select("run_id", "ladder_id", "temperature")
    ladder = table(spark, d, "lambda_schedule").select("ladder_id", "replica_index", "lam")
    return rounded(runs.join(ladder, "ladder_id").select("run_id", "replica_index", "lam", (F.col("temperature") / F.col("lam")).alias("effective_t")), "effective_t")


SQL["effective_temperatures"] = "SELECT run_id, replica_index, lam, round(temperature / lam, 6) + 0.0 AS effective_t FROM hremc_run JOIN lambda_schedule USING (ladder_id)"


def system_summary(spark, d):
    """Mean and spread of the plausible energies of each system, names cleaned."""
    runs = table(spark, d, "hremc_run").select("run_id", F.lower(F.trim("system_name")).alias("system_name"))
    e = trajectories(spark, d).filter("energy < 0 AND energy > -1e7").join(runs, "run_id")
    return rounded(e.groupBy("system_name").agg(F.count(F.lit(1)).alias("n"), F.avg("energy").alias("mean"), F.stddev_samp("energy").alias("sd")), "mean", "sd", digits=2)


SQL["system_summary"] = (
    STATES_SQL
    + """SELECT lower(trim(system_name)) AS system_name, count(*) AS n, round(avg(energy), 2) + 0.0 AS mean, round(stddev_samp(energy), 2) + 0.0 AS sd
FROM t JOIN hremc_run USING (run_id) WHERE energy < 0 AND energy > -1e7 GROUP BY 1"""
)

for _f in (
    acceptance_rollup, acceptance_by_run, acceptance_flags, metropolis_probability, checkpoint_pair_rates, replica_flow, replica_occupancy, checkpoint_energies, checkpoint_totals,
    round_trips, log_parse, log_files, effective_temperatures, system_summary,
):
    QUERIES[_f.__name__] = _f
