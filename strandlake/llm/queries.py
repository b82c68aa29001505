"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.llm import sketch
from strandlake.llm.mojibake import garbled_documents, restored_documents, unfinished_documents
from strandlake.llm.packing import fill, fill_containers
from strandlake.llm.runs import near_runs, state_runs
from strandlake.llm.tokens import encode_corpus, token_counts
from strandlake.operators.messages import one_copy
from strandlake.session import table, written

P1_TOLERANCE, P1_GAP = 0.004, 20
P5_AT = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
P5_ERROR = 0.01


def p1_found(spark, d):
    runs = state_runs(table(spark, d, "replica_state"))
    return runs.filter(F.col("n_reports") >= 2).select("run_id", "replica_index", F.col("first").alias("first_cycle"), F.col("last").alias("last_cycle"))


def p1_events(spark, d):
    """Every stretch, those of a single report too, as one event."""
    runs = state_runs(table(spark, d, "replica_state"))
    return runs.select(
        "run_id", "replica_index", F.col("state").alias("state_index"), F.col("first").alias("first_cycle"), F.col("last").alias("last_cycle"),
        "n_reports", "n_delivered", F.col("duration").alias("duration_cycles"), F.round("duration_s", 3).alias("duration_s"),
    )


def p1_near(spark, d):
    """Stretches in which a replica's printed ``lam`` stays near the first one, with few cycles missing."""
    runs = near_runs(table(spark, d, "replica_state"), P1_TOLERANCE, P1_GAP)
    return runs.select("run_id", "replica_index", F.col("state").alias("lam"), F.col("first").alias("first_cycle"), F.col("last").alias("last_cycle"), "n_reports", "n_delivered")


def p5_day_sketches(spark, d):
    """Sketch of each pair and UTC day, ready to be merged over any days."""
    messages = one_copy(table(spark, d, "exchange_record"), "delta_energy", "attempted_at").filter("pair_i IS NOT NULL")
    return sketch.sketch(messages.withColumn("day", F.to_date("attempted_at")), ["pair_i", "pair_j", "day"], "delta_energy", P5_ERROR)


def digits(name: str):
    """A number to 10 significant digits, whatever its size, so that both engines agree."""
    return F.format_string("%.9e", F.col(name)).cast("double").alias(name)


def p5_percentiles(spark, d):
    """Percentiles of each pair over all runs on each day, and (day null) over all days, put together from the days' sketches.

    ``value`` is within 1 % of the exact one, which lies from ``low`` to ``high``.
    """
    days = p5_day_sketches(spark, d)
    whole = sketch.merged(days, by=["pair_i", "pair_j"]).withColumn("day", F.lit(None).cast("date"))
    both = days.filter("day IS NOT NULL").unionByName(whole)
    out = sketch.percentiles(both, ["pair_i", "pair_j", "day"], P5_AT, P5_ERROR)
    return out.select("pair_i", "pair_j", "day", "n", "q", *(digits(c) for c in ("value", "low", "high")))


def p6_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"))


def p7_containers(spark, d):
    """Which piece of which document lies in which container of each kind.

    The tokens are counted once and written, with the little that packing needs.
    """
    docs = table(spark, d, "documents").select(F.struct("doc_id", "source", "paper_key").alias("doc"), "text")
    sizes = written(token_counts(docs, "doc"), "token-counts")
    items = sizes.select("doc.doc_id", F.col("n_tokens").alias("tokens"), "doc.source", F.col("doc.paper_key").alias("cluster"))
    kinds = table(spark, d, "token_container")
    capacities = [r["capacity_tokens"] for r in kinds.select("capacity_tokens").distinct().collect()]  # a fixed list of kinds
    placed = fill_containers(items, capacities)
    named = F.broadcast(kinds.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")))
    return placed.join(named, "capacity").select("container_kind", F.col("capacity").alias("capacity_tokens"), "container", "doc_id", "piece", "first_token", "tokens", "room")


def p7_fill(spark, d):
    """How full the containers of each kind are, beside the least number that any packing needs."""
    placed = p7_containers(spark, d).withColumnRenamed("capacity_tokens", "capacity")
    return fill(placed).withColumn("filled", F.round("filled", 6)).withColumnRenamed("capacity", "capacity_tokens")


def p8_found(spark, d):
    return garbled_documents(table(spark, d, "documents"))


def p8_restored(spark, d):
    return restored_documents(table(spark, d, "documents"))


def p8_unfinished(spark, d):
    """Documents with stretches whose search was given up; none where every search came to its end."""
    return unfinished_documents(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_events": p1_events, "p1_near": p1_near, "p5_percentiles": p5_percentiles, "p5_day_sketches": p5_day_sketches, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_restored": p8_restored, "p8_unfinished": p8_unfinished}

_RUNS = """
WITH e AS (
  SELECT run_id, replica_index, cycle_no, min(state_index) AS s, min(reported_at) AS t, count(*) AS k
  FROM replica_state WHERE state_index >= 0 GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY run_id, replica_index ORDER BY cycle_no)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no ROWS UNBOUNDED PRECEDING) AS run FROM b)
"""

_GAMMA = sketch.gamma_of(P5_ERROR)
_MESSAGES = r"""
WITH r AS (
  SELECT *, CAST(regexp_extract(pair, '(\d+)\D+(\d+)', 1) AS INTEGER) AS a, CAST(regexp_extract(pair, '(\d+)\D+(\d+)', 2) AS INTEGER) AS b
  FROM exchange_record),
k AS (
  SELECT least(a, b) AS pair_i, greatest(a, b) AS pair_j, delta_energy AS x, CAST(attempted_at AS DATE) AS day, row_number() OVER (
    PARTITION BY run_id, launch_no, cycle_no, least(a, b), greatest(a, b) ORDER BY received_at NULLS LAST, record_id) AS n
  FROM r),
x AS (SELECT pair_i, pair_j, day, x FROM k WHERE n = 1 AND isfinite(x))
"""
_BUCKET = f"CASE WHEN x = 0 THEN 0 ELSE CAST(ceil(ln(abs(x)) / ln({_GAMMA!r}::DOUBLE)) AS INTEGER) END"


def _digits_sql(expression: str, name: str) -> str:
    return f"CAST(format('{{:.9e}}', {expression}) AS DOUBLE) AS {name}"


SQL = {
    "p1_found": _RUNS
    + "SELECT run_id, replica_index, min(cycle_no) AS first_cycle, max(cycle_no) AS last_cycle FROM g GROUP BY run_id, replica_index, run HAVING count(*) >= 2",
    "p1_events": _RUNS
    + """SELECT run_id, replica_index, min(s) AS state_index, min(cycle_no) AS first_cycle, max(cycle_no) AS last_cycle,
  count(*) AS n_reports, CAST(sum(k) AS BIGINT) AS n_delivered, max(cycle_no) - min(cycle_no) AS duration_cycles,
  round(epoch_us(arg_max(t, cycle_no)) / 1e6 - epoch_us(arg_min(t, cycle_no)) / 1e6, 3) AS duration_s
FROM g GROUP BY run_id, replica_index, run""",
    "p1_near": f"""
WITH RECURSIVE e AS (
  SELECT run_id, replica_index, cycle_no, min(lam) AS x, count(*) AS k, row_number() OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no) AS n
  FROM replica_state WHERE lam IS NOT NULL AND NOT isnan(lam) GROUP BY 1, 2, 3),
m AS (
  SELECT run_id, replica_index, n, cycle_no, x AS anchor, 1 AS run FROM e WHERE n = 1
  UNION ALL
  SELECT e.run_id, e.replica_index, e.n, e.cycle_no, CASE WHEN abs(e.x - m.anchor) > {P1_TOLERANCE} OR e.cycle_no - m.cycle_no > {P1_GAP} THEN e.x ELSE m.anchor END,
    m.run + CASE WHEN abs(e.x - m.anchor) > {P1_TOLERANCE} OR e.cycle_no - m.cycle_no > {P1_GAP} THEN 1 ELSE 0 END
  FROM m JOIN e ON e.run_id = m.run_id AND e.replica_index = m.replica_index AND e.n = m.n + 1)
SELECT run_id, replica_index, min(anchor) AS lam, min(m.cycle_no) AS first_cycle, max(m.cycle_no) AS last_cycle, count(*) AS n_reports, CAST(sum(k) AS BIGINT) AS n_delivered
FROM m JOIN e USING (run_id, replica_index, n) GROUP BY run_id, replica_index, run""",
    "p5_day_sketches": _MESSAGES + f"SELECT pair_i, pair_j, day, CAST(sign(x) AS INTEGER) AS sign, {_BUCKET} AS bucket, count(*) AS n FROM x GROUP BY ALL",
    # The exact percentiles, by rank among all values; then the bucket of each, and null where its estimate missed the bound.
    "p5_percentiles": _MESSAGES
    + f""", g AS (SELECT pair_i, pair_j, day, x FROM x WHERE day IS NOT NULL UNION ALL SELECT pair_i, pair_j, NULL, x FROM x),
u AS (SELECT *, row_number() OVER (PARTITION BY pair_i, pair_j, day ORDER BY x) AS rank, count(*) OVER (PARTITION BY pair_i, pair_j, day) AS n FROM g),
q AS (SELECT unnest([{', '.join(str(q) for q in P5_AT)}])::DOUBLE AS q),
e AS (SELECT pair_i, pair_j, day, n, q, x, sign(x) AS s, {_BUCKET} AS k FROM u, q WHERE rank = greatest(1, ceil(q * n))),
f AS (SELECT *, s * pow({_GAMMA!r}::DOUBLE, k) * {2 / (_GAMMA + 1)!r}::DOUBLE AS v, s * pow({_GAMMA!r}::DOUBLE, k - 1) AS a, s * pow({_GAMMA!r}::DOUBLE, k) AS b FROM e)
SELECT pair_i, pair_j, day, n, q, {_digits_sql(f"CASE WHEN abs(v - x) <= {P5_ERROR} * abs(x) * (1 + 1e-9) THEN v END", "value")},
  {_digits_sql("CASE WHEN least(a, b) <= x + abs(x) * 1e-9 THEN least(a, b) END", "low")}, {_digits_sql("CASE WHEN greatest(a, b) >= x - abs(x) * 1e-9 THEN greatest(a, b) END", "high")} FROM f""",
}
