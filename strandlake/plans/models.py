"""Queries of the state models: counts, probabilities, free energies, reduced coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import aggregates as A
from strandlake.operators import joins as J
from strandlake.operators import markov as K
from strandlake.plans.common import STATES_SQL, rounded, trajectories
from strandlake.session import table, written

QUERIES, SQL = {}, {}
BLOCK, FRAME = ["run_id", "replica_index"], ["cycle_no"]
LAG, LAGS, KT = 3, [1, 2, 5, 10], 2.479


def transition_counts(spark, d):
    return K.transition_counts(trajectories(spark, d), BLOCK, FRAME, "state", LAG)


_COUNTS = STATES_SQL + f""", l AS (SELECT state AS i, lead(state, {LAG}) OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no) AS j FROM t),
c AS (SELECT i, j, count(*) AS c FROM l WHERE j IS NOT NULL GROUP BY 1, 2)"""
SQL["transition_counts"] = _COUNTS + "SELECT i, j, c FROM c"


def transition_probs(spark, d):
    return rounded(K.row_normalised(transition_counts(spark, d)), "p")


SQL["transition_probs"] = _COUNTS + "SELECT i, j, c, round(c / sum(c) OVER (PARTITION BY i), 6) + 0.0 AS p FROM c"


def reversible_probs(spark, d):
    return rounded(K.row_normalised(K.reversible(transition_counts(spark, d))), "p")


_REV = _COUNTS + ", r AS (SELECT i, j, CAST(sum(c) AS BIGINT) AS c FROM (SELECT i, j, c FROM c UNION ALL SELECT j, i, c FROM c) GROUP BY 1, 2)"
SQL["reversible_probs"] = _REV + "SELECT i, j, c, round(c / sum(c) OVER (PARTITION BY i), 6) + 0.0 AS p FROM r"


def stationary_states(spark, d):
    pi = K.stationary(K.reversible(transition_counts(spark, d)))
    return rounded(pi.withColumn("dg", K.free_energy(F.col("pi"), KT)), "pi", "dg")


_PI = _REV + ", pi AS (SELECT i AS state, sum(c)::DOUBLE / (SELECT sum(c) FROM r) AS pi FROM r GROUP BY 1)"
SQL["stationary_states"] = _PI + f"SELECT state, round(pi, 6) + 0.0 AS pi, round(-{KT} * ln(pi) - min(-{KT} * ln(pi)) OVER (), 6) + 0.0 AS dg FROM pi"


def lag_scan_counts(spark, d):
    return K.lag_scan(trajectories(spark, d), BLOCK, FRAME, "state", LAGS)


SQL["lag_scan_counts"] = (
    STATES_SQL
    + f""", n AS (SELECT *, row_number() OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no) AS f, count(*) OVER (PARTITION BY run_id, replica_index) AS n FROM t),
l AS (SELECT unnest({LAGS})::INTEGER AS lag)
SELECT lag, a.state AS i, b.state AS j, count(*) AS c FROM n a JOIN l ON lag * 2 < a.n JOIN n b ON a.run_id = b.run_id AND a.replica_index = b.replica_index AND b.f = a.f + lag GROUP BY 1, 2, 3"""
)


def counts_by_run(spark, d):
    return K.block_counts(trajectories(spark, d), BLOCK, FRAME, "state", 1).groupBy("run_id", "i", "j").agg(F.sum("c").alias("c"))


SQL["counts_by_run"] = (
    STATES_SQL
    + """, l AS (SELECT run_id, state AS i, lead(state) OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no) AS j FROM t)
SELECT run_id, i, j, count(*) AS c FROM l WHERE j IS NOT NULL GROUP BY 1, 2, 3"""
)


def matrix_statistics(spark, d):
    return rounded(K.matrix_statistics(transition_counts(spark, d), 24), "sparsity")


SQL["matrix_statistics"] = (
    _COUNTS
    + """SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS nonzero, round(1 - count(*) / 576.0, 6) + 0.0 AS sparsity, CAST(sum(CASE WHEN i = j THEN c ELSE 0 END) AS BIGINT) AS trace,
  CAST(sum(CASE WHEN i <> j THEN c ELSE 0 END) AS BIGINT) AS off_diagonal, count(DISTINCT i) AS visited FROM c"""
)


def state_populations(spark, d):
    return rounded(K.populations(trajectories(spark, d), "state"), "fraction")


SQL["state_populations"] = STATES_SQL + "SELECT state, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) + 0.0 AS fraction FROM t GROUP BY 1"


def top_states(spark, d):
    return rounded(K.populations(trajectories(spark, d), "state").orderBy(F.desc("n"), "state").limit(10), "fraction")


SQL["top_states"] = STATES_SQL + "SELECT state, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) + 0.0 AS fraction FROM t GROUP BY 1 ORDER BY n DESC, state LIMIT 10"


def _run_pi(spark, d):
    df = trajectories(spark, d).groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("pi", F.col("n") / F.sum("n").over(K.Window.partitionBy("run_id")))


_RUN_PI = STATES_SQL + ", q AS (SELECT run_id, state, count(*) AS n FROM t GROUP BY 1, 2), p AS (SELECT run_id, state, n / sum(n) OVER (PARTITION BY run_id) AS pi FROM q)"


def entropy_efficiency(spark, d):
    return rounded(A.entropy(_run_pi(spark, d), ["run_id"], "pi"), "entropy", "efficiency")


SQL["entropy_efficiency"] = _RUN_PI + "SELECT run_id, round(-sum(pi * ln(pi)), 6) + 0.0 AS entropy, round(-sum(pi * ln(pi)) / ln(count(*)), 6) + 0.0 AS efficiency FROM p GROUP BY 1"


def mass_cutoff(spark, d):
    return K.mass_cutoff(_run_pi(spark, d), [0.9, 0.99], ["run_id"])


SQL["mass_cutoff"] = (
    _RUN_PI
    + """, u AS (SELECT run_id, sum(pi) OVER (PARTITION BY run_id ORDER BY pi DESC, state ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT run_id, part, CAST(count(*) FILTER (upto < part) + 1 AS BIGINT) AS n_states FROM u, (VALUES (0.9::DOUBLE), (0.99::DOUBLE)) AS v(part) GROUP BY 1, 2"""
)


def delta_g_by_run(spark, d):
    return rounded(_run_pi(spark, d).select("run_id", "state", K.free_energy(F.col("pi"), KT, ["run_id"]).alias("dg")), "dg")


SQL["delta_g_by_run"] = _RUN_PI + f"SELECT run_id, state, round(-{KT} * ln(pi) - min(-{KT} * ln(pi)) OVER (PARTITION BY run_id), 6) + 0.0 AS dg FROM p"


def weighted_fes_grid(spark, d):
    """Free-energy surface over cycle and state, frames weighted by the stationary probability of their state."""
    pi = K.stationary(K.reversible(transition_counts(spark, d)))
    frames = J.looked_up(trajectories(spark, d), pi, "state", "pi", 0.0).withColumn("c", F.col("cycle_no").cast("double")).withColumn("s", F.col("state").cast("double"))
    return rounded(A.free_energy_grid(frames, "c", "s", "pi", 30, KT), "weight", "free_energy", digits=5)


SQL["weighted_fes_grid"] = (
    _PI
    + f""", f AS (SELECT cycle_no::DOUBLE AS a, t.state::DOUBLE AS b, coalesce(pi, 0) AS w FROM t LEFT JOIN pi USING (state)),
m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM f),
g AS (SELECT a0 - 0.02 * (a1 - a0) AS alo, a1 + 0.02 * (a1 - a0) AS ahi, b0 - 0.02 * (b1 - b0) AS blo, b1 + 0.02 * (b1 - b0) AS bhi FROM m),
h AS (SELECT greatest(0, least(29, floor((a - alo) / (ahi - alo) * 30)))::INTEGER AS ix, greatest(0, least(29, floor((b - blo) / (bhi - blo) * 30)))::INTEGER AS iy, sum(w) AS w FROM f, g GROUP BY 1, 2),
z AS (SELECT ix, iy, w / sum(w) OVER () AS weight FROM h WHERE w > 0)
SELECT ix, iy, round(weight, 5) + 0.0 AS weight, round(-{KT} * ln(weight) - min(-{KT} * ln(weight)) OVER (), 5) + 0.0 AS free_energy FROM z"""
)


def implied_timescales(spark, d):
    """Two-state chains (lowest state against the others) of each run, as in the SQL: second eigenvalue and its timescale. All states and lags: timescale_scan."""
    two = trajectories(spark, d).withColumn("state", F.when(F.col("state") == 0, 0).otherwise(1))
    c = K.reversible(K.block_counts(two, BLOCK, FRAME, "state", 1).groupBy("run_id", "i", "j").agg(F.sum("c").alias("c")), ["run_id"])
    p = K.row_normalised(c, ["run_id"]).filter("i = j").groupBy("run_id").agg(F.sum("p").alias("_t"), F.count(F.lit(1)).alias("_k")).filter("_k = 2")
    p = p.select("run_id", (F.col("_t") - 1).alias("eigenvalue"))
    return rounded(p.withColumn("timescale", K.implied_timescale(F.col("eigenvalue"), 1.0)), "eigenvalue", "timescale", digits=5)


SQL["implied_timescales"] = (
    STATES_SQL
    + """, b AS (SELECT run_id, replica_index, cycle_no, CASE WHEN state = 0 THEN 0 ELSE 1 END AS s FROM t),
l AS (SELECT run_id, s AS i, lead(s) OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no) AS j FROM b),
c AS (SELECT run_id, i, j, count(*) AS c FROM (SELECT * FROM l WHERE j IS NOT NULL UNION ALL SELECT run_id, j, i FROM l WHERE j IS NOT NULL) GROUP BY 1, 2, 3),
p AS (SELECT run_id, i, j, c / sum(c) OVER (PARTITION BY run_id, i) AS p FROM c),
v AS (SELECT run_id, sum(p) - 1 AS e FROM p WHERE i = j GROUP BY 1 HAVING count(*) = 2)
SELECT run_id, round(e, 5) + 0.0 AS eigenvalue, round(CASE WHEN e >= 1 THEN 'inf'::DOUBLE WHEN e > 0 THEN -1.0 / ln(e) END, 5) + 0.0 AS timescale FROM v"""
)


def timescale_scan(spark, d):
    """All eigenvalues and timescales of the reversible chain over all states of each run, at each lag."""
    counts = K.lag_scan(trajectories(spark, d), BLOCK, FRAME, "state", LAGS, ["run_id"])
    return rounded(K.local_timescales(counts, ["run_id"]), "eigenvalue", "timescale", digits=5)


def chapman_kolmogorov(spark, d):
    df = trajectories(spark, d)
    p = lambda lag: K.row_normalised(K.reversible(K.transition_counts(df, BLOCK, FRAME, "state", lag)))
    return rounded(K.chapman_kolmogorov(p(1), p(2), 2), "rms", "largest")


SQL["chapman_kolmogorov"] = (
    STATES_SQL
    + """, o AS (SELECT state AS i, lead(state) OVER w AS j1, lead(state, 2) OVER w AS j2 FROM t WINDOW w AS (PARTITION BY run_id, replica_index ORDER BY cycle_no)),
c AS (SELECT 1 AS lag, i, j1 AS j FROM o WHERE j1 IS NOT NULL UNION ALL SELECT 2, i, j2 FROM o WHERE j2 IS NOT NULL),
r AS (SELECT lag, i, j, count(*) AS c FROM (SELECT * FROM c UNION ALL SELECT lag, j, i FROM c) GROUP BY 1, 2, 3),
p AS (SELECT lag, i, j, c / sum(c) OVER (PARTITION BY lag, i) AS p FROM r),
s AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM p a JOIN p b ON a.j = b.i WHERE a.lag = 1 AND b.lag = 1 GROUP BY 1, 2),
d AS (SELECT coalesce(s.i, m.i) AS i, coalesce(s.p, 0) - coalesce(m.p, 0) AS d FROM s FULL JOIN (SELECT * FROM p WHERE lag = 2) m ON s.i = m.i AND s.j = m.j)
SELECT round(sqrt(sum(d * d)) / count(DISTINCT i), 6) + 0.0 AS rms, round(max(abs(d)), 6) + 0.0 AS largest FROM d"""
)


def connected_states(spark, d):
    counts = transition_counts(spark, d)
    return K.components(counts, counts.select(F.col("i").alias("state")))


def weak_states(spark, d):
    """States joined by transitions of either direction."""
    counts = transition_counts(spark, d)
    return K.weak_components(counts, counts.select(F.col("i").alias("state")))


_REACH = f"""
WITH RECURSIVE {_COUNTS.strip().removeprefix("WITH")},
s AS (SELECT DISTINCT i AS state FROM c),
e AS (SELECT i, j FROM c WHERE j IN (SELECT state FROM s)),
r AS (SELECT i, j FROM %s UNION SELECT r.i, x.j FROM r JOIN %s x ON r.j = x.i)"""
SQL["connected_states"] = _REACH % ("e", "e") + "SELECT s.state, least(s.state, coalesce(min(a.j), s.state)) AS component FROM s LEFT JOIN (SELECT a.i, a.j FROM r a JOIN r b ON a.i = b.j AND a.j = b.i) a ON a.i = s.state GROUP BY 1"
_EITHER = "(SELECT i, j FROM e UNION SELECT j, i FROM e)"
SQL["weak_states"] = _REACH % (_EITHER, _EITHER) + "SELECT s.state, least(s.state, coalesce(min(r.j), s.state)) AS component FROM s LEFT JOIN r ON r.i = s.state GROUP BY 1"


def uniform_rows(spark, d):
    """Probabilities within each run over the states any run visits; a state without counts in a run goes anywhere alike."""
    counts = counts_by_run(spark, d)
    p = K.row_normalised(K.completed(counts, trajectories(spark, d).select("state"), ["run_id"]), ["run_id"])
    return rounded(p.select("run_id", "i", "j", "p"), "p")


SQL["uniform_rows"] = (
    STATES_SQL
    + """, l AS (SELECT run_id, state AS i, lead(state) OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no) AS j FROM t),
c AS (SELECT run_id, i, j, count(*) AS c FROM l WHERE j IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT state FROM t),
g AS (SELECT run_id, a.state AS i, b.state AS j FROM (SELECT DISTINCT run_id FROM c), s a, s b),
z AS (SELECT run_id, i FROM c GROUP BY 1, 2),
u AS (SELECT g.run_id, g.i, g.j, 1 AS c FROM g ANTI JOIN z ON g.run_id = z.run_id AND g.i = z.i UNION ALL SELECT * FROM c)
SELECT run_id, i, j, round(c / sum(c) OVER (PARTITION BY run_id, i), 6) + 0.0 AS p FROM u"""
)


def kinetic_shares(spark, d):
    """The factors of each ladder as eigenvalues: kinetic variance and the part held up to each."""
    return rounded(K.kinetic_variance(table(spark, d, "lambda_schedule").select("ladder_id", "replica_index", "lam"), ["ladder_id"], "lam"), "kinetic", "upto")


SQL["kinetic_shares"] = """
WITH k AS (SELECT ladder_id, replica_index, lam, lam * lam / (1 - lam * lam) AS kinetic FROM lambda_schedule WHERE abs(lam) < 1)
SELECT ladder_id, replica_index, lam, round(kinetic, 6) + 0.0 AS kinetic, round(sum(kinetic) OVER (PARTITION BY ladder_id ORDER BY lam DESC) / sum(kinetic) OVER (PARTITION BY ladder_id), 6) + 0.0 AS upto FROM k"""


def validity_checks(spark, d):
    """Largest departures from row sums of 1 and from detailed balance."""
    c = K.reversible(transition_counts(spark, d))
    p = K.row_normalised(c)
    rows = p.groupBy("i").agg(F.abs(F.sum("p") - 1).alias("e")).agg(F.max("e").alias("row_sum"))
    pi = K.stationary(c)
    flow = p.join(pi.withColumnRenamed("state", "i"), "i").select("i", "j", (F.col("pi") * F.col("p")).alias("f"))
    back = flow.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("f").alias("g"))
    balance = flow.join(back, ["i", "j"]).agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("balance"))
    return rounded(rows.select(F.lit("row_sum").alias("check"), F.col("row_sum").alias("largest")).union(balance.select(F.lit("balance"), "balance")), "largest", digits=9)


SQL["validity_checks"] = (
    _PI
    + """, p AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM r),
f AS (SELECT i, j, pi * p AS f FROM p JOIN pi ON pi.state = p.i)
SELECT 'row_sum' AS "check", (SELECT round(max(abs(e)), 9) + 0.0 FROM (SELECT sum(p) - 1 AS e FROM p GROUP BY i)) AS largest
UNION ALL SELECT 'balance', (SELECT round(max(abs(a.f - b.f)), 9) + 0.0 FROM f a JOIN f b ON a.i = b.j AND a.j = b.i)"""
)


def embedding_components(spark, d):
    """Principal components of all embeddings, and each row's first four coordinates."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    mean, _, parts = K.principal_components(df, "embedding", 4)
    return K.projected(df, "embedding", mean, parts).select("vec_id", F.transform("projection", lambda v: F.round(v, 6)).alias("projection"))


def replica_shares(frames, cycles):
    """run_id, w, v: in each window of ``cycles`` cycles the share of each replica's reports in each state.

    v has one feature for each replica and state that occur together anywhere; one without reports in a window is 0 there.
    """
    n = frames.groupBy("run_id", F.floor(F.col("cycle_no") / cycles).alias("w"), "replica_index", "state").agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(K.Window.partitionBy("run_id", "w", "replica_index")))
    return K.dense(share, ["run_id", "w"], ["replica_index", "state"], "share")


def lagged_components(spark, d):
    """Slow coordinates of each run, from the shares of states of all replicas in successive windows of five cycles."""
    shares = written(replica_shares(trajectories(spark, d), 5), "shares")
    mean, eigen, parts = K.time_lagged_components(shares, ["run_id"], ["w"], "v", 1, 2)
    return K.projected(shares, "v", mean, parts).select("run_id", "w", F.transform("projection", lambda v: F.round(v, 5)).alias("projection"))


def embedding_medoids(spark, d):
    """k-medoids of all embeddings; each assigned, clusters summed up."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    ids, _ = K.k_medoids(df, "vec_id", "embedding", 10)
    centres = df.filter(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("medoid"), "embedding")
    near = J.nearest(df, centres, "embedding")
    return near.groupBy("medoid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 5).alias("mean_distance"), F.round(F.max("distance"), 5).alias("max_distance"))


def medoid_scan(spark, d):
    """For several numbers of medoids: mean distance of all embeddings, and mean silhouette of those whose id is divisible by 100."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    out, start = None, K.medoid_start(df, "vec_id", "embedding", 20)
    for k in (5, 10, 20):
        ids, _ = K.k_medoids(df, "vec_id", "embedding", k, start)
        near = J.nearest(df, df.filter(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("medoid"), "embedding"), "embedding")
        s = J.silhouettes(near, "vec_id", "embedding", "medoid", near.filter("vec_id % 100 = 0"))
        row = near.agg(F.lit(k).alias("k"), F.avg("distance").alias("loss")).join(s.agg(F.lit(k).alias("k"), F.avg("silhouette").alias("silhouette")), "k")
        out = row if out is None else out.unionByName(row)
    return rounded(out, "loss", "silhouette", digits=5)


def local_chains(spark, d):
    """Stationary distribution of each run alone, on the largest strongly connected part of its states."""
    return rounded(K.local_chains(counts_by_run(spark, d), ["run_id"]).select("run_id", "state", "pi"), "pi")


SQL["local_chains"] = f"""
WITH RECURSIVE {STATES_SQL.strip().removeprefix("WITH")},
l AS (SELECT run_id, state AS i, lead(state) OVER (PARTITION BY run_id, replica_index ORDER BY cycle_no) AS j FROM t),
c AS (SELECT run_id, i, j, count(*) AS c FROM l WHERE j IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT run_id, i, j FROM c UNION SELECT r.run_id, r.i, c.j FROM r JOIN c ON r.run_id = c.run_id AND r.j = c.i),
s AS (SELECT run_id, i AS state FROM c UNION SELECT run_id, j FROM c),
k AS (SELECT s.run_id, s.state, least(s.state, coalesce(min(b.i), s.state)) AS part FROM s LEFT JOIN (SELECT a.* FROM r a JOIN r b ON a.run_id = b.run_id AND a.i = b.j AND a.j = b.i) b ON s.run_id = b.run_id AND s.state = b.j GROUP BY 1, 2),
g AS (SELECT run_id, arg_max(part, (n, -part)) AS part FROM (SELECT run_id, part, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT run_id, state FROM k JOIN g USING (run_id, part)),
e AS (SELECT c.* FROM c JOIN m a ON c.run_id = a.run_id AND c.i = a.state JOIN m b ON c.run_id = b.run_id AND c.j = b.state),
w AS (SELECT run_id, state, sum(c) AS c FROM (SELECT run_id, i AS state, c FROM e UNION ALL SELECT run_id, j, c FROM e) GROUP BY 1, 2)
SELECT m.run_id, m.state, round(coalesce(c / sum(c) OVER (PARTITION BY m.run_id), 1.0 / count(*) OVER (PARTITION BY m.run_id))::DOUBLE, 6) + 0.0 AS pi FROM m LEFT JOIN w USING (run_id, state)"""


def local_chains_forward(spark, d):
    return rounded(K.local_chains(counts_by_run(spark, d), ["run_id"]), "pi", "pi_forward")


for _f in (
    medoid_scan, local_chains, local_chains_forward, transition_counts, transition_probs, reversible_probs, stationary_states, lag_scan_counts, counts_by_run, matrix_statistics, state_populations, top_states, entropy_efficiency,
    mass_cutoff, delta_g_by_run, weighted_fes_grid, implied_timescales, timescale_scan, chapman_kolmogorov, connected_states, weak_states, uniform_rows, kinetic_shares, validity_checks, embedding_components, lagged_components, embedding_medoids,
):
    QUERIES[_f.__name__] = _f
