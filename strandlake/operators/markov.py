"""State models of trajectories: frames to features, reduced coordinates, states, counts, probabilities, free energies.

Counting, normalising and every sum over frames run on Spark. What comes to the driver
is a square matrix over at most ``SQUARE`` features, beyond that a narrow one of all features by the few components sought. Tasks
hold matrices over the states of one block, whose number is checked (``MOST_STATES``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandlake.operators.sequence import lagged_pairs
from strandlake.session import written

Names = Sequence[str]
SQUARE = 2_000  #: features up to which the covariance is formed; beyond, its leading part is found without
MOST_PLACES = 1_000_000  #: features that :func:`dense` numbers
MOST_STATES = 5_000
CANDIDATES = 256  #: members of a cluster whose distances to all others are added up in one pass


def transition_counts(df: DataFrame, block: Names, order: Names, state: str, lag: int) -> DataFrame:
    """i, j, c: how often state i is followed by j ``lag`` frames later, never across blocks."""
    return lagged_pairs(df, block, order, state, lag).groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))


def block_counts(df: DataFrame, block: Names, order: Names, state: str, lag: int) -> DataFrame:
    return lagged_pairs(df, block, order, state, lag).groupBy(*block, "i", "j").agg(F.count(F.lit(1)).alias("c"))


def lag_scan(df: DataFrame, block: Names, order: Names, state: str, lags: Sequence[int], by: Names = ()) -> DataFrame:
    """by, lag, i, j, c for several lags in one pass; a block counts only at lags under half its length. by: columns of the block."""
    w = Window.partitionBy(*block).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*block))
    rows = df.select(*by, F.col(state).alias("i"), n.alias("_n"), *(F.lead(state, k).over(w).alias(f"_l{k}") for k in lags))
    rows = rows.select(*by, "i", "_n", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("j")) for k in lags))).alias("p"))
    return rows.filter("p.j IS NOT NULL AND i IS NOT NULL AND p.lag * 2 < _n").groupBy(*by, "p.lag", "i", "p.j").agg(F.count(F.lit(1)).alias("c"))


def reversible(counts: DataFrame, by: Names = ()) -> DataFrame:
    """C + its transpose."""
    both = counts.select(*by, "i", "j", "c").unionByName(counts.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    return both.groupBy(*by, "i", "j").agg(F.sum("c").alias("c"))


def row_normalised(counts: DataFrame, by: Names = ()) -> DataFrame:
    """p = c / its row's sum. Rows without counts have no entries; see :func:`completed`."""
    return counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*by, "i")))


def completed(counts: DataFrame, states: DataFrame, by: Names = ()) -> DataFrame:
    """Counts in which every row has entries: one of each state (column state) that has no outgoing count gets 1 in every place.

    With :func:`row_normalised` such a row is uniform. The states are a fixed set of at most ``MOST_STATES``, checked.
    """
    names = states.select("state").filter("state IS NOT NULL").distinct()
    if names.count() > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    every = names.agg(F.collect_set("state").alias("_all"))
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    rows = groups.crossJoin(F.broadcast(every)).withColumn("i", F.explode("_all"))  # one row of states of checked number
    empty = rows.join(counts.select(*by, "i").distinct(), [*by, "i"], "left_anti")
    return counts.select(*by, "i", "j", "c").unionByName(empty.select(*by, "i", F.explode("_all").alias("j"), F.lit(1).cast("long").alias("c")))


def stationary(reversible_counts: DataFrame) -> DataFrame:
    """state, pi: share of each row in a symmetric count matrix, which is its stationary distribution."""
    rows = reversible_counts.groupBy(F.col("i").alias("state")).agg(F.sum("c").alias("_c"))
    return rows.select("state", (F.col("_c") / F.sum("_c").over(Window.partitionBy())).alias("pi"))


def populations(df: DataFrame, state: str) -> DataFrame:
    n = df.filter(F.col(state).isNotNull()).groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def matrix_statistics(counts: DataFrame, n_states: int) -> DataFrame:
    """total, nonzero, sparsity, trace, off_diagonal, visited rows of a count matrix."""
    return counts.agg(
        F.sum("c").alias("total"),
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("nonzero"),
        (1 - F.sum(F.when(F.col("c") > 0, 1).otherwise(0)) / (n_states * n_states)).alias("sparsity"),
        F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0)).alias("trace"),
        F.sum(F.when(F.col("i") != F.col("j"), F.col("c")).otherwise(0)).alias("off_diagonal"),
        F.count_distinct("i").alias("visited"),
    )


def free_energy(pi: Column, kt: Column | float, group: Names = ()) -> Column:
    """-kT ln pi, 0 at the lowest of the group; null where pi is 0."""
    f = -kt * F.log(F.when(pi > 0, pi))
    return f - F.min(f).over(Window.partitionBy(*group))


def implied_timescale(eigenvalue: Column, lag_time: float) -> Column:
    """-lag / ln(eigenvalue): infinite from 1 on, null up to 0."""
    return F.when(eigenvalue >= 1, F.lit(float("inf"))).when(eigenvalue > 0, -lag_time / F.log(eigenvalue))


def kinetic_variance(values: DataFrame, by: Names, eigenvalue: str) -> DataFrame:
    """Kinetic variance v^2 / (1 - v^2) of each eigenvalue under 1 in magnitude, and the part that it and all greater ones hold: adds kinetic, upto."""
    v = F.col(eigenvalue)
    rows = values.filter(F.abs(v) < 1).withColumn("kinetic", v * v / (1 - v * v))
    w = Window.partitionBy(*by)
    return rows.withColumn("upto", F.sum("kinetic").over(w.orderBy(F.desc(eigenvalue)).rangeBetween(Window.unboundedPreceding, 0)) / F.sum("kinetic").over(w))


def mass_cutoff(pi: DataFrame, parts: Sequence[float], by: Names = ()) -> DataFrame:
    """How many of the most populated states hold each part of the mass: by, part, n_states. Ties: smaller state first."""
    w = Window.partitionBy(*by).orderBy(F.desc("pi"), "state").rowsBetween(Window.unboundedPreceding, 0)
    rows = pi.withColumn("_upto", F.sum("pi").over(w))
    each = F.explode(F.array(*(F.lit(float(p)) for p in parts))).alias("part")
    return rows.select(*by, "_upto", each).groupBy(*by, "part").agg((F.sum(F.when(F.col("_upto") < F.col("part"), 1).otherwise(0)) + 1).alias("n_states"))


def chapman_kolmogorov(p1: DataFrame, pn: DataFrame, n: int) -> DataFrame:
    """T(lag)^n against T(n*lag), by sparse products: rms, largest difference over all pairs of visited states.

    p1, pn: i, j, p. Each product is one join on the inner state and one aggregation.
    """
    power = p1.select("i", "j", "p")
    for _ in range(n - 1):
        step = p1.select(F.col("i").alias("j"), F.col("j").alias("_k"), F.col("p").alias("_q"))
        power = power.join(step, "j").groupBy("i", F.col("_k").alias("j")).agg(F.sum(F.col("p") * F.col("_q")).alias("p"))
    both = power.join(pn.select("i", "j", F.col("p").alias("_m")), ["i", "j"], "full_outer")
    d = F.coalesce("p", F.lit(0.0)) - F.coalesce("_m", F.lit(0.0))
    size = F.count_distinct("i")
    return both.agg((F.sqrt(F.sum(d * d)) / size).alias("rms"), F.max(F.abs(d)).alias("largest"))


def _propagated(labels: DataFrame, links: DataFrame, greatest: bool, what: str) -> DataFrame:
    """state, label: each state's label spread along the links (source, target) until nothing changes, the greatest (or least) winning."""
    pick = F.max if greatest else F.min
    while True:
        new = labels.withColumnRenamed("state", "source").join(links, "source").select(F.col("target").alias("state"), "label")
        spread = labels.select("state", "label", F.col("label").alias("_own")).unionByName(new.withColumn("_own", F.lit(None).cast(labels.schema["label"].dataType)))
        both = written(spread.groupBy("state").agg(pick("label").alias("label"), pick("_own").alias("_was")), what)
        labels = both.select("state", "label")
        if both.filter("label <> _was").isEmpty():
            return labels


def weak_components(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Connected components whatever the direction of the edges (i, j): state, component (the smallest member). Edges of other states are left out."""
    states = states.select("state").filter("state IS NOT NULL").distinct()
    links = edges.select(F.col("i").alias("source"), F.col("j").alias("target")).filter("source <> target").distinct()
    links = written(links.join(states.withColumnRenamed("state", "source"), "source", "left_semi").join(states.withColumnRenamed("state", "target"), "target", "left_semi"), "links")
    both = links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return _propagated(states.select("state", F.col("state").alias("label")), both, False, "weak").withColumnRenamed("label", "component")


def components(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Strongly connected components: state, component (the smallest member). Edges (i, j) of other states are left out.

    Two states are together when each reaches the other. In each round the greatest state that reaches a state colours it; those of a
    colour that reach back to the state it comes from are one component and leave. Labels spread by joins and live in
    written tables; no edge or state comes to the driver.
    """
    left = states.select("state").filter("state IS NOT NULL").distinct()
    links = edges.select(F.col("i").alias("source"), F.col("j").alias("target")).filter("source <> target").distinct()
    done: DataFrame | None = None
    while True:
        inside = left.select(F.col("state").alias("source"))
        links = written(links.join(inside, "source", "left_semi").join(inside.withColumnRenamed("source", "target"), "target", "left_semi"), "links")
        colours = _propagated(left.select("state", F.col("state").alias("label")), links, True, "colours")
        of = lambda end: colours.select(F.col("state").alias(end), F.col("label").alias(f"_{end}"))
        back = links.join(of("source"), "source").join(of("target"), "target").filter("_source = _target").select(F.col("target").alias("source"), F.col("source").alias("target"))
        reached = F.when(F.col("state") == F.col("label"), 1).otherwise(0)
        members = _propagated(colours.select("state", reached.alias("label")), written(back, "back"), True, "members").filter("label = 1").select("state")
        found = members.join(colours, "state")
        found = written(found.join(found.groupBy("label").agg(F.min("state").alias("component")), "label").select("state", "component"), "components")
        done = found if done is None else done.unionByName(found)
        left = written(left.join(found, "state", "left_anti"), "left")
        if left.isEmpty():
            return done


def dense(df: DataFrame, by: Names, feature: Names, value: str, out: str = "v") -> DataFrame:
    """by, ``out``: one array for each value of ``by``, with a place for each combination of ``feature`` that occurs, in order; 0 where it has no row.

    df: by, feature, value, each combination once. The number of places is checked (``MOST_PLACES``).
    """
    places = df.select(*feature).distinct().limit(MOST_PLACES + 1).collect()
    if len(places) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} features")
    schema = T.StructType([*(df.schema[c] for c in feature), T.StructField("_at", T.IntegerType())])
    at = df.sparkSession.createDataFrame([(*p, k) for k, p in enumerate(sorted(map(tuple, places)))], schema)
    rows = df.join(at, list(feature)).groupBy(*by).agg(F.collect_list("_at").alias("_at"), F.collect_list(F.col(value).cast("double")).alias("_v"))

    def spread(batches):
        for batch in batches:
            where, values = batch.column("_at"), batch.column("_v")
            x = np.zeros((batch.num_rows, len(places)))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(where.value_lengths()))
            x[row, np.asarray(where.flatten())] = np.asarray(values.flatten())
            offsets = pa.array(np.arange(batch.num_rows + 1) * len(places), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [*by, out])

    return rows.mapInArrow(spread, T.StructType([*(rows.schema[c] for c in by), T.StructField(out, T.ArrayType(T.DoubleType()))]))


def gram(df: DataFrame, vector: str, pair: str | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, sum of the vectors, sum of the second vectors, sum of their outer products, over all rows.

    Each task sums its own rows, so as many matrices as tasks are added up, in a tree of
    aggregations on Spark; one reaches the driver. Rows with a null are left out.
    """
    pair = pair or vector
    rows = df.filter(F.col(vector).isNotNull() & F.col(pair).isNotNull()).select(F.col(vector).alias("a"), F.col(pair).alias("b"))
    first = rows.first()
    if first is None:
        raise ValueError("no rows")
    d = len(first["a"])

    def sums(batches):
        n, sa, sb, g = 0, np.zeros(d), np.zeros(d), np.zeros((d, d))
        for batch in batches:
            a, b = (np.asarray(batch.column(c).flatten(), dtype=np.float64).reshape(-1, d) for c in ("a", "b"))
            n, sa, sb, g = n + len(a), sa + a.sum(axis=0), sb + b.sum(axis=0), g + a.T @ b
        if n:
            # one row per matrix row, so that adding up is spread over the rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d + 1), pa.int32()), pa.array([n] * (d + 1), pa.int64()), pa.array([*g, np.concatenate([sa, sb])], pa.list_(pa.float64()))], ["row", "n", "v"]
            )

    parts = rows.mapInArrow(sums, "row int, n long, v array<double>")

    def added(t: pa.Table) -> pa.Table:
        v = np.sum([np.asarray(x.values) for x in t.column("v")], axis=0)
        return pa.table({"row": t.column("row").slice(0, 1), "n": [sum(t.column("n").to_pylist())], "v": pa.array([v], pa.list_(pa.float64()))})

    total = {r["row"]: r for r in parts.groupBy("row").applyInArrow(added, "row int, n long, v array<double>").collect()}
    ends = np.array(total[d]["v"])
    return total[d]["n"], ends[:d], ends[d:], np.array([total[k]["v"] for k in range(d)])


def fixed_sign(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the component of largest magnitude is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _summed(rows: DataFrame, step, schema: str = "row int, v array<double>") -> np.ndarray:
    """The matrix whose rows the tasks yield by number, added up on Spark; only the sum reaches the driver."""

    def added(t: pa.Table) -> pa.Table:
        v = np.sum([np.asarray(x.values) for x in t.column("v")], axis=0)
        return pa.table({"row": t.column("row").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})

    found = rows.mapInArrow(step, schema).groupBy("row").applyInArrow(added, schema).toArrow().sort_by("row")
    return np.stack([np.asarray(x.values) for x in found.column("v")])


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, d)


def leading_components(df: DataFrame, vector: str, keep: int = 0, variance: float = 0.0, settled: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, variances (descending) and components (columns): the ``keep`` leading ones, or the fewest that hold ``variance``.

    For any number of features: the covariance is never formed. A narrow orthonormal basis is multiplied by it, a pass over the
    rows each time, until the variances in it no longer change by more than the part ``settled``; it is widened until it holds
    what is asked for. A task holds a matrix of all features by the basis's width. Rows with a null are left out.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
    one = rows.first()
    if one is None:
        raise ValueError("no rows")
    d = len(one["v"])

    def moments(batches):
        n, s, q = 0, np.zeros(d), 0.0
        for batch in batches:
            x = _matrix(batch, d)
            n, s, q = n + len(x), s + x.sum(axis=0), q + float((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate([[n, q], s])], pa.list_(pa.float64()))], ["row", "v"])

    n, square, *total = _summed(rows, moments)[0]
    mean = np.array(total) / n
    whole = square / n - float(mean @ mean)

    def times(basis: np.ndarray):
        def step(batches):
            out = np.zeros(basis.shape)
            for batch in batches:
                x = _matrix(batch, d) - mean
                out += x.T @ (x @ basis)
            yield pa.RecordBatch.from_arrays([pa.array(range(basis.shape[1]), pa.int32()), pa.array([*out.T], pa.list_(pa.float64()))], ["row", "v"])

        return step

    most = int(min(n, d))
    width, random = min(most, (keep or 40) + 16), np.random.default_rng(0)
    basis, before = np.linalg.qr(random.normal(size=(d, width)))[0], None
    while True:
        image = _summed(rows, times(basis)).T / n  # covariance times the basis
        small = basis.T @ image
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        values, rotation = np.maximum(values[::-1], 0.0), rotation[:, ::-1]
        held = np.cumsum(values) / whole if whole > 0 else np.ones(width)
        wanted = min(keep, width) if keep else min(int(np.searchsorted(held, variance) + 1), width)
        short = not keep and held[-1] < variance and width < most
        if before is not None and len(before) >= wanted and not short and np.abs(values[:wanted] - before[:wanted]).max() <= settled * values[0]:
            return mean, values[:wanted], fixed_sign((basis @ rotation)[:, :wanted])
        if width == most and before is not None and most == d:
            return mean, values[:wanted], fixed_sign((basis @ rotation)[:, :wanted])
        before = values
        if short:
            width = min(most, 2 * width)
            image = np.hstack([image, random.normal(size=(d, width - image.shape[1])) * np.abs(image).max()])
            before = None
        basis = np.linalg.qr(image)[0]


def principal_components(df: DataFrame, vector: str, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, variances (descending) and components (columns) of the covariance."""
    return _components(df, vector, keep=keep)


def _components(df: DataFrame, vector: str, keep: int = 0, variance: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = df.filter(F.col(vector).isNotNull()).select(vector).first()
    if one is None:
        raise ValueError("no rows")
    if len(one[0]) > SQUARE:
        return leading_components(df, vector, keep, variance)
    n, s, _, g = gram(df, vector)
    mean = s / n
    values, vectors = np.linalg.eigh(g / n - np.outer(mean, mean))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = keep or int(np.searchsorted(np.cumsum(values) / values.sum(), variance) + 1)
    return mean, values[:k], fixed_sign(vectors[:, :k])


def time_lagged_components(df: DataFrame, block: Names, order: Names, vector: str, lag: int, keep: int, variance: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TICA: mean, eigenvalues (descending) and projection (columns) of the whitened, symmetrised lagged covariance.

    Whitening keeps the fewest principal components that hold ``variance``; only the coordinates along these are
    shuffled to meet their lagged ones, which never cross a block.
    """
    mean, values, vectors = _components(df, vector, variance=variance)
    white = vectors / np.sqrt(values)
    w = Window.partitionBy(*block).orderBy(*order)
    slim = projected(df.select(*block, *order, F.col(vector).alias("_x")), "_x", mean, white, "_z").drop("_x")
    pairs = slim.select(F.col("_z").alias("_x"), F.lead("_z", lag).over(w).alias("_y"))
    m, sa, sb, c = gram(pairs, "_x", "_y")
    small = c / m  # the mean of all rows is 0 in these coordinates
    eigen, rotation = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(eigen)[::-1][:keep]
    return mean, eigen[top], fixed_sign(white @ rotation[:, top])


def projected(df: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, out: str = "projection") -> DataFrame:
    """(vector - mean) @ components for each row, in the task that holds it."""

    def project(batches):
        for batch in batches:
            column = batch.column(vector)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            x = np.array(column.drop_null().to_pylist(), dtype=np.float64).reshape(-1, len(mean))
            y = iter((x - mean) @ components)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([next(y) if k else None for k in known], pa.list_(pa.float64()))], [*batch.schema.names, out])

    return df.mapInArrow(project, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors, nearest centre (ties: the first) and distance to it, batch by batch."""
    for batch in batches:
        x = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, centres.shape[1])
        if len(x):
            square = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
            label = square.argmin(axis=1)
            yield batch.column("id"), x, label, np.sqrt(square[np.arange(len(x)), label])


def _cluster_totals(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows, distance to the centre and vectors of each cluster, added up over a task."""
    n, loss, total = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres)), np.zeros(centres.shape)
    for _, x, label, distance in _assigned(batches, centres):
        n += np.bincount(label, minlength=len(centres))
        loss += np.bincount(label, distance, minlength=len(centres))
        np.add.at(total, label, x)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(loss[at]), pa.array([*total[at]], pa.list_(pa.float64()))], ["cluster", "n", "loss", "v"])


def _first_members(batches: Iterator[pa.RecordBatch], centres: np.ndarray, means: np.ndarray, after: list, below: np.ndarray, most: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The ``most`` members of each cluster nearest its mean, of those behind ``after`` (distance, id) and nearer than ``below``."""
    held: list[list] = [[] for _ in centres]
    for ids, x, label, _ in _assigned(batches, centres):
        r = np.sqrt(((x - means[label]) ** 2).sum(axis=1))
        for c in np.unique(label):
            limit = min(below[c], held[c][-1][0] if len(held[c]) == most else np.inf)
            at = np.flatnonzero((label == c) & (r <= limit) & (r < below[c]) & (r >= (after[c][0] if after[c] else 0.0)))
            rows = [(float(r[k]), i, x[k]) for k, i in zip(at, ids.take(pa.array(at)).to_pylist())]
            held[c] = sorted([*held[c], *(q for q in rows if after[c] is None or q[:2] > after[c])], key=lambda q: q[:2])[:most]
    flat = [(c, *q) for c, rows in enumerate(held) for q in rows]
    yield pa.RecordBatch.from_arrays(
        [pa.array([q[0] for q in flat], pa.int32()), pa.array([q[1] for q in flat], pa.float64()), pa.array([q[2] for q in flat], kind), pa.array([q[3] for q in flat], pa.list_(pa.float64()))],
        ["cluster", "r", "id", "v"],
    )


def _candidate_totals(batches: Iterator[pa.RecordBatch], centres: np.ndarray, candidates: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Distances from a task's rows to each candidate of their cluster, added up."""
    total = [np.zeros(len(c)) for c in candidates]
    for _, x, label, _ in _assigned(batches, centres):
        for c in np.unique(label):
            if len(candidates[c]):
                a, b = x[label == c] - centres[c], candidates[c] - centres[c]
                total[c] += np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)).sum(axis=0)
    flat = [(c, k, t) for c, each in enumerate(total) for k, t in enumerate(each)]
    yield pa.RecordBatch.from_arrays([pa.array([q[k] for q in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["cluster", "candidate", "total"])


def _totals_by_cluster(rows: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, float, np.ndarray]]:
    """cluster: rows, summed distance, mean vector. Tasks' sums are added up on Spark."""
    schema = "cluster int, n long, loss double, v array<double>"

    def added(t: pa.Table) -> pa.Table:
        v = np.sum([np.asarray(x.values) for x in t.column("v")], axis=0)
        return pa.table({"cluster": t.column("cluster").slice(0, 1), "n": [sum(t.column("n").to_pylist())], "loss": [sum(t.column("loss").to_pylist())], "v": pa.array([v], pa.list_(pa.float64()))})

    found = rows.mapInArrow(partial(_cluster_totals, centres=centres), schema).groupBy("cluster").applyInArrow(added, schema).collect()
    return {r["cluster"]: (r["n"], r["loss"], np.array(r["v"]) / r["n"]) for r in found}


def _members(rows: DataFrame, centres: np.ndarray, means: np.ndarray, after: list, below: np.ndarray, most: int) -> list[list]:
    """(distance to the mean, id, vector) of at most ``most`` members of each cluster, in order; see :func:`_first_members`."""
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("r", T.DoubleType()), rows.schema["id"], T.StructField("v", T.ArrayType(T.DoubleType()))])
    step = partial(_first_members, centres=centres, means=means, after=after, below=below, most=most, kind=to_arrow_type(rows.schema["id"].dataType))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("r", "id"))
    out: list[list] = [[] for _ in centres]
    for q in rows.mapInArrow(step, schema).withColumn("_rank", rank).filter(F.col("_rank") <= most).orderBy("cluster", "_rank").collect():
        out[q["cluster"]].append((q["r"], q["id"], np.array(q["v"])))
    return out


def medoid_start(df: DataFrame, id_col: str, vector: str, k: int) -> list[tuple]:
    """(id, vector) of ``k`` rows far apart, fewer if there aren't so many different vectors.

    The row nearest the mean of all, then the row farthest from those before, one pass each: the start
    for fewer medoids is the beginning of that for more.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    one = rows.first()
    if one is None or k < 1:
        return []
    mean = _totals_by_cluster(rows, np.zeros((1, len(one["v"]))))[0][2][None, :]
    chosen = [q[1:] for q in _members(rows, mean, mean, [None], np.array([np.inf]), 1)[0]]
    schema = T.StructType([T.StructField("r", T.DoubleType()), rows.schema["id"], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def farthest(batches, centres, kind):
        best = None
        for ids, x, _, distance in _assigned(batches, centres):
            top = distance.max()
            if best is None or top >= best[0]:
                same = np.flatnonzero(distance == top)
                name, at = min(zip(ids.take(pa.array(same)).to_pylist(), same))
                if best is None or (-top, name) < (-best[0], best[1]):
                    best = (top, name, x[at])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], kind), pa.array([best[2]], pa.list_(pa.float64()))], ["r", "id", "v"])

    while len(chosen) < k:
        step = partial(farthest, centres=np.array([v for _, v in chosen]), kind=to_arrow_type(rows.schema["id"].dataType))
        top = rows.mapInArrow(step, schema).orderBy(F.desc("r"), "id").first()
        if not top["r"]:
            break
        chosen.append((top["id"], np.array(top["v"])))
    return chosen


def k_medoids(df: DataFrame, id_col: str, vector: str, k: int, start: Sequence[tuple] | None = None) -> tuple[list, float]:
    """Ids of ``k`` medoids and the mean distance of all rows to their nearest one. Rows with a null are left out.

    From :func:`medoid_start` (``start``: one that is known already) each medoid moves to the member with the least
    distance to all others of its cluster, until nothing moves. Members are tried in order of their
    distance r to the cluster's mean, ``CANDIDATES`` in one pass, until n * r, which no total is below, reaches the least total found: no
    member is left out. Every pass runs over all rows where they lie and adds up in the tasks; to the driver come
    the candidates' totals. As distances within a cluster are the problem itself, the work may grow with its square.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    chosen = list((medoid_start(df, id_col, vector, k) if start is None else start)[:k])
    if not chosen:
        return [], 0.0
    while True:
        centres = np.array([v for _, v in chosen])
        totals = _totals_by_cluster(rows, centres)
        n, least = np.array([totals[c][0] for c in range(len(chosen))]), np.array([totals[c][1] for c in range(len(chosen))])
        loss, means = float(least.sum() / n.sum()), np.array([totals[c][2] for c in range(len(chosen))])
        moved, after, open_ = list(chosen), [None] * len(chosen), np.ones(len(chosen), dtype=bool)
        while open_.any():
            tried = _members(rows, centres, means, after, np.where(open_, least / n * (1 + 1e-9), -1.0), CANDIDATES)
            step = partial(_candidate_totals, centres=centres, candidates=[np.array([q[2] for q in c]).reshape(-1, centres.shape[1]) for c in tried])
            if any(tried):
                for q in rows.mapInArrow(step, "cluster int, candidate int, total double").groupBy("cluster", "candidate").agg(F.sum("total").alias("total")).orderBy("cluster", "candidate").collect():
                    c = q["cluster"]
                    if q["total"] < least[c] * (1 - 1e-9):
                        least[c], moved[c] = q["total"], tried[c][q["candidate"]][1:]
            for c, found in enumerate(tried):
                open_[c] &= len(found) == CANDIDATES
                after[c] = found[-1][:2] if found else after[c]
        if [i for i, _ in moved] == [i for i, _ in chosen]:
            return sorted(i for i, _ in chosen), loss
        chosen = moved


def strong_labels(linked: np.ndarray) -> np.ndarray:
    """The smallest member of the strongly connected component of each state of a square matrix of links."""
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        wider = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
        if (wider == reach).all():
            return (reach & reach.T).argmax(axis=1)
        reach = wider


def local_chains(counts: DataFrame, by: Names) -> DataFrame:
    """The chain of each block on its own largest strongly connected part: by, state, pi, pi_forward.

    counts: by, i, j, c, one row per pair of states. Among parts equal in size the one with the smallest member
    is taken; states outside it are left out. ``pi`` belongs to the reversible chain (counts plus their
    transpose), ``pi_forward`` to the counts as they are. A task holds one block's matrix over states, whose size is
    checked, never its frames.
    """
    rows = counts.filter(F.col("i").isNotNull() & F.col("j").isNotNull()).groupBy(*by, "i", "j").agg(F.sum("c").cast("double").alias("c"))
    schema = T.StructType([*(rows.schema[b] for b in by), T.StructField("state", rows.schema["i"].dataType), T.StructField("pi", T.DoubleType()), T.StructField("pi_forward", T.DoubleType())])

    def chain(block: pa.Table) -> pa.Table:
        i, j = block.column("i").to_pylist(), block.column("j").to_pylist()
        names = sorted({*i, *j})
        if len(names) > MOST_STATES:
            raise ValueError(f"more than {MOST_STATES} states")
        at = {s: k for k, s in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        np.add.at(m, ([at[s] for s in i], [at[s] for s in j]), block.column("c").to_numpy())
        labels = strong_labels(m > 0)
        members = np.flatnonzero(labels == np.bincount(labels).argmax())
        m = m[np.ix_(members, members)]
        if not m.sum():  # a lone state that is only passed through
            pi = forward = np.ones(len(members)) / len(members)
        else:
            pi = (m.sum(axis=0) + m.sum(axis=1)) / (2 * m.sum())
            p = m / m.sum(axis=1, keepdims=True)
            balance = np.vstack([p.T - np.eye(len(p)), np.ones(len(p))])
            forward = np.linalg.lstsq(balance, np.append(np.zeros(len(p)), 1.0), rcond=None)[0]
        kept = block.slice(0, 1).select(list(by)).take(pa.array([0] * len(members)))
        for name, values in (("state", [names[k] for k in members]), ("pi", pi), ("pi_forward", forward)):
            kept = kept.append_column(name, pa.array(values, block.schema.field("i").type if name == "state" else pa.float64()))
        return kept

    return rows.groupBy(*by).applyInArrow(chain, schema)


def local_timescales(counts: DataFrame, by: Names, lag: str = "lag") -> DataFrame:
    """Eigenvalues of the reversible chain of each block and lag: by, lag, n_states, rank, eigenvalue, timescale.

    counts: by, lag, i, j, c. T comes from the counts plus their transpose, so pi^1/2 T pi^-1/2 is symmetric and
    all its eigenvalues are real; they come out in descending order, rank from 1, every one of all visited states.
    As many as T has connected parts are 1. Timescales as in :func:`implied_timescale`, in
    frames; the first has none. A task holds one block's matrix over states, whose size is checked.
    """
    rows = counts.filter(F.col("i").isNotNull() & F.col("j").isNotNull()).groupBy(*by, lag, "i", "j").agg(F.sum("c").cast("double").alias("c"))
    types = {"n_states": pa.int32(), "rank": pa.int32(), "eigenvalue": pa.float64()}
    schema = T.StructType([*(rows.schema[b] for b in (*by, lag)), T.StructField("n_states", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("eigenvalue", T.DoubleType())])

    def decompose(block: pa.Table) -> pa.Table:
        i, j = block.column("i").to_pylist(), block.column("j").to_pylist()
        names = sorted({*i, *j})
        if len(names) > MOST_STATES:
            raise ValueError(f"more than {MOST_STATES} states")
        at = {s: k for k, s in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        np.add.at(m, ([at[s] for s in i], [at[s] for s in j]), block.column("c").to_numpy())
        m += m.T
        root = np.sqrt(m.sum(axis=1))
        values = np.linalg.eigvalsh(m / root[:, None] / root[None, :])[::-1].copy()
        values[: len(set(strong_labels(m > 0)))] = 1.0
        out = block.slice(0, 1).select([*by, lag]).take(pa.array([0] * len(names)))
        for name, v in (("n_states", [len(names)] * len(names)), ("rank", range(1, len(names) + 1)), ("eigenvalue", values)):
            out = out.append_column(name, pa.array(v, types[name]))
        return out

    found = rows.groupBy(*by, lag).applyInArrow(decompose, schema)
    value, length = F.col("eigenvalue"), F.col(lag)
    scale = F.when(value >= 1, F.lit(float("inf"))).when(value > 0, -length / F.log(value))
    return found.withColumn("timescale", F.when(F.col("rank") > 1, scale))
