"""Joins of sequences and points: by position, by lookup, as of, between, and by distance.

Distance joins meet in cells of a grid or in a query set of checked size; none compares
all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = Sequence[str]


def zipped(a: DataFrame, b: DataFrame, keys: Names, pos: str, values: Names) -> DataFrame:
    """Join by position; sets of unequal length raise an error when run.

    Out: keys, pos, and ``values`` of both sides as a_<v>, b_<v>.
    """
    left = a.select(*keys, pos, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(True).alias("_a"))
    right = b.select(*keys, pos, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(True).alias("_b"))
    both = left.join(right, [*keys, pos], "full_outer")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checked = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("sets of unequal length")).cast("boolean"))
    return both.filter(checked).drop("_a", "_b")


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """``value`` of the matching row of ``table`` (unique ``key``), else ``default``."""
    out = df.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def on_both_axes(triples: DataFrame, states: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Entries of a sparse matrix whose row and column are both in ``states`` (column state)."""
    keep = states.select("state").distinct()
    return triples.join(keep.withColumnRenamed("state", i), i, "left_semi").join(keep.withColumnRenamed("state", j), j, "left_semi")


def shared_states(df: DataFrame, block: str, state: str, value: str) -> DataFrame:
    """States that two blocks share: block_a < block_b, state, value_a, value_b."""
    a = df.select(F.col(block).alias("block_a"), state, F.col(value).alias("value_a"))
    b = df.select(F.col(block).alias("block_b"), state, F.col(value).alias("value_b"))
    return a.join(b, state).filter("block_a < block_b")


def compared(a: DataFrame, b: DataFrame, key: Names, value: str) -> DataFrame:
    """Rows in which two tables differ, missing rows included: key, a_value, b_value, kind."""
    left = a.select(*key, F.col(value).alias("a_value"), F.lit(1).alias("_a"))
    right = b.select(*key, F.col(value).alias("b_value"), F.lit(1).alias("_b"))
    both = left.join(right, list(key), "full_outer")
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "differs")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").drop("_a", "_b")


def as_of(df: DataFrame, keys: Names, order: Names, value: str, default=None, out: str | None = None) -> DataFrame:
    """The last known ``value`` at or before each row (forward fill), else ``default``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(w)
    return df.withColumn(out or value, last if default is None else F.coalesce(last, F.lit(default)))


def as_of_join(left: DataFrame, right: DataFrame, keys: Names, on: str, values: Names) -> DataFrame:
    """Each row of ``left`` with ``values`` of the latest row of ``right`` at or before it in ``on``.

    Both sides go through one window by ``keys``; a value is null where there is no such row.
    Of right rows equal in ``on`` the one with the greatest values counts.
    """
    shape = left.columns
    row = F.struct(*shape)
    a = left.select(*keys, F.col(on).alias("_on"), F.lit(1).alias("_side"), row.alias("_left"), F.lit(None).alias("_right"))
    b = right.select(*keys, F.col(on).alias("_on"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_on", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*(F.col(f"_left.{c}").alias(c) for c in shape), *(F.col(f"_found.{v}").alias(v) for v in values))


def interpolated(mesh: DataFrame, points: DataFrame, keys: Names, x: str, y: str) -> DataFrame:
    """y of ``points`` at each x of ``mesh`` by straight lines, going on with the end lines outside: keys, x, y.

    Points and mesh are sorted together once; each mesh point looks back to the last point and forth
    to the next. The two points before and after the ends serve beyond them. Equal x give
    the mean of their y. Sets of one point give that y.
    """
    w = Window.partitionBy(*keys).orderBy("_x")
    single = points.groupBy(*keys, F.col(x).alias("_x")).agg(F.avg(y).alias("_y"))
    spans = single.select(
        *keys, "_x", F.lit(0).alias("_side"),
        F.struct("_x", "_y", F.lag("_x").over(w).alias("_xp"), F.lag("_y").over(w).alias("_yp"), F.lead("_x").over(w).alias("_xn"), F.lead("_y").over(w).alias("_yn")).alias("_p"),
    )
    wanted = mesh.select(*keys, F.col(x).alias("_x"), F.lit(1).alias("_side"), F.lit(None).cast(spans.schema["_p"].dataType).alias("_p"))
    order = Window.partitionBy(*keys).orderBy("_x", "_side")
    both = spans.unionByName(wanted)
    both = both.withColumn("_b", F.last("_p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_a", F.first("_p", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    )
    b, a = F.col("_b"), F.col("_a")
    inside, after = b.isNotNull() & b["_xn"].isNotNull(), b.isNotNull()
    x0 = F.when(inside, b["_x"]).when(after, b["_xp"]).otherwise(a["_x"])
    y0 = F.when(inside, b["_y"]).when(after, b["_yp"]).otherwise(a["_y"])
    x1 = F.when(inside, b["_xn"]).when(after, b["_x"]).otherwise(a["_xn"])
    y1 = F.when(inside, b["_yn"]).when(after, b["_y"]).otherwise(a["_yn"])
    line = y0 + (y1 - y0) * F.try_divide(F.col("_x") - x0, x1 - x0)
    return both.filter("_side = 1").select(*keys, F.col("_x").alias(x), F.coalesce(line, y0, y1).alias(y))


def ranged(df: DataFrame, value: str, ranges: Sequence[tuple[str, float, float]], out: str = "category") -> DataFrame:
    """The first named range [low, high] that holds ``value``; null where none does."""
    v = F.col(value)
    return df.withColumn(out, F.coalesce(*(F.when(v.between(low, high), F.lit(name)) for name, low, high in ranges)))


def within_distance(a: DataFrame, b: DataFrame, xyz: Names, radius: float, payload_a: Names, payload_b: Names, by: Names = ()) -> DataFrame:
    """Pairs of a and b closer than ``radius``: by, payload of both (prefixed a_, b_), distance.

    The points of ``a`` fall into cells as wide as the radius, those of ``b`` into their
    own and all neighbouring cells; pairs meet by equality of the cell. Only true neighbours come out.
    """
    cells = [F.floor(F.col(c) / radius) for c in xyz]
    left = a.select(*by, *(F.col(c).alias(f"a_{c}") for c in dict.fromkeys([*payload_a, *xyz])), *(k.alias(f"_c{n}") for n, k in enumerate(cells)))
    around = F.explode(F.array(*(F.struct(*((k + d).alias(f"_c{n}") for n, (k, d) in enumerate(zip(cells, shift)))) for shift in product((-1, 0, 1), repeat=len(xyz))))).alias("_c")
    right = b.select(*by, *(F.col(c).alias(f"b_{c}") for c in dict.fromkeys([*payload_b, *xyz])), around).select("*", *(F.col(f"_c._c{n}") for n in range(len(xyz)))).drop("_c")
    d = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in xyz), F.lit(0.0)))
    pairs = left.join(right, [*by, *(f"_c{n}" for n in range(len(xyz)))]).withColumn("distance", d).filter(F.col("distance") < radius)
    return pairs.select(*by, *(f"a_{c}" for c in payload_a), *(f"b_{c}" for c in payload_b), "distance")


DENSE = 20_000  #: points of a cell that are compared in one task


def neighbours(points: DataFrame, xyz: Names, radius: float, payload: Names, by: Names = (), dense: int = DENSE) -> DataFrame:
    """Pairs of points of one set closer than ``radius``, each once: by, payload of both (prefixed a_, b_), distance.

    The first column of ``payload`` must be unique in ``by`` and not null; a is the point with the smaller one. Every point falls into its
    own cell and meets those of its own and of half of the cells around it, so no pair is made twice. A cell of more than ``dense``
    points is parted: each part meets copies of the points around, so many tasks share it. Points with a null or NaN coordinate are left out.
    """
    first, names = payload[0], list(dict.fromkeys([*payload, *xyz]))
    cell = [f"_c{n}" for n in range(len(xyz))]
    known = points.dropna(subset=[*by, first, *xyz]).select(*by, *names, *(F.floor(F.col(c) / radius).alias(k) for k, c in zip(cell, xyz)))
    crowded = known.groupBy(*by, *cell).agg(F.ceil(F.count(F.lit(1)) / dense).alias("_parts")).filter("_parts > 1")
    crowded = F.broadcast(crowded)  # at most one row for every ``dense`` points
    left = known.select(*by, *(F.col(c).alias(f"a_{c}") for c in names), *cell).join(crowded, [*by, *cell], "left")
    left = left.withColumn("_part", F.pmod(F.xxhash64(f"a_{first}"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    ahead = [s for s in product((-1, 0, 1), repeat=len(xyz)) if s >= (0,) * len(xyz)]  # itself and the half of the neighbours that comes after it
    shifts = F.explode(F.array(*(F.struct(*((F.col(k) - d).alias(k) for k, d in zip(cell, s)), F.lit(not any(s)).alias("_own")) for s in ahead))).alias("_s")
    right = known.select(*by, *(F.col(c).alias(f"b_{c}") for c in names), shifts).select(*by, *(f"b_{c}" for c in names), "_s.*").join(crowded, [*by, *cell], "left")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    off = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in xyz]
    square = sum((d * d for d in off), F.lit(0.0))
    near = (square < radius * radius) & (~F.col("_own") | (F.col(f"a_{first}") < F.col(f"b_{first}")))
    # Spark counts the copies as no more than their points; it would send them to the driver where the table's file is small.
    pairs = left.join(right.hint("merge"), [*by, *cell, "_part"]).filter(near)
    turn = F.col(f"a_{first}") > F.col(f"b_{first}")
    either = [F.when(turn, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{y}_{c}") for y, x in (("a", "b"), ("b", "a")) for c in payload]
    return pairs.select(*by, *either, F.sqrt(square).alias("distance"))


MOST_MEDOIDS = 10_000  #: rows of a query set that may be sent to every task


def nearest(df: DataFrame, medoids: DataFrame, vector: str) -> DataFrame:
    """The nearest medoid of each row (ties: the smallest medoid id): adds medoid, distance.

    medoids: columns medoid and ``vector``, a stated query set. Each row is compared with ``MOST_MEDOIDS`` of them at a time,
    in the task that holds the row, and keeps the nearest so far from pass to pass; nothing is shuffled. Rows with a null vector get nulls.
    """
    known = medoids.filter(F.col(vector).isNotNull()).select("medoid", vector)
    passes = max(1, -(-known.count() * 5 // (4 * MOST_MEDOIDS)))  # blocks by hash, with a fifth to spare
    schema = T.StructType([*df.schema.fields, T.StructField("medoid", T.LongType()), T.StructField("distance", T.DoubleType())])
    out = df.withColumns({"medoid": F.lit(None).cast("long"), "distance": F.lit(None).cast("double")})
    for block in range(passes):
        rows = known.filter(F.pmod(F.xxhash64("medoid"), F.lit(passes)) == block).collect()
        rows.sort(key=lambda r: r["medoid"])
        ids, centres = np.array([r["medoid"] for r in rows], dtype=np.int64), np.array([r[vector] for r in rows], dtype=np.float64)
        if len(ids):
            out = out.mapInArrow(partial(_nearer, vector=vector, ids=ids, centres=centres), schema)
    return out


def _nearer(batches, vector: str, ids: np.ndarray, centres: np.ndarray):
    """Each row's nearest medoid of these, unless one known before is nearer, or as near and of a smaller id."""
    square = (centres**2).sum(axis=1)[None, :]
    for batch in batches:
        vectors = batch.column(vector)
        known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        medoid = batch.column("medoid").fill_null(-1).to_numpy().copy()
        distance = batch.column("distance").fill_null(np.inf).to_numpy().copy()
        none = ~vectors.is_valid().to_numpy(zero_copy_only=False)
        for a in range(0, len(known), 1024):
            at = known[a : a + 1024]
            x = np.array(vectors.take(pa.array(at)).to_pylist(), dtype=np.float64)
            which = (square - 2 * x @ centres.T).argmin(axis=1)
            d, i = np.sqrt(((x - centres[which]) ** 2).sum(axis=1)), ids[which]
            nearer = (d < distance[at]) | ((d == distance[at]) & (i < medoid[at]))
            medoid[at[nearer]], distance[at[nearer]] = i[nearer], d[nearer]
        own = {"medoid": pa.array(medoid, mask=none), "distance": pa.array(distance, mask=none)}
        yield pa.RecordBatch.from_arrays([own.get(n, c) for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names)


def silhouettes(df: DataFrame, id_col: str, vector: str, label: str, queries: DataFrame) -> DataFrame:
    """How well each query row lies in its own cluster, judged by all rows: id, label, own, other, silhouette.

    ``own`` is the mean distance to the other rows of its label, ``other`` the least mean distance to
    those of any other label, the silhouette their difference over the larger. queries: rows with the
    columns of ``df``, a stated set; each task compares its rows with ``MOST_MEDOIDS`` queries at a time and
    hands on one sum per query and label, so only sums are shuffled. A row alone in its label has own null and
    silhouette 0; with one label only, other and silhouette are null. Rows with a null id, vector or label are left out.
    """
    known = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.col(label).isNotNull()
    rows = df.filter(known).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"), F.col(label).alias("_l"))
    asked = queries.filter(known).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"), F.col(label).alias("_l"))
    passes = max(1, -(-asked.count() * 5 // (4 * MOST_MEDOIDS)))  # blocks by hash, with a fifth to spare
    key, kind = rows.schema["_id"].dataType.simpleString(), rows.schema["_l"].dataType.simpleString()

    def against(block: int):
        part = asked.filter(F.pmod(F.xxhash64("_id"), F.lit(passes)) == block).select("_id", "_v").dropDuplicates(["_id"]).limit(2 * MOST_MEDOIDS + 1).collect()
        if len(part) > 2 * MOST_MEDOIDS:
            raise ValueError("a block of queries is too large")
        ids = [r["_id"] for r in part]
        at = {i: k for k, i in enumerate(ids)}
        q = np.array([r["_v"] for r in part], dtype=np.float64)

        def add_up(batches):
            sums: dict = {}
            for batch in batches:
                labels, own = batch.column("_l").to_pylist(), batch.column("_id").to_pylist()
                for a in range(0, batch.num_rows if len(ids) else 0, 256):
                    x = np.array(batch.column("_v").slice(a, 256).to_pylist(), dtype=np.float64)
                    d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * x @ q.T, 0.0))
                    counted = np.ones_like(d)
                    for k, i in enumerate(own[a : a + 256]):
                        if i in at:  # a row isn't compared with itself
                            d[k, at[i]] = counted[k, at[i]] = 0.0
                    named = np.array(labels[a : a + 256], dtype=object)
                    for name in set(labels[a : a + 256]):
                        total, n = sums.setdefault(name, (np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)))
                        which = named == name
                        total += d[which].sum(axis=0)
                        n += counted[which].sum(axis=0).astype(np.int64)
            for name, (total, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("_id").type), pa.array([name] * len(ids), batch.schema.field("_l").type), pa.array(total), pa.array(n)], ["_id", "_l", "total", "n"])

        return rows.mapInArrow(add_up, f"_id {key}, _l {kind}, total double, n long")

    parts = [against(k) for k in range(passes)]
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    means = sums.groupBy("_id", "_l").agg((F.try_divide(F.sum("total"), F.sum("n"))).alias("mean"))
    mine = asked.select("_id", F.col("_l").alias("_own")).dropDuplicates(["_id"])
    both = means.join(mine, "_id").groupBy("_id", "_own")
    own, other = F.max(F.when(F.col("_l") == F.col("_own"), F.col("mean"))), F.min(F.when(F.col("_l") != F.col("_own"), F.col("mean")))
    out = both.agg(own.alias("own"), other.alias("other"))
    value = F.when(F.col("other").isNull(), F.lit(None)).when(F.col("own").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0)))
    return out.select(F.col("_id").alias(id_col), F.col("_own").alias(label), "own", "other", value.alias("silhouette"))
