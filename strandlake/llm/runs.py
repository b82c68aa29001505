"""Collapse runs of identical or near-identical successive events of an entity.

A state machine walks each entity's events in order and holds the open run: its
anchor (the first state), its ends and counts. An event joins the run while its state
is within ``tolerance`` of the anchor and no more than ``max_gap`` after the last
event; else the run is emitted and the event becomes the next anchor.

Entities are cut into blocks of the order column, which spreads an entity that holds a
third of all rows over many tasks; runs that touch a block's edge are then stitched,
and only these. With exact equality the machine's result doesn't depend on where it starts. With a
tolerance a block's outcome hangs on the anchor that comes in, so each block is first run as if it began anew. A
walk over one summary for each block (a block whose whole range lies within the tolerance of the anchor passes it
on, any other is taken to leave its last anchor) tells what comes in; blocks are run again with that, and
the walk is repeated until no block leaves another anchor than was taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.functions.arrow_groups import change_flags
from strandlake.functions.dates import utc_micros
from strandlake.session import written


def anchor_breaks(state: np.ndarray, hard: np.ndarray, anchor: float | None, tolerance: float) -> tuple[np.ndarray, float | None]:
    """Rows that start a run, and the anchor of the last run.

    ``hard``: rows that start a run anyway; ``anchor``: of the run that is open before row 0.
    """
    if tolerance == 0:
        out = hard.copy()
        out[1:] |= state[1:] != state[:-1]
        out[0] |= anchor is None or state[0] != anchor
        return out, (state[-1] if len(state) else anchor)
    if anchor is not None and not hard.any() and len(state) and (np.abs(state - anchor) <= tolerance).all():
        return np.zeros(len(state), dtype=bool), anchor
    out = np.zeros(len(state), dtype=bool)
    for k, (x, cut) in enumerate(zip(state.tolist(), hard.tolist())):
        if cut or anchor is None or abs(x - anchor) > tolerance:
            out[k], anchor = True, x
    return out, anchor


def _machine(batches: Iterator[pa.RecordBatch], keys: list[str], max_gap: float | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Finished runs of equal states of the batches, which arrive sorted by ``keys`` and the order column."""
    held: pa.Table | None = None  # the open run as one row of the output
    for batch in batches:
        if not batch.num_rows:
            continue
        at, state = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_order", "_state"))
        hard = change_flags(*(batch.column(k) for k in keys))
        anchor = None
        if held is not None:
            same = all(held.column(k)[0].as_py() == batch.column(k)[0].as_py() for k in keys)
            hard[0] = not same
            anchor = held.column("state")[0].as_py() if same else None
        edge = hard.copy()
        if max_gap is not None:
            hard[1:] |= at[1:] - at[:-1] > max_gap
            if not hard[0]:
                hard[0] = at[0] - held.column("last")[0].as_py() > max_gap
        starts_run, _ = anchor_breaks(state, hard, anchor, 0.0)
        starts = np.flatnonzero(starts_run)
        if not len(starts) or starts[0] != 0:
            starts = np.insert(starts, 0, 0)
        ends = np.append(starts[1:], batch.num_rows) - 1
        n = pa.array(ends - starts + 1)
        out = [batch.column(k).take(pa.array(starts)) for k in keys]
        out += [pa.array(state[starts], schema.field("state").type), pa.array(at[starts]), pa.array(at[ends]), n]
        out += [pa.array(np.add.reduceat(batch.column("_delivered").to_numpy(), starts)), batch.column("_seen").take(pa.array(starts)), batch.column("_seen").take(pa.array(ends))]
        closes = np.append(edge[starts[1:]], False)
        out += [pa.array(edge[starts]), pa.array(closes)]
        runs = pa.Table.from_arrays(out, schema=schema)
        if held is not None:
            if starts_run[0]:
                held = held.set_column(schema.get_field_index("ends_block"), "ends_block", pa.array([bool(edge[0])]))
                runs = pa.concat_tables([held, runs])
            else:
                new = runs.slice(0, 1).to_pylist()[0]
                old = held.to_pylist()[0]
                new |= {k: old[k] for k in (*keys, "state", "first", "first_seen", "starts_block")} | {k: old[k] + new[k] for k in ("n_reports", "n_delivered")}
                runs = pa.concat_tables([pa.Table.from_pylist([new], schema=schema), runs.slice(1)])
        held = runs.slice(runs.num_rows - 1)
        yield from runs.slice(0, runs.num_rows - 1).to_batches()
    if held is not None:
        held = held.set_column(schema.get_field_index("ends_block"), "ends_block", pa.array([True]))
        yield from held.to_batches()


def _block_rows(blocks: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    rows = blocks.column("rows")
    flat = rows.flatten()
    columns = {c: flat.field(c) for c in ("_order", "_state", "_seen", "_delivered")}
    stops = np.cumsum(np.append(0, rows.value_lengths().to_numpy(zero_copy_only=False)))
    for k in range(blocks.num_rows):
        yield k, {c: v.slice(stops[k], stops[k + 1] - stops[k]) for c, v in columns.items()}


def _broken(part: dict[str, pa.Array], anchor: float | None, tolerance: float, max_gap: float | None) -> tuple[np.ndarray, float]:
    """Rows of a block that start a run, given the anchor that comes in (none: the first row starts one), and the anchor that goes out."""
    at, state = (part[c].to_numpy(zero_copy_only=False) for c in ("_order", "_state"))
    hard = np.zeros(len(at), dtype=bool)
    if max_gap is not None:
        hard[1:] = at[1:] - at[:-1] > max_gap
    hard[0] = anchor is None
    return anchor_breaks(state, hard, anchor, tolerance)


def _summaries(batches: Iterator[pa.RecordBatch], keys: list[str], tolerance: float, max_gap: float | None) -> Iterator[pa.RecordBatch]:
    """Of each block: its ends, its range, whether a gap lies in it, and the anchor that goes out if none comes in."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for _, part in _block_rows(batch):
            at, state = (part[c].to_numpy(zero_copy_only=False) for c in ("_order", "_state"))
            gap = max_gap is not None and bool((at[1:] - at[:-1] > max_gap).any())
            for column, v in zip(out, (at[0], at[-1], state.min(), state.max(), gap, _broken(part, None, tolerance, max_gap)[1])):
                column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(v, t) for v, t in zip(out, kinds))], [*keys, "first", "last", "low", "high", "gap", "out"])


def _walk(batches: Iterator[pa.RecordBatch], entity: list[str], tolerance: float, max_gap: float | None) -> Iterator[pa.RecordBatch]:
    """The anchor that comes into each block (null: none), from summaries sorted by entity and block."""
    current, anchor, last = None, None, None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in entity)))
        found = []
        for key, first, end, low, high, gap, out in zip(keys, *(batch.column(c).to_pylist() for c in ("first", "last", "low", "high", "gap", "out"))):
            if key != current or (max_gap is not None and first - last > max_gap):
                anchor = None
            found.append(anchor)
            if anchor is None or gap or max(high - anchor, anchor - low) > tolerance:
                anchor = out
            current, last = key, end
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*entity, "_block")), pa.array(found, pa.float64())], [*entity, "_block", "anchor"])


def _run_blocks(batches: Iterator[pa.RecordBatch], keys: list[str], tolerance: float, max_gap: float | None, runs: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Each block run with the anchor that comes in: the anchor that goes out, and its runs."""
    for batch in batches:
        left, made, anchors = [], [], batch.column("anchor").to_pylist()
        for k, part in _block_rows(batch):
            breaks, out = _broken(part, anchors[k], tolerance, max_gap)
            starts = np.union1d([0], np.flatnonzero(breaks))
            ends = np.append(starts[1:], len(breaks)) - 1
            at, state, delivered = (part[c].to_numpy(zero_copy_only=False) for c in ("_order", "_state", "_delivered"))
            own = state[starts].astype(float)
            own[0] = own[0] if breaks[0] else anchors[k]
            values = (
                own, at[starts], at[ends], ends - starts + 1, np.add.reduceat(delivered, starts), part["_seen"].take(pa.array(starts)).to_pylist(), part["_seen"].take(pa.array(ends)).to_pylist(),
                starts == 0, ends == len(breaks) - 1, (starts == 0) & ~breaks[0],
            )
            left.append(out)
            made.append([dict(zip((f.name for f in runs.value_type), row)) for row in zip(*(v.tolist() if isinstance(v, np.ndarray) else v for v in values))])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("anchor"), pa.array(left, pa.float64()), pa.array(made, runs)], [*keys, "anchor", "out", "runs"])


def _near_runs(once: DataFrame, entity: list[str], tolerance: float, max_gap: float | None) -> DataFrame:
    """Pieces of runs by block, with ``joins`` where a block's first piece goes on with the run before it."""
    keys = [*entity, "_block"]
    rows = F.sort_array(F.collect_list(F.struct("_order", F.col("_state").cast("double").alias("_state"), "_seen", "_delivered"))).alias("rows")
    blocks = written(once.groupBy(*keys).agg(rows), "run-blocks")
    keyed = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    summary = written(
        blocks.mapInArrow(partial(_summaries, keys=keys, tolerance=tolerance, max_gap=max_gap), keyed + ", first long, last long, low double, high double, gap boolean, out double"), "run-summaries"
    )
    piece = "array<struct<state: double, first: long, last: long, n_reports: long, n_delivered: long, first_seen: long, last_seen: long, starts_block: boolean, ends_block: boolean, joins: boolean>>"
    run_schema = f"{keyed}, anchor double, out double, runs {piece}"
    kind = to_arrow_schema(T._parse_datatype_string(f"runs {piece}")).field("runs").type
    run = partial(_run_blocks, keys=keys, tolerance=tolerance, max_gap=max_gap, runs=kind)
    done: DataFrame | None = None
    while True:
        taken = summary if done is None else summary.drop("out").join(done.select(*keys, "out"), keys)
        coming = taken.repartition(*entity).sortWithinPartitions(*keys).mapInArrow(partial(_walk, entity=entity, tolerance=tolerance, max_gap=max_gap), keyed + ", anchor double")
        if done is None:
            again, kept = coming, None
        else:
            both = written(coming.join(done.withColumnRenamed("anchor", "_was"), keys), "run-anchors")
            again, kept = both.filter(~F.col("anchor").eqNullSafe(F.col("_was"))).select(*keys, "anchor"), both.filter(F.col("anchor").eqNullSafe(F.col("_was"))).select(*done.columns)
            if again.isEmpty():
                return done.select(*keys, F.explode("runs").alias("r")).select(*keys, "r.*")
        new = blocks.join(again, keys).mapInArrow(run, run_schema)
        done = written(new if kept is None else kept.unionByName(new), "run-pieces")


def collapse_runs(
    events: DataFrame,
    entity: list[str],
    order: str,
    state: str,
    seen_at: str,
    tolerance: float = 0.0,
    max_gap: int | None = None,
    block: int = 4096,
) -> DataFrame:
    """One row per run: entity, state, first, last, n_reports, n_delivered, duration, duration_s.

    events: one row per delivered report. ``order`` is an integer column; ``state`` a
    numeric one. Reports with a null or NaN state, a null order or entity are passed over: they
    neither break nor lengthen a run. Several reports of one entity and order are one
    event (``n_delivered`` counts all); should their states differ, the smallest
    counts. ``state`` is that of the first event, from which no event of the run differs by more than ``tolerance``; successive
    events are no more than ``max_gap`` apart in units of ``order``. ``duration`` is last - first in these units; ``duration_s`` the
    seconds between the earliest arrivals of the first and last event (null where
    unknown). An empty table gives no rows; other columns of ``events`` are ignored.
    With a tolerance, states are doubles and blocks are written to the shared folder.
    """
    known = events.select(*entity, F.col(order).cast("long").alias("_order"), F.col(state).alias("_state"), utc_micros(events, seen_at).alias("_seen"))
    known = known.dropna(subset=[*entity, "_order", "_state"])  # which takes NaN for null
    once = known.groupBy(*entity, "_order").agg(F.min("_state").alias("_state"), F.min("_seen").alias("_seen"), F.count(F.lit(1)).alias("_delivered"))
    keys = [*entity, "_block"]
    once = once.withColumn("_block", F.floor(F.col("_order") / block).cast("long"))
    if tolerance:
        runs = _near_runs(once, entity, tolerance, max_gap)
    else:
        sorted_events = once.repartition(*keys).sortWithinPartitions(*keys, "_order")
        fields = {f.name: f.dataType for f in once.schema.fields}
        schema = T.StructType(
            [T.StructField(k, fields[k]) for k in keys]
            + [T.StructField("state", fields["_state"]), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]
            + [T.StructField(k, T.LongType()) for k in ("n_reports", "n_delivered", "first_seen", "last_seen")]
            + [T.StructField(k, T.BooleanType()) for k in ("starts_block", "ends_block")]
        )
        machine = partial(_machine, keys=keys, max_gap=max_gap, schema=to_arrow_schema(schema))
        runs = sorted_events.mapInArrow(machine, schema)

    # Runs inside a block are final; those at the edges of blocks meet in one window per entity.
    at_edge = F.col("starts_block") | F.col("ends_block")
    runs = runs.withColumn("_part", F.when(at_edge, F.lit(-1)).otherwise(F.col("_block")))
    w = Window.partitionBy(*entity, "_part").orderBy("first")
    if tolerance:
        joins = F.col("joins")
    else:
        joins = (
            (F.lag("_block").over(w) != F.col("_block"))
            & F.lag("ends_block").over(w)
            & F.col("starts_block")
            & (F.lag("state").over(w) == F.col("state"))
        )
        if max_gap is not None:
            joins = joins & (F.col("first") - F.lag("last").over(w) <= max_gap)
    runs = runs.withColumn("_new", F.when(joins, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*entity, "_part", "_run").agg(
        F.min("state").alias("state"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_reports").alias("n_reports"),
        F.sum("n_delivered").alias("n_delivered"), F.min_by("first_seen", "first").alias("_from"), F.max_by("last_seen", "first").alias("_to"),
    )
    return whole.select(
        *entity, "state", "first", "last", "n_reports", "n_delivered", (F.col("last") - F.col("first")).alias("duration"),
        (F.col("_to") / 1e6 - F.col("_from") / 1e6).alias("duration_s"),
    )


def state_runs(states: DataFrame) -> DataFrame:
    """Stretches of equal known ``state_index`` of each replica (null and negative: unknown)."""
    known = states.filter(F.col("state_index") >= 0)
    return collapse_runs(known, ["run_id", "replica_index"], "cycle_no", "state_index", "reported_at")


def near_runs(states: DataFrame, tolerance: float, max_gap: int) -> DataFrame:
    """Stretches of each replica in which the printed ``lam`` stays within ``tolerance`` of the first and no more than ``max_gap`` cycles are missing."""
    known = states.filter(F.col("lam").isNotNull() & ~F.isnan("lam"))
    return collapse_runs(known, ["run_id", "replica_index"], "cycle_no", "lam", "reported_at", tolerance, max_gap)
