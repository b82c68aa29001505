"""Messages delivered more than once: a persistent index of identifiers, consulted batch by batch.

The index lies in a shared folder as immutable runs. A run is a Parquet table with
one row per hash prefix that holds the sorted 128-bit identifier hashes first seen
in one batch, with the record kept for each and its arrival. An incoming batch is
reduced to one candidate per identifier on the map side, sent to its prefix, searched
for in every run by binary search, and what is novel becomes the next run. Every
``merge_every`` runs the runs are merged into one; where prefixes have grown too large they
are split in the same pass.

Which runs are live stands in numbered manifests beside them. A manifest is made once under its
number, so of two writers one fails, and a reader takes the last whole one: an index can be
opened again by any later session.

An identifier is known by two independent 64-bit hashes; at 10**12 messages the chance
that any two share both is below 10**-14.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.dates import utc_micros
from strandlake.operators.messages import null_safe_hash, with_pair
from strandlake.session import remove_at_end, shared_path, written

RUN_SCHEMA = "prefix long, h1 array<long>, h2 array<long>, at array<long>, record array<long>"
_COLUMNS = ("h1", "h2", "at", "record")
_RUN_ARROW = pa.schema([("prefix", pa.int64()), *((c, pa.list_(pa.int64())) for c in _COLUMNS)])
_ONE_ARROW = pa.schema([("prefix", pa.int64()), *((c, pa.int64()) for c in _COLUMNS)])
UNKNOWN_ARRIVAL = 2**63 - 1  #: comes after every known one
PER_PREFIX = 60_000  #: identifiers of a prefix on average
LOCAL = 400_000  #: rows that a task reduces together before they are sent


def places(h1: np.ndarray, h2: np.ndarray, run1: np.ndarray, run2: np.ndarray) -> np.ndarray:
    """Where each of the hashes (h1, h2) stands in the run sorted by (run1, run2); -1 where it doesn't."""
    lo, hi = np.searchsorted(run1, h1, "left"), np.searchsorted(run1, h1, "right")
    found = np.full(len(h1), -1)
    one = np.flatnonzero(hi - lo == 1)
    found[one] = np.where(run2[lo[one]] == h2[one], lo[one], -1)
    for k in np.flatnonzero(hi - lo > 1):
        at = lo[k] + np.searchsorted(run2[lo[k] : hi[k]], h2[k])
        found[k] = at if at < hi[k] and run2[at] == h2[k] else -1
    return found


def _first_copies(h1: np.ndarray, h2: np.ndarray, at: np.ndarray, record: np.ndarray) -> list[np.ndarray]:
    """Sorted by hash, of each identifier the copy that arrived first, among equals that of the smallest record."""
    order = np.lexsort((record, at, h2, h1))
    h1, h2, at, record = (x[order] for x in (h1, h2, at, record))
    first = np.ones(len(h1), dtype=bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return [x[first] for x in (h1, h2, at, record)]


def _local(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The first copy of each identifier among a task's rows, ``LOCAL`` at a time, with its prefix."""
    held, n = [], 0

    def reduced() -> pa.RecordBatch:
        h1, *rest = _first_copies(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in _COLUMNS))
        prefix = (h1.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (prefix, h1, *rest)], schema=_ONE_ARROW)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOCAL:
            yield reduced()
            held, n = [], 0
    if n:
        yield reduced()


def _lists(runs: pa.Table, row: int) -> list[np.ndarray]:
    return [runs.column(c)[row].values.to_numpy(zero_copy_only=False) for c in _COLUMNS]


def _novel(batch: pa.Table, runs: pa.Table) -> pa.Table:
    """One prefix: the batch's identifiers that no run has, or has only with a later arrival, as a new run."""
    if not batch.num_rows:
        return _RUN_ARROW.empty_table()
    h1, h2, at, record = _first_copies(*(batch.column(c).to_numpy() for c in _COLUMNS))
    new = np.ones(len(h1), dtype=bool)
    for k in range(runs.num_rows):
        r1, r2, arrived, kept = _lists(runs, k)
        place = places(h1, h2, r1, r2)
        there = place >= 0
        was, own = arrived[place[there]], at[there]
        new[there] &= (own < was) | ((own == was) & (record[there] < kept[place[there]]))
    if not new.any():
        return _RUN_ARROW.empty_table()
    return pa.table([[batch.column("prefix")[0].as_py()], *([x[new]] for x in (h1, h2, at, record))], schema=_RUN_ARROW)


def _merged(runs: pa.Table, bits: int) -> pa.Table:
    """One prefix of all runs as one, with the first arrival of each identifier; split where ``bits`` asks for longer prefixes."""
    parts = [_lists(runs, k) for k in range(runs.num_rows)]
    columns = _first_copies(*(np.concatenate(x) for x in zip(*parts)))
    prefix = (columns[0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])), len(prefix))
    return pa.table([prefix[cuts[:-1]], *([x[a:b] for a, b in zip(cuts, cuts[1:])] for x in columns)], schema=_RUN_ARROW)


class DeliveryIndex:
    """Identifiers seen so far, under ``path`` in a folder that all executors share.

    Made by :meth:`create`, opened again by :meth:`open`. The identifiers are spread over
    2**prefix_bits prefixes, one of which must fit in a task; they are split as the index grows.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: int = 0, merge_every: int = 3, per_prefix: int = PER_PREFIX) -> DeliveryIndex:
        """A new, empty index. rows: identifiers to expect, which sets the first prefixes only."""
        index = cls(spark, path, {"version": 0, "prefix_bits": cls.bits_for(rows, per_prefix), "per_prefix": per_prefix, "merge_every": merge_every, "runs": [], "written": 0, "identifiers": 0})
        index._commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DeliveryIndex:
        """The index at ``path`` as its last whole manifest describes it."""
        index = cls(spark, path, {})
        folder = index._hadoop_path(f"{index.path}/manifests")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True)
        for name in names:
            text = spark.read.text(f"{index.path}/manifests/{name}", wholetext=True).first()
            try:
                index.state = json.loads(text[0]) if text else {}
            except json.JSONDecodeError:  # its writer was lost
                continue
            if index.state:
                return index
        raise FileNotFoundError(f"no delivery index at {path}")

    @staticmethod
    def bits_for(rows: int, per_prefix: int = PER_PREFIX) -> int:
        """Prefix bits for so many rows: about ``per_prefix`` identifiers in each."""
        return min(30, max(5, math.ceil(math.log2(max(1, rows) / per_prefix))) if rows else 5)

    @property
    def runs(self) -> list[str]:
        return [f"{self.path}/{r}" for r in self.state["runs"]]

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _commit(self) -> None:
        """Write the next manifest; fails if another writer has."""
        self.state["version"] += 1
        at = self._hadoop_path(f"{self.path}/manifests/{self.state['version']:09d}.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()

    def _write(self, df: DataFrame) -> tuple[str, int]:
        """Write a run under the next free name: its name, and how many identifiers it has (for sizing only)."""
        self.state["written"] += 1
        name, seen = f"run-{self.state['written']:06d}-{self.state['version']:06d}", Observation()
        df.observe(seen, F.sum(F.size("h1")).alias("n")).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return name, seen.get["n"] or 0

    def index(self) -> DataFrame:
        """All live runs."""
        return self.spark.read.schema(RUN_SCHEMA).parquet(*self.runs) if self.runs else self.spark.createDataFrame([], RUN_SCHEMA)

    def take_in(self, batch: DataFrame) -> None:
        """Add a batch with columns h1, h2, at (arrival in microseconds, see :func:`keyed`) and record.

        Of an identifier's copies the earliest counts, within the batch and against batches before.
        """
        rows = batch.select(*_COLUMNS).mapInArrow(partial(_local, bits=self.state["prefix_bits"]), "prefix long, h1 long, h2 long, at long, record long")
        novel = rows.groupBy("prefix").cogroup(self.index().groupBy("prefix")).applyInArrow(_novel, RUN_SCHEMA)
        name, n = self._write(novel)
        self.state["runs"].append(name)
        self.state["identifiers"] += n
        crowded = self.state["identifiers"] > 2 * self.state["per_prefix"] << self.state["prefix_bits"]
        if crowded or len(self.state["runs"]) >= self.state["merge_every"]:
            self._merge()
        self._commit()

    def _merge(self) -> None:
        bits = max(self.state["prefix_bits"], self.bits_for(self.state["identifiers"], self.state["per_prefix"]))
        name, n = self._write(self.index().groupBy("prefix").applyInArrow(lambda runs: _merged(runs, bits), RUN_SCHEMA))
        self.state |= {"runs": [name], "prefix_bits": bits, "identifiers": n}

    def merge(self) -> None:
        """Replace the live runs by one; the old ones stay untouched for readers until :meth:`vacuum`."""
        if len(self.state["runs"]) > 1:
            self._merge()
            self._commit()

    def vacuum(self) -> None:
        """Delete runs that the last manifest no longer names. No reader of an earlier one may be at work."""
        folder = self._hadoop_path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(folder):
            if f.getPath().getName().startswith("run-") and f.getPath().getName() not in self.state["runs"]:
                fs.delete(f.getPath(), True)

    def kept(self) -> DataFrame:
        """``kept_record``: the kept record of each identifier."""
        runs = self.index()
        if len(self.state["runs"]) > 1:
            bits = self.state["prefix_bits"]
            runs = runs.groupBy("prefix").applyInArrow(lambda parts: _merged(parts, bits), RUN_SCHEMA)
        return runs.select(F.explode("record").alias("kept_record"))


def keyed(records: DataFrame, *identity: Column) -> DataFrame:
    """h1, h2, at (arrival, unknown last), record and batch (null last; the arrival where there is no ``batch_no``) of each record."""
    at = F.coalesce(utc_micros(records, "received_at"), F.lit(UNKNOWN_ARRIVAL))
    batch = F.coalesce(F.col("batch_no").cast("long"), F.lit(UNKNOWN_ARRIVAL)) if "batch_no" in records.columns else at
    return records.select(null_safe_hash(17, *identity).alias("h1"), null_safe_hash(7919, *identity).alias("h2"), at.alias("at"), F.col("record_id").alias("record"), batch.alias("batch"))


def exchange_keys(records: DataFrame) -> DataFrame:
    """Keyed exchange records. Their identity is run, launch, cycle and the unordered pair.

    Where no pair of integers can be read the text of ``pair`` takes its place.
    """
    df = with_pair(records)
    return keyed(df, F.col("run_id"), F.col("launch_no"), F.col("cycle_no"), F.col("pair_i"), F.col("pair_j"), F.when(F.col("pair_i").isNull(), F.col("pair")))


def index_deliveries(records: DataFrame, rounds: int = 3, merge_every: int = 2, path: str | None = None) -> tuple[DeliveryIndex, DataFrame]:
    """A new index of all messages in ``records``, and their keys, written once.

    The arrival batches are taken in in order of ``batch_no``, in ``rounds`` stretches of about equal numbers of records;
    only the bounds between these reach the driver. Records of no batch come last. Later batches are added to
    the index at ``path`` by :meth:`DeliveryIndex.open` and :meth:`DeliveryIndex.take_in`.
    """
    spark = records.sparkSession
    keys = written(exchange_keys(records), "delivery-keys")
    cuts = [k / rounds for k in range(1, rounds)]
    stats = keys.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("batch", cuts or [0.5], 1000).alias("q")).first()
    index = DeliveryIndex.create(spark, path or shared_path(spark, "delivery-index"), stats["n"], merge_every)
    if path is None:  # nobody knows the name
        remove_at_end(spark, index.path)
    bounds = sorted(set(stats["q"] or [])) if cuts else []
    low = None
    for high in [*bounds, None]:
        part = keys if low is None else keys.filter(F.col("batch") > low)
        index.take_in(part if high is None else part.filter(F.col("batch") <= high))
        low = high
    return index, keys


def repeated_deliveries(records: DataFrame, rounds: int = 3, merge_every: int = 2) -> DataFrame:
    """``record_id`` of every record that isn't the kept copy of its message.

    Kept is the copy with the earliest ``received_at`` (null last), among equals the
    smallest ``record_id``, in whichever batch it came. Nulls in the identity are equal to each other. An empty
    table gives no rows; rows repeated with one ``record_id`` are one record. The table is read once.
    """
    index, keys = index_deliveries(records, rounds, merge_every)
    return keys.select(F.col("record").alias("record_id")).join(index.kept(), F.col("record_id") == F.col("kept_record"), "left_anti")


def delivered_once(records: DataFrame, rounds: int = 3, merge_every: int = 2) -> DataFrame:
    """The kept copy of each message, with all columns of ``records``."""
    index, _ = index_deliveries(records, rounds, merge_every)
    return records.join(index.kept().withColumnRenamed("kept_record", "record_id"), "record_id", "left_semi").dropDuplicates(["record_id"])
