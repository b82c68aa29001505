"""Fill containers of fixed capacity with items of varying size.

Best fit, largest items first: open containers are kept ordered by the room left, and an
item goes to the tightest one that can take it. Containers carry bitmaps of the
sources and duplicate clusters in them; while the tightest is not compatible the search
goes on to its successor. Two items of one cluster never share a container; among equally
tight containers one without the item's source is taken.

Items are spread by hash over shards of a bounded number of items, packed side by
side. Containers that a shard leaves with much room are emptied and their items packed
again with those of the other shards, of each capacity until one shard holds them all or it is hardly left with fewer.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import written

SHARD = 20_000  #: items packed together at most, on average
ROOM = 0.01  #: containers with more than this part of room left are packed again

SHRINK = 0.7  #: a capacity is packed again while that leaves at most this part of its items over

_ITEM = "capacity long, doc_id {key}, piece long, first_token long, tokens long, source string, cluster string"
_MANY = 1 << 32


def best_fit(sizes: list[int], sources: list[str | None], clusters: list[str | None], capacity: int) -> tuple[list[int], list[int]]:
    """The container of each item, and the room left in each container."""
    source_bit = {s: 1 << k for k, s in enumerate(sorted({s for s in sources if s is not None}))}
    count: dict[str, int] = {}
    for c in clusters:
        if c is not None:
            count[c] = count.get(c, 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(sorted(c for c, n in count.items() if n > 1))}
    room: list[int] = []
    in_sources: list[int] = []
    in_clusters: list[int] = []
    by_room: list[int] = []  # room * _MANY + container, ascending
    where = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size, source, cluster = sizes[item], source_bit.get(sources[item], 0), cluster_bit.get(clusters[item], 0)
        if not size:
            if not room:
                room.append(capacity), in_sources.append(0), in_clusters.append(0)
            continue  # without text it takes no room and clashes with nothing: the first container
        chosen = -1
        for at in range(bisect_left(by_room, size * _MANY), len(by_room)):
            left, container = divmod(by_room[at], _MANY)
            if chosen >= 0 and left > by_room[chosen] // _MANY:
                break
            if in_clusters[container] & cluster:
                continue
            if not in_sources[container] & source:
                chosen = at
                break
            chosen = at if chosen < 0 else chosen
        if chosen < 0:
            container = len(room)
            room.append(capacity), in_sources.append(0), in_clusters.append(0)
        else:
            container = by_room.pop(chosen) % _MANY
        room[container] -= size
        in_sources[container] |= source
        in_clusters[container] |= cluster
        if room[container]:
            insort(by_room, room[container] * _MANY + container)
        where[item] = container
    return where, room


def _packer(ends: set[int], room: float, turn: int):
    """Packs one shard; containers with more than the part ``room`` left are marked unless their capacity ends here."""

    def pack(items: pa.Table) -> pa.Table:
        capacity, shard = items.column("capacity")[0].as_py(), items.column("shard")[0].as_py()
        items = items.sort_by([(c, "ascending") for c in ("doc_id", "piece", "tokens", "source", "cluster")])
        where, left = best_fit(*(items.column(c).to_pylist() for c in ("tokens", "source", "cluster")), capacity)
        names = pa.array([f"{turn}.{shard}.{k}" for k in where])
        rooms = pa.array([left[k] for k in where], pa.int64())
        reopen = pa.array([capacity not in ends and left[k] > room * capacity for k in where])
        return items.drop_columns(["shard"]).append_column("container", names).append_column("room", rooms).append_column("reopen", reopen)

    return pack


def fill_containers(items: DataFrame, capacities: list[int], shard: int = SHARD, room: float = ROOM) -> DataFrame:
    """Which piece of which document lies in which container, for each capacity.

    items: ``doc_id``, ``tokens`` (long), ``source`` and ``cluster`` (strings, nulls clash
    with nothing). Only a document longer than the capacity is split, into
    full containers and a rest. Out: capacity, container (a name, unique within the
    capacity), doc_id, piece, first_token, tokens, room (left in the container).
    Documents of null or no tokens lie, with 0 tokens, in some container too. Repeated rows are
    items of their own; an empty table gives no rows.
    """
    if any(c < 1 for c in capacities):
        raise ValueError("capacities must be positive")
    key = items.schema["doc_id"].dataType.simpleString()
    n = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    pieces = (
        items.select("doc_id", n.alias("n"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
        .withColumn("capacity", F.explode(F.array(*(F.lit(c).cast("long") for c in sorted(set(capacities))))))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("capacity")) - 1))))
        .withColumn("first_token", F.col("piece") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("capacity"), F.col("n") - F.col("first_token")))
        .select("capacity", "doc_id", "piece", "first_token", "tokens", "source", "cluster")
    )
    done: list[DataFrame] = []
    turn, before = 0, {}
    while True:
        # how many items each capacity has: as many numbers as capacities
        sizes = {r["capacity"]: r["count"] for r in pieces.groupBy("capacity").count().collect()}
        shards = {c: -(-k // shard) for c, k in sizes.items()}
        if not shards:
            break
        of = F.create_map(*(F.lit(x).cast("long") for pair in shards.items() for x in pair))
        spread = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), of[F.col("capacity")]))
        # Where clashes keep containers of a capacity open, packing again no longer helps and they stay as they are.
        ends = {c for c, n in sizes.items() if shards[c] == 1 or n > SHRINK * before.get(c, math.inf)}
        before = sizes
        pack = _packer(ends, room, turn)
        packed = spread.groupBy("capacity", "shard").applyInArrow(pack, _ITEM.format(key=key) + ", container string, room long, reopen boolean")
        packed = written(packed, "packed")
        done.append(packed.filter("NOT reopen").drop("reopen"))
        if ends == set(sizes):
            break
        pieces = packed.filter("reopen").drop("reopen", "container", "room")
        turn += 1
    out = done[0] if done else pieces.withColumn("container", F.lit("")).withColumn("room", F.lit(0).cast("long"))
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("capacity", "container", "doc_id", "piece", "first_token", "tokens", "room")


def fill(placed: DataFrame) -> DataFrame:
    """How well each capacity is filled: capacity, tokens, containers, least_containers, filled.

    placed: the rows of :func:`fill_containers`. ``least_containers`` is the number below which no packing can go,
    all tokens over the capacity; ``filled`` the part of all room that is taken.
    """
    held = placed.groupBy("capacity", "container").agg(F.sum("tokens").alias("tokens"))
    sums = held.groupBy("capacity").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("containers"))
    return sums.select("capacity", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))
