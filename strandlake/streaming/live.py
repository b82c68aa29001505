"""Lines that arrive live change sets of points; the same lines replayed in batch give the same sets.

The line protocol is ``g0.s1 point x, y``. Lines that can't be read go to the errors. State per set is
small (a count and the last point) and ends after a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_POINT = r"^\s*g(\d+)\.s(\d+)\s+point\s+([-+0-9.eEdD]+)\s*,\s*([-+0-9.eEdD]+)\s*$"


def points(lines: DataFrame, text: str = "value") -> DataFrame:
    """graph, set, x, y, ok of each line; other columns stay. Works on streams and tables."""
    part = lambda k: F.regexp_extract(text, _POINT, k)
    value = lambda k: F.regexp_replace(part(k), "[dD]", "e").try_cast("double")
    out = lines.withColumns({"graph": part(1).try_cast("int"), "set": part(2).try_cast("int"), "x": value(3), "y": value(4)})
    return out.withColumn("ok", F.col("graph").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())


def appended(stream: DataFrame, keys: list[str], x: str, y: str, ttl_minutes: int | None = None) -> DataFrame:
    """Number the points of each set as they arrive: keys, pos, x, y. Points of one micro-batch and set are ordered by x, y.

    A set idle for ``ttl_minutes`` of processing time is forgotten and starts anew; such a stream wakes up
    for the sake of time alone, so give none where it is to end when all input is drained.
    """
    rows = stream.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (n,) = state.get if state.exists else (0,)
        for frame in frames:
            frame = frame.sort_values(["x", "y"])
            frame.insert(len(keys), "pos", range(n, n + len(frame)))
            n += len(frame)
            yield frame[[*keys, "pos", "x", "y"]]
        state.update((n,))
        if ttl_minutes:
            state.setTimeoutDuration(ttl_minutes * 60_000)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_minutes else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, pos long, x double, y double", "n long", "append", timeout)


def windowed(stream: DataFrame, time: str, value: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: counts and sums in tumbling windows of event time, with a watermark."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")
    )


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived, into a table at ``path``, and return that table."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
