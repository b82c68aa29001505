"""Rolling totals over trailing calendar periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.messages import MESSAGE_KEY, with_pair


def daily_attempts(records: DataFrame) -> DataFrame:
    """Attempts and accepted ones per run, pair and UTC day, each message once.

    Columns: run_id, pair_i, pair_j, day (date), attempts, accepted. Copies of a
    message agree in day and outcome; should they not, the earliest day and a known
    outcome count. Messages without a readable pair or without a time are left out,
    for they belong to no pair or day. A null outcome isn't an accepted attempt.
    """
    messages = (
        with_pair(records)
        .filter(F.col("pair_i").isNotNull() & F.col("attempted_at").isNotNull())
        .groupBy(*MESSAGE_KEY)
        .agg(F.min(F.to_date("attempted_at")).alias("day"), F.max("accepted").alias("accepted"))
    )
    return messages.groupBy("run_id", "pair_i", "pair_j", "day").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(F.when(F.col("accepted"), 1).otherwise(0)).cast("long").alias("accepted")
    )


def trailing_totals(daily: DataFrame, keys: list[str], day: str, values: list[str], spans: list[int]) -> DataFrame:
    """Totals and daily averages of ``values`` over the last ``span`` days, for each span.

    daily: one row per entity (``keys``) and ``day`` with activity. Each daily total is
    put on every date it influences, entity and date are grouped, and a calendar
    from the entity's first to its last day supplies the days without activity.
    Out: keys, ``day``, span_days and for each value its total and ``avg_<value>``
    (total / span). Null totals count as 0; rows with a null ``day`` are left out;
    null keys form an entity of their own; an empty table gives no rows.

    After the daily grouping an entity has at most one row per calendar day, so no
    entity is hot here and all steps share the partitioning by ``keys``.
    """
    widest = max(spans)
    clean = daily.filter(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_day"), *values).repartition(*keys)
    offset = F.explode(F.sequence(F.lit(0), F.lit(widest - 1))).alias("_offset")
    reach = clean.select(*keys, "_day", *values, offset).withColumn("_date", F.date_add("_day", F.col("_offset")))
    sums = [F.sum(F.when(F.col("_offset") < s, F.col(v))).alias(f"_{v}_{s}") for s in spans for v in values]
    influenced = reach.groupBy(*keys, "_date").agg(*sums)
    calendar = (
        clean.groupBy(*keys)
        .agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
        .select(*keys, F.explode(F.sequence("_first", "_last")).alias("_date"))
    )
    right = influenced.select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.col("_date").alias("_r_date"), *(f"_{v}_{s}" for s in spans for v in values))
    same = F.col("_date") == F.col("_r_date")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    per_span = F.explode(
        F.array(*(F.struct(F.lit(s).alias("span_days"), *(F.coalesce(F.col(f"_{v}_{s}"), F.lit(0)).alias(v) for v in values)) for s in spans))
    ).alias("_span")
    return calendar.join(right, same, "left").select(*keys, F.col("_date").alias(day), per_span).select(
        *keys, day, "_span.span_days", *(F.col(f"_span.{v}").alias(v) for v in values), *((F.col(f"_span.{v}") / F.col("_span.span_days")).alias(f"avg_{v}") for v in values)
    )


def trailing_attempts(records: DataFrame, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing totals of exchange attempts and accepted ones, per run and pair."""
    return trailing_totals(daily_attempts(records), ["run_id", "pair_i", "pair_j"], "day", ["attempts", "accepted"], list(spans))
