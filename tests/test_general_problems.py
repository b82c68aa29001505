"""Spikes, repeated deliveries and trailing totals against brute force, with nulls, ties, hot groups and empty tables."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest

from strandlake.operators.delivery import DeliveryIndex, delivered_once, exchange_keys, index_deliveries, places, repeated_deliveries
from strandlake.operators.messages import one_copy, with_pair
from strandlake.operators.spikes import blocked, constant_runs, flagged_reports, local_level, sparse_part, sparse_report
from strandlake.operators.trailing import daily_attempts, trailing_attempts

STATES = "run_id string, replica_index int, cycle_no long, potential_energy double, block string, at string, body string"
RECORDS = "record_id long, run_id string, launch_no int, cycle_no long, pair string, delta_energy double, accepted boolean, attempted_at timestamp, received_at timestamp, h1 string, record string, kept_record long"
T0 = dt.datetime(2024, 5, 1)


def test_pairs_in_any_spelling(spark):
    df = spark.createDataFrame([("3-4",), (" (4, 3)",), ("4–3",), ("12,1",), ("x",), (None,), ("",), ("7",)], "pair string")
    assert [(r.pair_i, r.pair_j) for r in with_pair(df).collect()] == [(3, 4), (3, 4), (3, 4), (1, 12), (None, None), (None, None), (None, None), (None, None)]


def test_binary_search_tells_colliding_halves_apart():
    run1, run2 = np.array([1, 1, 1, 5, 9]), np.array([2, 4, 6, 0, 3])
    got = places(np.array([1, 1, 5, 9, 0, 10, 1]), np.array([4, 5, 0, 4, 0, 0, 6]), run1, run2)
    assert got.tolist() == [1, -1, 3, -1, -1, -1, 2]


def _records(n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        hot = rnd.random() < 0.35  # a third of the rows are copies of one message
        cycle = 0 if hot else rnd.randrange(80)
        pair = "1-2" if hot else rnd.choice(["1-2", "(2, 1)", "2–3", "3-2", "bad", None])
        received = None if rnd.random() < 0.05 else T0 + dt.timedelta(hours=rnd.randrange(200))
        rows.append((k, rnd.choice(["a", "b", None]) if not hot else "a", None if rnd.random() < 0.05 and not hot else 1, cycle, pair, 1.0, True, T0, received, "x", "y", k + 1))
    return rows


def _message(r):
    import re

    m = re.search(r"(\d+)\D+(\d+)", r[4] or "")
    pair = tuple(sorted(map(int, m.groups()))) if m else ("text", r[4])
    return r[1], r[2], r[3], pair


@pytest.mark.parametrize("rounds, merge_every", [(1, 2), (3, 2), (4, 9)])
def test_one_copy_of_each_message_is_kept(spark, rounds, merge_every):
    rows = _records()
    df = spark.createDataFrame(rows, RECORDS)
    best = {}
    for r in rows:
        order = (r[8] is None, r[8] or T0, r[0])
        if _message(r) not in best or order < best[_message(r)][0]:
            best[_message(r)] = (order, r[0])
    kept = {v for _, v in best.values()}
    assert {r.record_id for r in repeated_deliveries(df, rounds, merge_every).collect()} == {r[0] for r in rows} - kept
    once = delivered_once(df, rounds, merge_every)
    assert once.columns == df.columns and {r.record_id for r in once.collect()} == kept


def test_index_outlives_its_batches_and_merges(spark):
    rows = _records(200)
    df = spark.createDataFrame(rows, RECORDS)
    index, _ = index_deliveries(df, rounds=4, merge_every=2)
    assert len(index.runs) == 1 and index.state["written"] > 4
    assert index.kept().count() == index.kept().distinct().count() == len({_message(r) for r in rows})


@pytest.mark.parametrize("merge_every", [2, 9])
def test_an_index_is_opened_again_and_batches_may_come_out_of_order(spark, tmp_path, merge_every):
    """Two sessions, the later arrivals first; prefixes are split as the index grows; a broken manifest is passed over."""
    rows = _records(900)
    df = spark.createDataFrame(rows, RECORDS)
    want = {r.record_id for r in delivered_once(df).collect()}
    late, early = df.filter("received_at > timestamp'2024-05-04 00:00:00'"), df.filter("received_at IS NULL OR received_at <= timestamp'2024-05-04 00:00:00'")
    path = f"file://{tmp_path}/index"
    DeliveryIndex.create(spark, path, merge_every=merge_every, per_prefix=2).take_in(exchange_keys(late))
    (tmp_path / "index/manifests/999999999.json").write_text('{"runs": [')
    other = spark.newSession()
    index = DeliveryIndex.open(other, path)
    index.take_in(exchange_keys(early))
    assert {r.kept_record for r in DeliveryIndex.open(spark, path).kept().collect()} == want
    index.merge()
    index.vacuum()
    again = DeliveryIndex.open(spark, path)
    assert again.state["prefix_bits"] > 5 and len(again.runs) == 1 and len(list((tmp_path / "index").glob("run-*"))) == 1
    assert {r.kept_record for r in again.kept().collect()} == want
    with pytest.raises(Exception, match="exists"):  # a second writer from the same manifest
        stale = DeliveryIndex.open(spark, path)
        again.take_in(exchange_keys(early))
        stale.take_in(exchange_keys(early))


def test_arrival_does_not_hang_on_the_session_zone(spark, small):
    df = spark.read.parquet(f"{small}/exchange_record.parquet")
    want = {tuple(r) for r in exchange_keys(df).collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {tuple(r) for r in exchange_keys(spark.read.parquet(f"{small}/exchange_record.parquet")).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_tables(spark):
    records, states = spark.createDataFrame([], RECORDS), spark.createDataFrame([], STATES)
    assert repeated_deliveries(records).count() == 0 and delivered_once(records).count() == 0
    assert trailing_attempts(records).count() == 0 and flagged_reports(states).count() == 0


def test_one_copy_takes_values_of_the_kept_copy(spark):
    df = spark.createDataFrame([(2, "a", 1, 1, "1-2", 5.0, None, T0, T0, "", "", 0), (1, "a", 1, 1, "2-1", 7.0, True, T0, T0, "", "", 0), (3, "a", 1, 1, "1-2", None, True, T0, None, "", "", 0)], RECORDS)
    assert [(r.delta_energy, r.accepted) for r in one_copy(df, "delta_energy", "accepted").collect()] == [(7.0, True)]


def test_trailing_totals_against_loops(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(500):
        day = T0 + dt.timedelta(days=rnd.choice([0, 0, 1, 2, 9, 45, 46]), minutes=rnd.randrange(1440))
        rows.append((k, rnd.choice(["a", None]), 1, k // 2, rnd.choice(["1-2", "2-1", "2-3", "?"]), 0.0, rnd.choice([True, False, None]), None if k % 50 == 0 else day, T0, "", "", 0))
    df = spark.createDataFrame(rows, RECORDS)
    days = defaultdict(dict)
    for r in daily_attempts(df).collect():
        days[r.run_id, r.pair_i, r.pair_j][r.day] = (r.attempts, r.accepted)
    want = set()
    for key, own in days.items():
        day = min(own)
        while day <= max(own):
            for span in (7, 30):
                near = [own.get(day - dt.timedelta(days=k), (0, 0)) for k in range(span)]
                want.add((*key, day, span, sum(a for a, _ in near), sum(b for _, b in near)))
            day += dt.timedelta(days=1)
    got = trailing_attempts(df).collect()
    assert len(got) == len(want) and {(r.run_id, r.pair_i, r.pair_j, r.day, r.span_days, r.attempts, r.accepted) for r in got} == want
    assert all(abs(r.avg_attempts * r.span_days - r.attempts) < 1e-9 for r in got)


def test_constant_runs_need_six_within_the_width():
    e = np.array([1, 1.01, 1.02, 1.0, 1.01, 1.02, 3, 1, 1, 1, 1, 1, np.nan, 1])
    assert constant_runs(e, 6, 0.025).tolist() == [True] * 6 + [False] * 8


@pytest.mark.parametrize("seed", range(6))
def test_components_set_apart_all_that_the_last_test_finds(seed):
    """Level steps, drift, a wild stretch and short blocks: no reading beyond 9 scatters of its source is left out, and few others are set apart."""
    rng = np.random.default_rng(seed)
    for rows in (1, 2, 4, 10, 42):
        n = rows * 24
        e = -1000 + rng.normal(0, 1, n) + np.linspace(0, rng.choice([0, 60]), n)
        for at in rng.integers(0, n, 4):
            e[at:] += rng.choice([-200, 15, 40])
        spikes = rng.integers(0, n, 3)
        e[spikes] += rng.choice([-1, 1], 3) * rng.uniform(9, 40, 3)
        if seed % 2:
            e[: n // 2] += rng.normal(0, 5, n // 2)  # half the block is far wilder than its source
        off = (e - local_level(e, 12)).reshape(1, rows, 24)
        for scatter in (1.0, 0.4):
            scale, sparse = sparse_part(off, np.array([np.inf]))
            if scale[0] > 1.5 * scatter:
                _, sparse = sparse_part(off, np.array([scatter]))
            assert sparse[np.abs(off) > 9 * scatter].all()
        quiet, cells = sparse_part(off, np.array([np.inf]))
        assert seed % 2 or rows < 10 or cells.mean() < 0.15


def test_restless_blocks_are_judged_by_their_source(spark):
    """A source that is calm for long and wild in one block: readings beyond 9 of its scatters are found in the wild block too."""
    rng = np.random.default_rng(3)
    e = -500 + rng.normal(0, 1, 6000)
    e[3024:4032] += rng.normal(0, 6, 1008)  # one whole block
    rows = [("r", 0, k, float(v), "b", "a", "c") for k, v in enumerate(e)]
    off = np.abs(e - local_level(e, 12))
    scatter = 1.4826 * np.median(off)
    got = {r.cycle_no for r in flagged_reports(spark.createDataFrame(rows, STATES)).collect()}
    assert got >= set(np.flatnonzero(off > 9.2 * scatter)) and got <= set(np.flatnonzero(off > 8.8 * scatter)) and len(got) > 50
    report = sparse_report(spark.createDataFrame(rows, STATES)).first()
    assert report.reports == 6000 and report.candidates > report.spikes == len(got)


def test_spikes_of_sources_of_different_scatter(spark):
    rng = np.random.default_rng(7)
    rows, cases = [], set()
    for source, (level, scatter, n) in enumerate([(-1000.0, 1.0, 2600), (-5e5, 300.0, 700), (-20.0, 0.2, 90)]):
        e = level + scatter * rng.normal(0, 1, n).clip(-4, 4) + scatter * 0.01 * np.arange(n)
        e[n // 2 :] -= scatter * 40
        away = [k for k in range(20, n - 20) if abs(k - n // 2) > 13 and not 55 < k < 70]
        for k in rng.choice(away, 5, replace=False):
            e[k] += scatter * 30
            cases.add((source, int(k) * 2))
        e[5] = np.nan
        cases.add((source, 10))
        if n > 100:
            e[60:66] = e[60]
            cases |= {(source, 2 * k) for k in range(60, 66)}
        rows += [("r", source, int(2 * k), float(v), "b", "a", "c") for k, v in enumerate(e)]  # every second cycle is missing
    rows += rows[:50]  # copies
    rows += [("r", 0, 1, None, "", "", ""), (None, 1, 1, 5.0, "", "", ""), ("r", 9, 1, 5.0, "", "", ""), ("r", 10, 1, -5.0, "", "", "")]
    got = [(r.replica_index, r.cycle_no) for r in flagged_reports(spark.createDataFrame(rows, STATES)).collect()]
    assert len(got) == len(set(got)) and set(got) == cases | {(9, 1)}


def test_blocks_know_their_neighbours_across_gaps(spark):
    cycles = [0, 1, 5, 9, 40, 41, 42, 95, 300]
    df = spark.createDataFrame([("s", c, float(c)) for c in cycles], "k string, c long, v double")
    got = {r.block: ([x.c for x in r.before], [x.c for x in r.body], [x.c for x in r.after]) for r in blocked(df, ["k"], "c", ["v"], 10, 3).collect()}
    assert got[0] == ([], [0, 1, 5, 9], [40, 41, 42]) and got[4] == ([1, 5, 9], [40, 41, 42], [95, 300]) and got[9] == ([40, 41, 42], [95], [300]) and got[30][0] == [41, 42, 95]


def test_delivery_plan_aggregates_before_it_shuffles(spark, small):
    df = spark.read.parquet(f"{small}/exchange_record.parquet")
    plan = one_copy(df, "accepted")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") == 1 and plan.index("partial_min") > plan.index("Exchange")
