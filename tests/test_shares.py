"""Shares of states keep every replica and state apart."""

from strandlake.plans.models import replica_shares


def test_every_replica_and_state_counts(spark):
    rows = [("a", 0, 0, 0), ("a", 0, 1, 4), ("a", 7, 0, 9), ("a", 7, 5, 2), ("b", 23, 3, 23), ("b", 23, 4, 23), ("b", 23, 2, 9)]
    df = spark.createDataFrame(rows, "run_id string, replica_index int, cycle_no long, state int")
    got = {(r.run_id, r.w): [round(x, 6) for x in r.v] for r in replica_shares(df, 5).collect()}
    # places: (0, 0), (0, 4), (7, 2), (7, 9), (23, 9), (23, 23)
    assert got == {("a", 0): [0.5, 0.5, 0.0, 1.0, 0.0, 0.0], ("a", 1): [0.0, 0.0, 1.0, 0.0, 0.0, 0.0], ("b", 0): [0.0, 0.0, 0.0, 0.0, 0.333333, 0.666667]}
