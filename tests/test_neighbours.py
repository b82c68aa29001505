"""Close pairs of one set: each once, also in crowded cells, against all pairs of a small set; within two sets too."""

import random

import pytest

from strandlake.operators.joins import neighbours, within_distance


@pytest.mark.parametrize("dense", [3, 20_000])
def test_pairs_like_all_pairs(spark, dense):
    rnd = random.Random(2)
    rows = [(k, rnd.choice("uv"), rnd.gauss(0, 1.5), rnd.gauss(0, 1.5), rnd.gauss(0, 1), k % 5) for k in range(160)]
    rows += [(200 + k, "u", 0.1, 0.1, 0.1, k) for k in range(12)]  # a third of a cell in one place
    rows += [(300, "u", None, 0.0, 0.0, 0), (301, None, 0.0, 0.0, 0.0, 0), (302, "v", float("nan"), 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, z double, tag int")
    near = lambda p, q: p[1] == q[1] and p[1] is not None and None not in (p[2], q[2]) and sum((a - b) ** 2 for a, b in zip(p[2:5], q[2:5])) < 1
    want = {(p[1], p[0], q[0], p[5], q[5]) for p in rows for q in rows if p[0] < q[0] and near(p, q)}
    got = [(r.g, r.a_id, r.b_id, r.a_tag, r.b_tag) for r in neighbours(df, ["x", "y", "z"], 1.0, ["id", "tag"], ["g"], dense=dense).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = df.filter("id % 3 = 0")
    pairs = {(r.g, r.a_id, r.b_id) for r in within_distance(some, df, ["x", "y", "z"], 1.0, ["id"], ["id"], ["g"]).collect()}
    assert pairs == {(p[1], p[0], q[0]) for p in rows for q in rows if p[0] % 3 == 0 and near(p, q)}
    assert neighbours(df.filter("false"), ["x", "y", "z"], 1.0, ["id"], ["g"]).count() == 0
