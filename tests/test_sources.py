"""Readers and writers on small files of their own."""

import math

import pytest
from pyspark.sql import functions as F

from strandlake.operators.exchange import round_trips
from strandlake.sources import runs, structure, text
from strandlake.streaming import live


def put(folder, name, content):
    (folder / name).write_text(content)
    return str(folder / name)


def test_sets(spark, tmp_path):
    path = put(tmp_path, "a.dat", '# comment\n1 2.5 "a \\"b\\" c"\n2 3D1\n@ world xmax 5\n\n7\n8\n&\n1 x\n')
    got = text.read_sets(spark, path).orderBy("set", "pos").collect()
    assert [(r.set, r.pos, r.x, r.y, r.s) for r in got] == [(0, 0, 1.0, 2.5, 'a "b" c'), (0, 1, 2.0, 30.0, None), (1, 0, 0.0, 7.0, None), (1, 1, 1.0, 8.0, None), (2, 0, 1.0, None, None)]
    assert [r.command for r in text.commands(spark, path).collect()] == ["world xmax 5"]
    path = put(tmp_path, "n.dat", "0 1 2 3\n1 4 5 6\n")
    assert text.read_nxy(spark, path).count() == 6 and text.read_nxy(spark, path).filter("set = 2 AND x = 1").first().y == 6.0
    assert [tuple(r)[1:] for r in text.read_block(spark, path, [0, 3]).orderBy("pos").collect()] == [(0, 0.0, 2.0), (1, 1.0, 5.0)]
    assert text.read_sets(spark, put(tmp_path, "e.dat", "")).count() == 0


def test_sets_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, k, float(k), k * 0.5) for k in range(5)] + [(1, 0, 9.0, 1.0)], "set int, pos int, x double, y double")
    text.write_sets(df, str(tmp_path / "out"), ["set"], ["pos"], ["x", "y"])
    back = text.read_sets(spark, str(tmp_path / "out") + "/*.txt")
    assert sorted((r.x, r.y) for r in back.collect()) == sorted((r.x, r.y) for r in df.collect())


def test_structures(spark, tmp_path):
    atoms = spark.createDataFrame([(0, 1, "ALA", "BB", "A", 1.234, -0.5, 10.0), (1, 100001, "GLY", "SC1", "A", 0.0, 2.0, 3.0)], "idx int, resid int, resname string, name string, chain string, x double, y double, z double")
    gro = ["title", "    2", *(r.text for r in structure.gro_lines(atoms).orderBy("idx").collect()), "  10.0 10.0 12.5"]
    path = put(tmp_path, "a.gro", "\n".join(gro) + "\n")
    got = structure.read_gro(spark, path).orderBy("idx").collect()
    assert [(r.resid, r.resname, r.name, r.x, r.y, r.z) for r in got] == [(1, "ALA", "BB", 1.234, -0.5, 10.0), (1, "GLY", "SC1", 0.0, 2.0, 3.0)]
    assert structure.read_gro_box(spark, path).first().box == [10.0, 10.0, 12.5]
    path = put(tmp_path, "a.pdb", "\n".join(["REMARK", *(r.text for r in structure.pdb_lines(atoms).orderBy("idx").collect()), "END"]))
    got = structure.read_pdb(spark, path).orderBy("serial").collect()
    assert [(r.serial, r.name, r.resid, round(r.x, 4), round(r.z, 4)) for r in got] == [(1, "BB", 1, 1.234, 10.0), (2, "SC1", 1, 0.0, 3.0)]


def test_run_files(spark, tmp_path):
    state = '{"system":"wt","cycle":%d,"n_replicas":2,"lambdas":[1.0,0.5],"permutation":[1,0],"pair_attempts":{"0-1":3},"replica_states":[{"index":0,"state_index":1,"lam":0.5,"potential_energy":-3.5}]}'
    for name, cycle in (("checkpoint_000009.json", 9), ("checkpoint_latest.json", 9)):
        put(tmp_path, name, state % cycle)
    got = runs.read_checkpoints(spark, str(tmp_path / "*.json")).collect()
    assert len(got) == 1 and got[0].cycle == 9 and got[0].pair_attempts == {"0-1": 3} and got[0].replica_states[0].potential_energy == -3.5
    assert runs.read_checkpoints(spark, str(tmp_path / "*.json"), latest=True).count() == 2
    assert [(r.replica, r.lam) for r in runs.read_ladder(spark, put(tmp_path, "l.dat", "# r lam\n0 1.0 310\n1 0.5 620\n")).collect()] == [(0, 1.0), (1, 0.5)]
    assert [(r.chain, r.position, r.mutant) for r in runs.read_mutations(spark, put(tmp_path, "m.txt", "# x\nA 12 r h\nbad line\nA z R H\n")).collect()] == [("A", 12, "H")]
    rows = text.sections(spark, put(tmp_path, "a.top", "[ atoms ]\n; c\n1 P 2 ; x\n\n[ molecules ]\nPOPC 12\n")).orderBy("line").collect()
    assert [(r.section, r.words) for r in rows] == [("atoms", ["1", "P", "2"]), ("molecules", ["POPC", "12"])]


LOG = """2025-03-01 10:00:00 | INFO | starting
2025-03-01 10:00:07 | DEBUG |   Pair (0,1): V_go_i=-812.4 V_go_j=-790.1 ΔΔU=1.53 P=0.541 keep
2025-03-01 10:00:07 | DEBUG |   Pair (2,3): V_go_i=-640.0 V_go_j=-655.9 ΔΔU=-0.80 P=1.000 SWAP
2025-03-01 10:00:07 | INFO | Cycle      1 | Time:      0.1 ns | Accept: 50.0% | Elapsed:   41.2s
2025-03-01 10:00:07 | DEBUG |   Pair rates: 0% | 100% | 0%
2025-03-01 10:00:07 | DEBUG |   Permutation: [0, 1, 3, 2]
2025-03-01 10:00:49 | DEBUG |   Pair (1,2): V_go_i=nan V_go_j=-641.2 ΔΔU=? P=1.000 keep
noise
2025-03-01 10:07:00 | INFO | Cycle     10 | Time:      1.0 ns | Accept: 33.3% | Elapsed:   40.0s
2025-03-01 10:07:42 | DEBUG |   Pair (0,1): V_go_i=-801.0 V_go_j=-799.0 ΔΔU=2e-3 P=0.999 SWAP
"""


@pytest.mark.parametrize("stretch", [3, 200_000])
def test_exchange_logs(spark, tmp_path, monkeypatch, stretch):
    """The engine's log: a pair's line carries the cycle reported before it, also across stretches; two logs don't mix."""
    monkeypatch.setattr(runs, "STRETCH", stretch)
    put(tmp_path, "a.log", LOG), put(tmp_path, "b.log", "\n".join(LOG.splitlines()[-1:]) + "\n"), put(tmp_path, "c.log", "Cycle 5 | nothing else\n")
    got = runs.read_log(spark, str(tmp_path / "*.log")).withColumn("f", F.substring_index("file", "/", -1)).collect()
    rows = sorted((r.f, r.attributed_cycle, r.pair_i, r.pair_j, r.energy_j, r.delta_energy, r.probability, r.accepted) for r in got if r.delta_energy is not None)
    assert rows == [("a.log", 0, 0, 1, -790.1, 1.53, 0.541, False), ("a.log", 0, 2, 3, -655.9, -0.8, 1.0, True), ("a.log", 10, 0, 1, -799.0, 0.002, 0.999, True), ("b.log", 0, 0, 1, -799.0, 0.002, 0.999, True)]
    assert [(r.attributed_cycle, r.pair_i, math.isnan(r.energy_i)) for r in got if r.delta_energy is None] == [(1, 1, True)]
    reports = {r.cycle_no: (r.accept, r.elapsed, r.rates, r.permutation) for r in runs.read_log_reports(spark, str(tmp_path / "a.log")).collect()}
    assert reports == {1: (50.0, 41.2, [0.0, 100.0, 0.0], [0, 1, 3, 2]), 10: (33.3, 40.0, None, None)}


def test_round_trips_need_the_top_first(spark):
    df = spark.createDataFrame([("w", k, s) for k, s in enumerate([0, 1, 2, 1, 2, 0, 0, 2, 1, 0])] + [("v", 0, 1)], "w string, c long, s int")
    assert {r.w: (r.trips, r.first_end, r.last_end) for r in round_trips(df, ["w"], "c", "s", F.lit(2)).collect()} == {"w": (2, 5, 9), "v": (0, None, None)}


def test_live_lines(spark):
    df = spark.createDataFrame([("g0.s1 point 1, 2.5",), ("  g2.s0 point -1e3,4D1 ",), ("redraw",), (None,), ("g0.s1 point x, 1",)], "value string")
    assert [(r.graph, r.set, r.x, r.y) for r in live.points(df).filter("ok").collect()] == [(0, 1, 1.0, 2.5), (2, 0, -1000.0, 40.0)]
    assert live.points(df).filter("NOT ok").count() == 3


def test_typed_topologies(spark, tmp_path):
    itp = '[ moleculetype ]\n; name nrexcl\nPROT 1\n[ atoms ]\n 1 P2 1 GLY BB 1 0.0 72 ; x\n 2 Qd 2 ARG SC1 2 1.0\n[ nonbond_params ]\nP2 Qd 1 0.47 3.5\nbad\n'
    path = put(tmp_path, "a.itp", itp)
    rows = text.read_itp_atoms(spark, path).orderBy("nr").collect()
    assert [(r.molecule, r.nr, r.kind, r.residue, r.atom, r.charge, r.mass) for r in rows] == [("PROT", 1, "P2", "GLY", "BB", 0.0, 72.0), ("PROT", 2, "Qd", "ARG", "SC1", 1.0, None)]
    assert [(r.kind_i, r.kind_j, r.form, r.sigma, r.epsilon) for r in text.read_contact_parameters(spark, path).orderBy("line").collect()] == [("P2", "Qd", 1, 0.47, 3.5), ("bad", None, None, None, None)]
    assert text.read_molecules(spark, path).count() == 0
