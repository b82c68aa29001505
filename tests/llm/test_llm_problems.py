"""Operators tagged llm against brute force, round trips and held-out error bounds, with awkward rows."""

import datetime as dt
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.llm import mojibake, packing, runs, sketch, tokens
from strandlake.llm import queries as llm
from tests.compare import same

T0 = dt.datetime(2024, 5, 1)
REPORTS = "run_id string, replica_index int, cycle_no long, state_index int, reported_at timestamp, state string, first long, block int"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_as_sql(spark, small, duck, name):
    same(llm.QUERIES[name](spark, small), duck, llm.SQL[name])


# Runs of events


def _stretches(rows, tolerance=0, max_gap=None):
    """Runs by a plain loop: entity, state, first, last, reports, deliveries."""
    own = defaultdict(dict)
    for run, replica, cycle, state, *_ in rows:
        if None not in (run, replica, cycle, state):
            s, n = own[run, replica].get(cycle, (state, 0))
            own[run, replica][cycle] = (min(s, state), n + 1)
    out = []
    for entity, cycles in own.items():
        now = None
        for cycle in sorted(cycles):
            state, n = cycles[cycle]
            if now and abs(state - now[0]) <= tolerance and (max_gap is None or cycle - now[2] <= max_gap):
                now[2:] = [cycle, now[3] + 1, now[4] + n]
            else:
                now = [state, cycle, cycle, 1, n]
                out.append((entity, now))
    return {(*e, *r) for e, r in out}


@pytest.mark.parametrize("tolerance, max_gap, block", [(0, None, 7), (0, None, 4096), (0, 3, 7), (1, None, 7), (1, 2, 7)])
def test_runs_like_a_loop(spark, tolerance, max_gap, block):
    rnd = random.Random(11)
    rows = []
    for k in range(900):
        entity = ("a", 0) if rnd.random() < 0.4 else (rnd.choice(["a", "b", None]), rnd.choice([0, 1, None]))
        rows.append((*entity, rnd.choice([None, *range(120)]), rnd.choice([None, 2, 2, 2, 2, 3, 5]), T0, "x", 1, 2))
    df = spark.createDataFrame(rows, REPORTS)
    got = runs.collapse_runs(df, ["run_id", "replica_index"], "cycle_no", "state_index", "reported_at", tolerance, max_gap, block)
    found = [(r.run_id, r.replica_index, r.state, r["first"], r.last, r.n_reports, r.n_delivered) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _stretches(rows, tolerance, max_gap)


@pytest.mark.parametrize("step, tolerance, max_gap, block", [(0.2, 1.0, None, 5), (0.02, 1.0, None, 5), (0.4, 0.5, 2, 9), (0.0, 0.1, None, 4)])
def test_near_runs_of_drifting_entities_in_small_blocks(spark, step, tolerance, max_gap, block):
    """Random walks whose runs hang on the anchor that comes into a block, over many blocks of one hot entity."""
    rnd = random.Random(6)
    rows = []
    for entity, n in ((("a", 0), 400), (("b", 1), 60)):
        x = 0.0
        for cycle in range(n):
            x += rnd.uniform(-step, step) + step / 4
            if rnd.random() < 0.9:
                rows.append((*entity, cycle, round(x, 3), T0, "x", 1, 2))
    df = spark.createDataFrame(rows + rows[:30], REPORTS.replace("state_index int", "state_index double"))
    got = runs.collapse_runs(df, ["run_id", "replica_index"], "cycle_no", "state_index", "reported_at", tolerance, max_gap, block)
    found = [(r.run_id, r.replica_index, r.state, r["first"], r.last, r.n_reports, r.n_delivered) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _stretches(rows + rows[:30], tolerance, max_gap)


def test_durations_do_not_hang_on_the_session_zone(spark, small):
    want = {tuple(r) for r in llm.p1_events(spark, small).collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {tuple(r) for r in llm.p1_events(spark, small).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unknown_states_neither_break_nor_lengthen(spark):
    rows = [("a", 0, c, s, T0 + dt.timedelta(minutes=c), "", 0, 0) for c, s in enumerate([-1, 4, None, 4, -1, 4, None, 5, 5, -1])]
    got = runs.state_runs(spark.createDataFrame(rows, REPORTS)).orderBy("first").collect()
    assert [(r.state, r["first"], r.last, r.n_reports, r.duration, r.duration_s) for r in got] == [(4, 1, 5, 3, 4, 240.0), (5, 7, 8, 2, 1, 60.0)]
    assert runs.state_runs(spark.createDataFrame([], REPORTS)).count() == 0


# Percentiles


def test_percentiles_within_their_bound_however_merged(spark):
    rnd = random.Random(2)
    rows = [("hot" if k % 3 else rnd.choice("ab"), k % 5, rnd.choice([0.0, -1, 1]) * math.exp(rnd.gauss(0, 4))) for k in range(4000)]
    rows += [("a", 1, float("nan")), ("a", 1, float("inf")), ("b", 2, None), (None, 1, 5.0), ("tiny", 1, 1e-12), ("tiny", 2, -1e-300), ("tiny", 2, 0.0)]
    df = spark.createDataFrame(rows, "g string, day int, x double")
    at = [0.0, 0.01, 0.5, 0.9, 1.0]
    whole = sketch.percentiles(sketch.sketch(df, ["g"], "x"), ["g"], at)
    days = [sketch.sketch(df.filter(F.col("day") == k), ["g"], "x") for k in range(5)]
    merged = sketch.percentiles(sketch.merged(*days, by=["g"]), ["g"], at)
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))
    values = defaultdict(list)
    for g, _, x in rows:
        if x is not None and math.isfinite(x):
            values[g].append(x)
    for r in whole.collect():
        own = sorted(values[r.g])
        exact = own[max(1, math.ceil(r.q * len(own))) - 1]
        assert r.n == len(own) and abs(r.value - exact) <= 0.01 * abs(exact) * 1.000001 and r.low <= exact * (1 + math.copysign(1e-9, exact)) and r.high >= exact * (1 - math.copysign(1e-9, exact))
    assert sketch.percentiles(sketch.sketch(df.filter("false"), ["g"], "x"), ["g"], at).count() == 0


# Tokens

TEXTS = [
    (1, "The lipid’s bilayer  \n\n don't  move.\t42 Å"), (2, ""), (3, None), (3, None), (4, " " * 900), (5, "a" * 700), (6, "''s" * 300), (7, "\n" * 500 + "x"), (8, "分子膜" * 200),
    (9, "<|endoftext|> is text"), (10, "ab \n" * 300), (10, "ab \n" * 300), (None, "12 34 " * 100), (11, "é ́🙂‍" * 150), (12, "word " * 400 + "don't" * 90),
]


@needs_vocabulary
@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (100, 30), (64, 4)])
def test_chunked_encoding_is_the_whole_encoding(spark, chunk, overlap):
    df = spark.createDataFrame([(i, t, "x", [1], 0) for i, t in TEXTS], "doc_id long, text string, id string, ids array<int>, k int")
    encode = tokens._encoding(open(tokens.VOCABULARY, "rb").read(), tokens.PATTERN).encode_ordinary
    want = Counter((i, tuple(encode(t)) if t else ()) for i, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.encode_corpus(df, chunk=chunk, overlap=overlap).collect()) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(df, chunk=chunk, overlap=overlap).collect()) == sorted((str(i), len(v)) for (i, v), n in want.items() for _ in range(n))
    assert tokens.encode_corpus(df.filter("false")).count() == 0


@needs_vocabulary
def test_decoding_gives_the_text_back(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    back = tokens.decode_corpus(tokens.encode_corpus(df, chunk=100, overlap=30))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in TEXTS)


def test_boundaries_are_sure():
    assert tokens.boundaries("one two\nthree", tokens.PATTERN, 11) == [3, 7]


# Containers


def test_best_fit_takes_the_tightest_compatible_container():
    where, room = packing.best_fit([6, 5, 4, 4, 1], ["s", "t", "s", "s", None], ["p", "q", "p", None, "q"], 10)
    assert where[0] != where[2] and where[1] == where[2] and where[3] == where[0] and where[4] not in (where[1],) and room[where[0]] == 0
    assert packing.best_fit([0, 0], [None, None], [None, None], 5) == ([0, 0], [5]) and packing.best_fit([], [], [], 5) == ([], [])


@pytest.mark.parametrize("shard", [40, 100_000])
def test_containers_hold_every_token_once(spark, shard):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, 0, 1, 30, 64, 65, 500, rnd.randrange(1, 200)]), "hot" if k % 3 == 0 else f"s{k % 11}", rnd.choice([None, f"c{k % 60}"]), "x") for k in range(400)]
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, tokens long, source string, cluster string, shard string")
    got = packing.fill_containers(df, [64, 256], shard=shard).collect()
    for capacity in (64, 256):
        bins = defaultdict(list)
        for r in got:
            if r.capacity == capacity:
                bins[r.container].append(r)
        total = sum(n or 0 for _, n, *_ in rows)
        cluster = {r[0]: r[3] for r in rows}
        for held in bins.values():
            assert sum(r.tokens for r in held) + held[0].room == capacity and held[0].room >= 0
            ids = [cluster[r.doc_id] for r in held if r.tokens and cluster[r.doc_id]]
            assert len(ids) == len(set(ids))
        pieces = Counter((r.doc_id, r.piece) for held in bins.values() for r in held)
        want = Counter((i, k) for i, n, *_ in rows for k in range(max(1, -(-(n or 0) // capacity))))
        assert pieces == want and sum(r.tokens for held in bins.values() for r in held) == total
        assert len(bins) <= 1.06 * -(-total // capacity) + 2
        full = packing.fill(packing.fill_containers(df, [64, 256], shard=shard)).filter(F.col("capacity") == capacity).first()
        assert (full.tokens, full.containers, full.least_containers) == (total, len(bins), -(-total // capacity))
    assert packing.fill_containers(df.filter("false"), [64]).count() == 0


# Garbled text


def _wrong(text, read, wrote="utf-8"):
    return text.encode(wrote).decode(read)


GOOD = ["Żółta łódź, gęśla i jaźń", "La réplique «élevée» – où ?", "Größe der Übergangsfläche", "Периодическая ячейка между энергия", "transição não-estável", "60\xa0Å, 10⁻³, λ→λ, ±5 %", "分子 エネルギー 🧪 ﬁ", "¿Por qué? ¡Sí!", "run/\n├── a\n└── b", "Šeriães, Çelüş, Wójøy", "A & B &c; R&D", ""]


def test_correct_text_is_left_alone():
    search = mojibake.Searcher()
    assert [t for t in GOOD if mojibake.is_garbled(t, search)] == []
    assert all(mojibake.restore(t, search)[0] == t for t in GOOD)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-15"])
def test_utf8_read_wrongly_is_found_and_restored(read):
    search = mojibake.Searcher()
    for text in ("Größe der Übergangsfläche", "réplique élevée – très", "transição não estável", "Yorström, Følvik and Wójhardt"):
        try:
            bad = _wrong(text, read)
        except UnicodeDecodeError:
            continue
        assert mojibake.is_garbled(bad, search), (read, text)
        assert mojibake.restore(bad, search)[0] == text, (read, text)


def test_single_bytes_twice_and_in_part():
    search = mojibake.Searcher()
    polish = "Ta główna różnica między każda długość ścieżka częstość"
    assert mojibake.restore(_wrong(polish, "cp1252", "cp1250"), search)[0] == polish
    russian = "Периодическая ячейка между энергия. Каждая выборка без наша. Эта вся. Напротив, наша"
    for read, wrote in (("cp1252", "cp1251"), ("cp1251", "koi8-r")):
        assert mojibake.restore(_wrong(russian, read, wrote), search)[0] == russian
    assert mojibake.restore(_wrong(_wrong("élevée", "cp1252"), "cp1252"), search)[0] == "élevée"
    assert mojibake.restore("Good é here. " + _wrong("Größe", "cp1252") + " &Atilde;&copy;", search)[0] == "Good é here. Größe é"
    assert mojibake.is_garbled("pages 3\x964", search) and mojibake.restore("pages 3\x964", search)[0] == "pages 3–4"
    assert mojibake.is_garbled("r�plique", search) and mojibake.restore("r�plique", search)[2] == 1


def test_garbled_articles_are_restored(small, spark):
    """Correct articles of the test tables, misread: nearly all are found, and come back letter by letter."""
    search = mojibake.Searcher()
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if r.text]
    texts = [t for t in texts if not t.isascii() and not mojibake.is_garbled(t, search)]
    found = back = tried = 0
    for text in texts:
        for read in ("cp1252", "latin-1", "cp1251"):
            bad = "".join(c if c.isascii() else _wrong(c, read) if _readable(c, read) else c for c in text)
            if bad != text:
                tried += 1
                found += mojibake.is_garbled(bad, search)
                back += mojibake.restore(bad, search)[0] == text
    assert tried > 100 and found >= 0.99 * tried and back >= 0.9 * tried, (tried, found, back)


def test_long_stretches_are_searched_in_parts_and_unfinished_ones_counted(monkeypatch):
    search, text = mojibake.Searcher(), "полнаяповерхность" * 40
    bad = _wrong(text, "cp1252", "cp1251")
    assert len(bad) > mojibake.PART and mojibake.restore(bad, search)[0] == text and not mojibake.unfinished(bad, search)
    monkeypatch.setattr(mojibake, "MOST_STATES", 0)
    assert mojibake.unfinished("é", mojibake.Searcher()) == 1


def _readable(c, read):
    try:
        c.encode().decode(read)
    except UnicodeDecodeError:
        return False
    return True


def test_garbled_rows(spark):
    rows = [(1, "Größe", 0), (2, _wrong("Größe", "cp1252"), 0), (2, _wrong("Größe", "cp1252"), 0), (3, None, 0), (4, "", 0), (None, "x" * 100_000 + _wrong("é", "mac_roman"), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    assert Counter(r.doc_id for r in mojibake.garbled_documents(df).collect()) == Counter([2, 2, None])
    assert {r.doc_id: r.text[-5:] for r in mojibake.restored_documents(df).collect()} == {2: "Größe", None: "xxxxé"}
    assert mojibake.garbled_documents(df.filter("false")).count() == 0
