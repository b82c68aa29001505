"""Text files of many columns, and of many blocks."""

from strandlake.sources import text as X


def test_every_column_is_a_set(spark, tmp_path):
    (tmp_path / "wide.txt").write_text("".join(" ".join(str(k + row) for k in range(1203)) + "\n" for row in (0, 10)))
    got = {(r.set, r.pos): r.y for r in X.read_nxy(spark, str(tmp_path)).collect()}
    assert len(got) == 2404 and got[1201, 0] == 1202.0 and got[1201, 1] == 1212.0


def test_lines_over_blocks(spark, tmp_path):
    made = [f"{k} {'x' * (k % 17)}".strip() if k % 5 else "" for k in range(400)]
    (tmp_path / "a.txt").write_text("\r\n".join(made) + "\r\n")
    (tmp_path / "b.txt").write_text("only")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        rows = X.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.text for r in sorted(rows, key=lambda r: r.line) if r.file.endswith("a.txt")] == made
    assert sorted(r.line for r in rows if r.file.endswith("a.txt")) == list(range(400))
    assert [(r.line, r.text) for r in rows if r.file.endswith("b.txt")] == [(0, "only")]
