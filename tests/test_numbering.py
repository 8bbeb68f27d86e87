import random
import re

from phrasemill.operators.numbering import number_by_line
from phrasemill.operators.questions import combine_questions, renumber
from phrasemill.sources.text import read_lines, read_raw_lines, scan_lines, write_lines


def test_positions_over_many_buckets(spark):
    rng = random.Random(7)
    ids = set(range(50)) | {rng.randrange(1 << 21) for _ in range(200)} | {rng.randrange(1 << 45) for _ in range(200)}
    df = spark.createDataFrame([(i,) for i in rng.sample(sorted(ids), len(ids))], "line_no bigint")
    got = {r.line_no: r.position for r in number_by_line(df).collect()}
    assert got == {n: i for i, n in enumerate(sorted(ids))}


def test_file_order_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    for part in range(5):
        (tmp_path / f"p{part}.txt").write_text("\n".join(lines[part * 1000:(part + 1) * 1000]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_raw_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        assert [r.line for r in sorted(df.collect())] == lines
        assert sorted(r.line_no for r in df.collect()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_cleaning(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\n  // note\n 1.  First 2. thing 　\n\n\tsecond\n//x\n12.third\n3 . no\n")
    kept = read_lines(spark, str(tmp_path / "q.txt"))
    assert [(r.line_no, r.line) for r in sorted(kept.collect())] == [
        (2, "1.  First 2. thing"), (4, "second"), (6, "12.third"), (7, "3 . no")]
    numbered = renumber(read_raw_lines(spark, str(tmp_path / "q.txt")))
    assert [r.line for r in sorted(numbered.collect())] == [
        "61. First 2. thing", "62. second", "63. third", "64. 3 . no"]


def test_combined_file(spark, tmp_path):
    old = spark.createDataFrame([(1, "5. keep"), (2, "// no"), (3, " also ")], "line_no bigint, line string")
    new = spark.createDataFrame([(9, "7. b"), (4, "a")], "line_no bigint, line string")
    write_lines(combine_questions(old, new), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "5. keep\nalso\n61. a\n62. b\n"


def test_a_scan_is_numbered_without_moving_lines(spark, tmp_path):
    """Many splits, some without a line that is kept; only counts of splits are exchanged."""
    rng = random.Random(3)
    kinds = ["", "  // note", "7. keep me ", "   ", "plain 3. text"]
    lists = []
    for name in ("existing", "generated"):
        (tmp_path / name).mkdir()
        lines = [rng.choice(kinds) if rng.random() < 0.5 else f"{i}. line {i}" for i in range(4000)] + [""] * 600
        for part in range(3):
            (tmp_path / name / f"{part}.txt").write_text("\n".join(lines[part::3]) + "\n")
        lists.append([line.strip() for part in range(3) for line in lines[part::3]])
    keep = [[x for x in part if x and not x.startswith("//")] for part in lists]
    paths = [str(tmp_path / n) for n in ("existing", "generated")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = combine_questions(*(scan_lines(spark, p) for p in paths))
        rows = [(r.source, r.position, r.line) for r in out.collect()]
        new = [re.sub(r"^\d+\.\s*", "", x) for x in keep[1]]
        assert sorted(rows) == [(0, i, x) for i, x in enumerate(keep[0])] + [(1, i, f"{i + 61}. {x}") for i, x in enumerate(new)]
        assert [r.line for r in read_lines(spark, paths[0]).orderBy("line_no").collect()] == keep[0]
        plan = renumber(scan_lines(spark, paths[1]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all("line#" not in row for row in plan.splitlines() if "Exchange" in row) and "BroadcastExchange" in plan
