"""Operations on notes and the files beside them."""

from pyspark.sql import functions as F

from tessera.sources import outputs


def test_operations_on_notes(spark, tmp_path):
    for name in ("a.md", "a.md.json", "a.md.diff.json", "a.srt", "b.md", "b.md.json", "c.md", "d.md", "e.md", "e.srt", "f.md", "g.md"):
        (tmp_path / name).write_text(name)
    ops = [(1, "a", "rename", " A.md "), (2, "b", "rename", "c"), (3, "c", "delete", None), (4, "d", "dismiss", None), (5, "e", "rename", "A"), (6, "x", "delete", None), (7, "f", "rename", "../f"), (8, "g", "rename", "  "), (9, "d", "rename", "D")]
    told = outputs.apply(spark.createDataFrame(ops, "id long, stem string, op string, next string"), str(tmp_path)).collect()
    got = {r.id: (r.result, r.missing) for r in told}
    assert got == {1: ("accepted", 0), 2: ("taken", 0), 3: ("accepted", 3), 4: ("accepted", 0), 5: ("taken", 0), 6: ("absent", 0), 7: ("refused", 0), 8: ("refused", 0)}
    left = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert left == {"A" + n[1:]: n for n in ("a.md", "a.md.json", "a.md.diff.json", "a.srt")} | {n: n for n in ("b.md", "b.md.json", "d.md", "e.md", "e.srt", "f.md", "g.md")}


def test_operations_on_shelves(spark, tmp_path):
    """Notes of a folder with shelves have the same fate, work is dealt to all tasks, and no folder holds all files."""
    rows = spark.range(60).selectExpr("id", "concat('n', id) AS stem")
    names = [r[0] for e in (".md", ".srt") for r in rows.select(F.concat(outputs.shelf(F.col("stem"), 7), F.lit(e))).collect()]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name.split("/")[1])
    ops = rows.selectExpr("id", "stem", "CASE WHEN id % 3 = 0 THEN 'delete' ELSE 'rename' END AS op", "concat('n', id * 2) AS next").where("id < 50")
    told = outputs.apply(ops, str(tmp_path), 7)
    assert told.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = {r.id: r.result for r in told.collect()}
    assert got == {k: "accepted" if k % 3 == 0 or k >= 30 else "taken" for k in range(50)}
    want = {f"n{k * 2 if got.get(k) == 'accepted' else k}{e}": f"n{k}{e}" for k in range(60) if not (k < 50 and k % 3 == 0) for e in (".md", ".srt")}
    assert {r.name: bytes(r.content).decode() for r in outputs.listed(spark, str(tmp_path), 7, content=True).collect()} == want
    assert {p.name for p in tmp_path.iterdir()} <= set(map(str, range(7)))
    assert outputs.stems(spark, str(tmp_path), 7).count() == len(want) / 2


def test_a_rename_can_be_done_again(tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.md").hardlink_to(tmp_path / "a.md")  # a rename that stopped half-way
    assert outputs.do_one(str(tmp_path), "a", "rename", "b") == outputs.do_one(str(tmp_path), "a", "rename", "b") == 0
    assert [p.name for p in tmp_path.iterdir()] == ["b.md"]
    (tmp_path / "c.md").write_text("another")
    outputs.do_one(str(tmp_path), "b", "rename", "c")
    assert (tmp_path / "b.md").read_text() == "x" and (tmp_path / "c.md").read_text() == "another"
