"""Folders as a source, and moves that stop at each of their steps."""

import json
import os

import pytest

from tessera.sources import moves, tree


def put(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_tree_of_folders(spark, tmp_path):
    top = tmp_path / "top"
    for name in ("one", "a/two", "a/b/three", "c/d/e/four", "é/fünf.md"):
        put(top / name, name)
    (top / "empty").mkdir()
    os.symlink(top, top / "a" / "loop")
    os.symlink(top / "one", top / "linked")
    names = lambda **how: sorted((r.relative, r.depth, r.size) for r in tree.tree(spark, str(top), **how).collect())
    assert names() == sorted((n, n.count("/"), len(n.encode())) for n in ("one", "a/two", "a/b/three", "c/d/e/four", "é/fünf.md"))
    assert [n for n, _, _ in names(depth=0)] == ["one"]
    assert [n for n, _, _ in names(depth=1)] == ["a/two", "one", "é/fünf.md"]
    assert {r.relative: bytes(r.content).decode() for r in tree.tree(spark, str(top), content=True).collect()} == {n: n for n in ("one", "a/two", "a/b/three", "c/d/e/four", "é/fünf.md")}
    assert tree.tree(spark, str(tmp_path / "nothing")).count() == 0
    # the last names of the last path come first when there are too many
    got = [r.path[len(str(top)) + 1 :] for r in tree.expand(spark, [f"{top}/one", f"{top}/a", f"{top}/linked", f"{top}/c"], most=3).collect()]
    assert got == ["a/b/three", "a/two", "c/d/e/four"] and tree.expand(spark, []).count() == 0


def test_registry_of_manifests(spark, tmp_path):
    layer = "application/model"
    good = lambda digest, size=5: json.dumps({"layers": [{"mediaType": "other", "digest": "sha256:ff", "size": 1}, {"mediaType": layer, "digest": digest, "size": size}]})
    for name, text in {"h/library/m/t": good("sha256:ab"), "h/ns/m/t": good("sha256:cd", 7), "m/t": good("sha256:ab"), "h/x/m/no-blob": good("sha256:ee"), "h/x/m/bad": "{", "h/x/m/odd": good("md5:ab"), "h/x/m/hex": good("sha256:xyz"), "h/x/m/none": "{}"}.items():
        put(tmp_path / "manifests" / name, text)
    for digest in ("ab", "cd"):
        put(tmp_path / "blobs" / f"sha256-{digest}")
    assert sorted(map(tuple, tree.registry(spark, str(tmp_path), layer).collect())) == [("m:t", "ab", 5), ("ns/m:t", "cd", 7)]


class Crash(Exception):
    pass


def draft(base, stem="d", **files):
    for name, text in files.items():
        put(base / stem / {"raw": "raw.md", "summary": "summary.md", "merged": "merged.md", "meta": "meta.json"}[name], text)


def contents(folder):
    return {p.name: p.read_text() for p in folder.iterdir()} if folder.is_dir() else None


def steps(tmp_path):
    seen = []
    draft(tmp_path / "probe", raw="r", summary="s", meta="{}")
    moves.move_one(str(tmp_path / "probe"), str(tmp_path / "probe-to"), "d", seen.append)
    return seen


def test_a_move_may_stop_anywhere(tmp_path):
    seen = steps(tmp_path)
    assert seen[0] == "noting" and seen[-1] == "dropped" and len(seen) == 11
    whole = {"raw.md": "r", "summary.md": "s", "meta.json": "{}"}
    for k, stop in enumerate(seen):
        old, new = tmp_path / f"old{k}", tmp_path / f"new{k}"
        draft(old, raw="r", summary="s", meta="{}")

        def crash(step, stop=stop):
            if step == stop:
                raise Crash

        with pytest.raises(Crash):
            moves.move_one(str(old), str(new), "d", crash)
        assert whole in (contents(old / "d"), contents(new / "d"))  # nothing is lost meanwhile
        assert moves.move_one(str(old), str(new), "d") == ("moved", 3, 4)
        assert contents(new / "d") == whole and not (old / "d").exists()
        assert moves.move_one(str(old), str(new), "d") == ("moved", 3, 4)


def test_moves_leave_alone_what_is_not_theirs(tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    draft(old, raw="mine")
    draft(new, raw="theirs")
    assert moves.move_one(str(old), str(new), "d")[0] == "taken"
    assert contents(old / "d") == {"raw.md": "mine"} and contents(new / "d") == {"raw.md": "theirs"}
    assert [moves.move_one(str(old), str(new), x)[0] for x in ("nothing", "", "..", "a/b", ".moves")] == ["absent", "refused", "refused", "refused", "refused"]
    # a draft that is edited after it was copied stays
    draft(old, "e", raw="first")

    def edit(step):
        if step == "placed":
            draft(old, "e", raw="edited")

    assert moves.move_one(str(old), str(new), "e", edit)[0] == "changed"
    assert contents(old / "e") == {"raw.md": "edited"} and contents(new / "e") == {"raw.md": "first"}


def test_moves_of_many_drafts(spark, tmp_path):
    for i in range(30):
        draft(tmp_path / "old", f"d{i}", raw=f"r{i}", meta="{}")
    stems = spark.createDataFrame([(f"d{i}",) for i in range(32)] + [(None,)], "stem string")
    for _ in range(2):
        got = {r.stem: r.result for r in moves.move_all(stems, f"file://{tmp_path}/old", f"file://{tmp_path}/new").collect()}
        assert got == {f"d{i}": "moved" for i in range(30)} | {"d30": "absent", "d31": "absent", None: "refused"}
    assert all(contents(tmp_path / "new" / f"d{i}") == {"raw.md": f"r{i}", "meta.json": "{}"} for i in range(30))


def test_a_tree_has_so_many_partitions_however_many_folders(spark, tmp_path):
    """Each file is in one of them, and those of one folder are in several."""
    for k in range(300):
        put(tmp_path / f"d{k}" / "deep" / "f", str(k))
        put(tmp_path / f"f{k}", str(k))
        put(tmp_path / "d0" / f"f{k}", str(k))
    reader = tree.TreeReader({"path": str(tmp_path), "shares": "8"})
    parts = [[p for batch in reader.read(share) for p in batch.column("relative").to_pylist()] for share in reader.partitions()]
    assert len(parts) == 8 and sorted(p for part in parts for p in part) == sorted([f"d{k}/deep/f" for k in range(300)] + [f"f{k}" for k in range(300)] + [f"d0/f{k}" for k in range(300)])
    assert all(sum("/" not in p for p in part) > 10 for part in parts)
    assert tree.tree(spark, str(tmp_path)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_batches_of_a_tree_are_bounded_by_bytes(tmp_path):
    for k in range(12):
        put(tmp_path / f"f{k}", "x" * (1 << 20))
    batches = list(tree.TreeReader({"path": str(tmp_path), "shares": "1", "content": "true"}).read(tree.Share(0, 1)))
    assert sum(b.num_rows for b in batches) == 12 and max(b.nbytes for b in batches) < 5 << 20
