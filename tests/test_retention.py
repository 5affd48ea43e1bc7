"""Retention of sources on disk, and drafts folded from operations."""

import random

import pytest

from tessera.operators import drafts
from tessera.sources import retention


@pytest.mark.parametrize(("path", "ext"), [("a/b.MP3", ".mp3"), ("b", ".wav"), ("a.b/c", ".wav"), ("x.recording", ".wav"), ("x.flac", ".flac"), ("C:\\d.e\\f.Ogg", ".ogg"), ("x.", ".")])
def test_extensions(path, ext):
    assert retention.archive_extension(path) == ext


def test_sources_are_kept_deleted_or_archived(tmp_path):
    folder, source = tmp_path / "out", tmp_path / "s.wav"
    one = lambda setting, video=False, path=source: retention.apply_one(str(path), str(folder), "T", setting, video)
    source.write_text("mine")
    assert one("keep") == one("whatever") == one("delete", True) == one("archive", True) == ("keep", None) and source.exists()
    assert one("archive") == one("archive") == ("archive", "T.src.wav")
    source.write_text("another one")
    assert one("archive") == one("archive") == ("archive", "T.src.wav (2)")
    assert one("archive", path=folder / "T.src.wav") == ("archive", "T.src.wav")  # it lies there already
    assert sorted(p.name for p in folder.iterdir()) == ["T.src.wav", "T.src.wav (2)"]
    assert one("delete") == ("delete", None) and not source.exists() and one("delete") == ("absent", None)


def test_drafts_equal_the_loop(spark):
    rng = random.Random(4)
    ops = [(rng.choice([*range(8), None]), seq, rng.choice(["open", "open", "save", "save", "save", "delete", "what", None]), rng.choice(["a", "b", "c", None])) for seq in range(300)]
    want = {}
    past = {}
    for i, seq, op, body in ops:
        if i is None:
            continue
        body = body or ""
        if op == "open" and i not in want:
            want[i] = [body, seq, 0]
        elif op == "save" and i in want:
            want[i] = [body, seq, want[i][2] + 1]
        elif op == "save":
            past[i] = past.get(i, 0) + 1
        elif op == "delete":
            want.pop(i, None)
    rng.shuffle(ops)
    got = drafts.fold(spark.createDataFrame(ops, "id long, seq long, op string, body string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *v, past.get(i, 0)) for i, v in want.items())
