"""Literal cases of the functions, and plain-loop versions of folds."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import html as H
from tessera.functions import text as T
from tessera.operators import cues, signal, similarity
from tessera.plans.source_queries import _office, make_project
from tessera.sources import audio, documents, sinks


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


@pytest.mark.parametrize(("f", "cases"), [
    (T.parse_day, {"Bio - Day 4 - mitosis": "Day 4", "lec12_intro": "Day 12", "Lecture 4 - atman": "Day 4", "2024-03-01 lecture": "2024-03-01", "04 - sacred sites": "Day 04", "no tokens here xyz": None, "Monday 5": "Day 5"}),
    (T.heuristic_name, {"Biology/lec12_intro.mp3": "Biology - Day 12 - lec12_intro", "Day 4 - mitosis.wav": "General - Day 4 - mitosis"}),
    (T.url_allowed, {"http://a.b/c": True, "https://a": True, "file:///x": False, "data:x": False, "javascript:x": False, "https://": False, "C:\\x": False, "https://u@h": False, "https://a b": False}),
    (T.confined, {"sub/y.md": True, "Y.MD": True, "/x.md": False, "C:x.md": False, "../x.md": False, "a/../b.md": False, "x.md:s": False, "x.exe": False, "\\x.md": False}),
    (T.parse_stamp, {"[00:01] x": 1000, "[1:02:03] far": 3723000, "[0:61] x": -1, "[ab] [00:01]": -1, "none": -1}),
    (T.strip_topic_lead, {"## Summary: - Mitosis": "Mitosis", "“Overview the cell": "the cell", "Overview” x": "Overview” x", "-dash": "-dash", "Summaryx": "Summaryx", "• tl;dr — a": "a"}),
    (T.strip_bracketed, {"[12:03] a": " a", "[unclosed": "[unclosed", "[" + "x" * 24 + "]": "[" + "x" * 24 + "]"}),
    (lambda c: F.array_join(T.query_terms(c, 9), " "), {"Day 4 - The Mitosis Lecture (Part 2)": "mitosis"}),
    (H.extract_html, {"<h1>Title</h1><script>var t='</p>';</script><p>Hello <b>world</b> &amp; friends</p><style>p{}</style>": "Title\n\nHello world & friends"}),
    (H.strip_subtitles, {"WEBVTT\n\n12\n00:01 --> 00:02\nhello there\nhello there\n123 go\n00:00:01,000\n[x]\nchapter 2: intro": "hello there\n123 go\nchapter 2: intro"}),
    (lambda c: T.sidecar_int(c, "chunks"), {'{"chunks": 90}': 90, '{"x":1}': None, "not json": None}),
])
def test_literals(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


@pytest.mark.parametrize(("a", "b", "newer"), [("0.1.0", "0.2.0", True), ("0.1.0", "v0.1.1", True), ("0.2.0", "0.2.0", False), ("0.2.0", "0.1.9", False), ("0.1.0", "0.1.0-rc1", False), ("0.9", "0.10", True)])
def test_versions(spark, a, b, newer):
    assert spark.range(1).select(T.version_newer(F.lit(a), F.lit(b))).first()[0] is newer


def test_cues_of_the_golden_transcript(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["[00:01] hello", "continued line", "[00:05] world", "[1:02:03] far"])], "k int, i int, line string")
    got = [tuple(r) for r in cues.srt_cues(lines, "k", "i", F.lit(3733000).cast("long")).orderBy("idx").collect()]
    assert got == [(1, 1, 1000, 5000, "hello continued line"), (1, 2, 5000, 3723000, "world"), (1, 3, 3723000, 3733000, "far")]


def pack(text, target):
    """The plain loop of greedy packing."""
    out, cur, size = [], "", 0
    for w in text.split():
        n = len(w.encode()) // 4 + 1
        if cur and size + 1 + n > target:
            out.append(cur)
            cur, size = "", 0
        cur, size = (f"{cur} {w}", size + 1 + n) if cur else (w, n)
    return [*out, cur]


def test_chunks_equal_the_loop(spark):
    random.seed(3)
    texts = [" ".join("x" * random.randint(1, 30) for _ in range(random.randint(0, 60))) for _ in range(60)] + ["", "  ", "w" * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for target in (5, 20):
        got = [r[0] for r in df.select("i", cues.chunks(F.col("t"), target).alias("c")).orderBy("i").select("c").collect()]
        assert got == [pack(t, target) for t in texts]


def test_sentences_keep_the_place_where_the_last_one_ended(spark):
    rows = [(1, 0, " One two"), (1, 1, "three. Four"), (1, 2, "five! Six... "), (1, 5, "Seven"), (2, 3, None), (2, 4, "No mark"), (2, 6, " \n "), (3, 1, "?")]
    got = cues.sentences(spark.createDataFrame(rows, "key long, t long, text string"), "key", "t").orderBy("key", "n").collect()
    assert [tuple(r)[:1] + (r.t, r.sentence) for r in got] == [(1, 0, "One two three."), (1, 1, "Four five!"), (1, 2, "Six."), (1, 2, "."), (1, 2, "."), (1, 2, "Seven"), (2, 4, "No mark"), (3, 1, "?")]


def plain_diff(old, new):
    """The walk through the whole table of lengths."""
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in reversed(range(len(old))):
        for j in reversed(range(len(new))):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            out.append((" ", old[i]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(("-", old[i]))
            i += 1
        else:
            out.append(("+", new[j]))
            j += 1
    return out + [("-", x) for x in old[i:]] + [("+", x) for x in new[j:]]


def test_lcs_diff():
    assert cues.lcs_diff(["a", "b", "c"], ["a", "C", "d"]) == [(" ", "a"), ("-", "b"), ("-", "c"), ("+", "C"), ("+", "d")]
    rng = random.Random(9)
    for size in [0, 1, 2, 5, 40, 130] * 8:
        old, new = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, size))] for _ in range(2))
        new = rng.choice([new, old[: size // 2] + new + old[size // 2 :]])
        assert cues.lcs_diff(old, new) == plain_diff(old, new)
    assert [cues.lines_of(x) for x in (None, "", "a\n", "\n", "a\n\n", "a\nb")] == [[""], [""], ["a"], [""], ["a", ""], ["a", "b"]]
    assert cues.lcs_diff(["x"] * 2001, ["y"])[:1] == [("-", "x")] and len(cues.lcs_diff(["x"] * 2001, ["y"])) == 2001


def test_diffs_of_long_texts_are_whole(spark):
    """Past 2,000 lines as before: lines that stay are no changes."""
    old = [f"line {k % 900}" for k in range(2500)]
    new = [*old[:7], "and one more", *old[7:1200], *old[1201:]]
    got = cues.line_diffs(spark.createDataFrame([(1, "\n".join(old), "\n".join(new))], "id long, old string, new string")).first()["diff"]
    assert [(x["t"], x["text"]) for x in got if x["t"] != " "] == [("+", "and one more"), ("-", "line 300")]
    assert [x["text"] for x in got if x["t"] != "+"] == old and [x["text"] for x in got if x["t"] != "-"] == new


@pytest.mark.parametrize("n", [3, 50, 90])
def test_lcs_diff_of_lines_that_are_rare_and_frequent(n):
    rng = random.Random(n)
    old, new = ([rng.choice(["", "", "x", *map(str, range(n))]) for _ in range(3 * n)] for _ in range(2))
    assert cues.lcs_diff(old, new, None) == plain_diff(old, new)

def test_similar_items_form_one_group(spark):
    items = spark.createDataFrame([(1, "l", "the cell divides during mitosis today"), (2, "l", "the cell divides during mitosis today"), (3, "l", "unrelated words entirely elsewhere")], "id long, lib string, text string")
    pairs = similarity.cosine_pairs(items)
    assert [(r.a, r.b) for r in pairs.where("score > 0.99").collect()] == [(1, 2)]
    assert [(r.members, r.band) for r in similarity.groups(pairs, 0.35, 0.8).collect()] == [("1,2", "prompt")]


@pytest.mark.parametrize("kind", ["docx", "pptx", "odt", "epub", "xlsx", "rtf", "txt"])
def test_documents_keep_their_words(kind):
    path, found, text, pages, error = documents.extract(f"a.{kind}", _office("First words\nécole zwei & <b>", kind))
    assert error is None and pages >= 1
    assert "First words" in text and "école zwei" in text


def test_unreadable_documents_say_why():
    for name, raw in (("a.docx", b"junk"), ("a.doc", b"junk"), ("a.pdf", b"%PDF"), ("a.bin", b""), ("a.txt", b" \n ")):
        assert documents.extract(name, raw)[4] and documents.extract(name, raw)[2] == ""


def test_takes_round_trip():
    table = np.array([[1, -2], [3, 4], [-8388608, 8388607], [0, 5]])
    for finished in (True, False):
        raw = audio.rf64(table, 16000, finished)
        h = audio.header(raw)
        assert (h.rate, h.channels, h.bits, h.frames) == (16000, 2, 24, 4)
        assert np.array_equal(np.round(audio.samples(raw) * (1 << 23)).astype(int), table)
        assert np.array_equal(audio.samples(raw, 1, 2, 1)[:, 0] * (1 << 23), [4, 8388607])
        assert audio.repair(raw) == audio.rf64(table, 16000)
    with pytest.raises(ValueError):
        audio.header(b"RIFFxxxxWAVE")


def test_projects_mix():
    tone = [0.5 * np.sin(i / 5) for i in range(8000)]
    mix, rate = audio.render(make_project(tone, True))
    assert len(mix) == 8000 and rate == 8000 and 0.12 < np.sqrt((mix**2).mean()) < 0.24
    loud, _ = audio.render(make_project([0.9] * 8000, False))
    assert abs(np.abs(loud).max() - 0.99) < 1e-6
    for bad in (b"", b"SQLite format 3\0" + b"x" * 200):
        with pytest.raises(ValueError):
            audio.render(bad)


def test_gate_quiets_noise_and_keeps_speech():
    noise = np.random.default_rng(1).normal(0, 0.001, 16000 * 4)
    noise[32000:48000] += 0.2 * np.sin(np.arange(16000) / 8)
    out = signal.denoise(noise)
    assert np.abs(out[40000:47000]).mean() > 20 * np.abs(out[:16000]).mean()


def test_log_tail_keeps_order_and_drops_a_cut_line(spark):
    rows = ["", "a\r\nb\n", "\n".join(f"l{i}" for i in range(250)), "x" * 3000, "head\n" + "y" * 262140 + "\nend", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(T.log_tail(F.col("t"))).collect()]
    assert [tuple(r) for r in got[:2]] == [("", False), ("a\nb", False)]
    assert tuple(got[2]) == ("\n".join(f"l{i}" for i in range(50, 250)), True)
    assert tuple(got[3]) == ("x" * 2000 + "…", False)
    assert tuple(got[4]) == ("end", True)


def test_fnv_of_known_strings(spark):
    start, prime = 1469598103934665603, 1099511628211
    for text in ("", "a", "Grüße/é.wav"):
        want = start
        for b in text.encode():
            want = (want ^ b) * prime % 2**64
        assert spark.range(1).select(T.fnv(T.bytes_of(F.lit(text)))).first()[0] == f"{want:016x}"


def test_chunks_of_words(spark):
    texts = ["", "  ", "one", "aa " * 50, "word " + "z" * 100 + " tail", "a\n b\tc"]
    for target in (1, 5, 12):
        got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(cues.chunks(F.col("t"), target)).collect()]
        for text, parts in zip(texts, got, strict=True):
            want, size = [], 0
            for w in text.split():
                own = len(w.encode()) // 4 + 1
                if want and size + 1 + own <= target:
                    want[-1] += " " + w
                    size += 1 + own
                else:
                    want.append(w)
                    size = own
            assert parts == (want or [""])


def test_a_muted_solo_track_is_not_heard_and_long_projects_are_refused(monkeypatch):
    tracks = lambda *flags: {"rate": 8000.0, "tracks": [{"track": i, "mute": m, "solo": s, "gain": 1.0, "pan": -1.0, "rate": -1.0} for i, (m, s) in enumerate(flags)], "points": [], "samples": {i: (audio.FLOAT32, np.full(10, 0.1 * (i + 1), "<f4").tobytes()) for i in range(len(flags))}, "blocks": [{"track": i, "clip": 0, "offset": 0.0, "trim_left": 0.0, "trim_right": 0.0, "block": i, "start": 0, "end": 10, "total": 10} for i in range(len(flags))]}
    heard = {}
    for name, flags in {"muted solo": [(True, True), (False, False)], "solo": [(False, True), (False, False)], "none": [(False, False), (False, False)]}.items():
        monkeypatch.setattr(audio, "project_rows", lambda _, f=flags: tracks(*f))
        heard[name] = round(float(audio.render(b"")[0][0]) * 2**0.5, 4)
    assert heard == {"muted solo": 0.2, "solo": 0.1, "none": 0.3}
    with pytest.raises(ValueError, match="too long"):
        audio.render(b"", hours=1e-7)


def test_last_write_of_a_key_wins_over_versions(spark, tmp_path):
    schema, store = "k long, v string, seq long", f"file://{tmp_path}/s"
    sinks.upsert(store, spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "c", 3), (None, "n", 1)], schema), "k", F.col("seq"))
    before = {p.name for p in (tmp_path / "s" / "data").iterdir()}
    out = sinks.upsert(store, spark.createDataFrame([(2, "d", 4), (3, None, 5), (1, "old", 0)], schema), "k", F.col("seq"), buckets=3)
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "a", 1), (2, "d", 4), (3, None, 5), (None, "n", 1)]
    assert sorted(map(tuple, sinks.upsert(store, spark.createDataFrame([], schema), "k", F.col("seq")).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    # only the buckets of the written keys were written again
    again = [p for p in (tmp_path / "s" / "data").iterdir() if p.name not in before]
    assert sum(len(list(p.glob("bucket=*"))) for p in again) == 3


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    schema, store = "k long, v string, seq long", f"file://{tmp_path}/s"
    write = lambda *rows: sinks.upsert(store, spark.createDataFrame(list(rows), schema), "k", F.col("seq"))
    write((1, "a", 1))
    commit, other = sinks._commit, []

    def late(session, where, n, places):
        if not other:  # another writer commits first
            other.append(True)
            monkeypatch.setattr(sinks, "_commit", commit)
            write((1, "other", 2), (5, "other", 2))
            monkeypatch.setattr(sinks, "_commit", late)
        return commit(session, where, n, places)

    monkeypatch.setattr(sinks, "_commit", late)
    assert sorted(map(tuple, write((1, "mine", 3), (7, "mine", 3)).collect())) == [(1, "mine", 3), (5, "other", 2), (7, "mine", 3)]


def test_sizes_round_as_c_does(spark):
    cases = {1280: "1.2 KB", 3328: "3.2 KB", 1023: "1023 B", 1024: "1.0 KB", 1792: "1.8 KB", (1 << 20) - 1: "1024.0 KB", 5 << 29: "2.5 GB", 9 * (1 << 62) // 8: "4831838208.0 GB"}
    assert values(spark, lambda c: T.fmt_size(c.cast("long")), [str(k) for k in cases]) == list(cases.values())


def test_dates_of_far_years_have_no_sign(spark):
    assert values(spark, lambda c: T.civil_date(c.cast("long")), ["0", "2932896", "2932897", None]) == ["1970-01-01", "9999-12-31", "10000-01-01", None]


def test_doubles_round_as_sql_does(spark):
    texts = ["0.1288875", "0.0000005", "-0.0000005", "2.5e-7", "1e300", "0.3256125", "1.0000015"]
    want = duckdb.sql(f"SELECT {', '.join(f'round(CAST({x} AS DOUBLE), 6)' for x in texts)}").fetchall()[0]
    assert values(spark, lambda c: T.rounded(c.cast("double"), 6), texts) == list(want)


def test_frames_of_a_video_are_scheduled_without_a_shuffle(spark):
    plan = registry.QUERIES["win_frame_schedule"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
