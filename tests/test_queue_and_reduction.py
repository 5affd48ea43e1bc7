"""The command queue as a stream with restarts, and the reduction tree against plain recursion."""

import random

import pytest

from tessera.operators import models, reduction
from tessera.streaming import queue

COMMANDS = "queue long, seq long, command string, path long"
KINDS = ["add"] * 6 + ["step"] * 4 + ["remove"] * 2 + ["pause", "resume", "resume", "abort", "clear", "what"]


def plain_queue(commands):
    """A list and a few variables for each queue."""
    out, state = [], {}
    commands = [r for r in commands if r[0] is not None]
    for q, seq, command, path in sorted(commands, key=lambda r: r[1]):
        s = state.setdefault(q, {"wait": [], "paused": False, "mark": False, "n": 0, "active": None})
        result, told, file = "unknown", None, None
        if command == "add":
            result, told = ("refused", None) if path is None else ("added", path)
            s["wait"] += [] if path is None else [path]
        elif command == "remove":
            result, told = ("removed" if path in s["wait"] else "absent"), path
            if path in s["wait"]:
                s["wait"].remove(path)
        elif command == "clear":
            s["wait"], s["n"], result = [], 0, "cleared"
        elif command in ("pause", "resume"):
            s["paused"], result = command == "pause", command + "d"
        elif command == "abort":
            s["mark"], result = True, "marked"
        elif command == "step" and s["mark"]:
            result, (file, told) = "aborted", s["active"] or (None, None)
            s["mark"], s["active"] = False, None
        elif command == "step" and s["paused"]:
            result = "waits"
        elif command == "step":
            s["active"], result = None, "idle"
            if s["wait"]:
                result, told, file = "started", s["wait"].pop(0), s["n"]
                s["active"], s["n"] = (file, told), s["n"] + 1
        out.append((q, seq, command, result, told, file, len(s["wait"])))
    return sorted(out, key=repr)


def test_queue_goes_on_after_restarts(spark, tmp_path):
    rng = random.Random(1)
    commands = [(rng.choice([1, 2, 3, None]), i, rng.choice(KINDS), rng.choice([1, 2, 3, 4, None])) for i in range(600)]
    # each file is a later part of the stream; the last one delivers the first commands again
    parts = [commands[:7], commands[7:200], commands[200:350], commands[350:], commands[:50]]
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = queue.run(spark, stream, str(tmp_path / "out"))
        if k in (1, 4):
            seen = [r for p in parts[: k + 1 if k < 4 else 4] for r in p]
            assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_queue(seen)


def test_queue_commands():
    q = queue.Queue([])
    told = [q.apply(*x)[0] for x in [("step", None), ("add", 1), ("add", 2), ("add", 1), ("remove", 1), ("step", None), ("pause", None), ("step", None), ("abort", None), ("step", None), ("step", None), ("resume", None), ("step", None), ("clear", None), ("remove", 9), ("add", None)]]
    assert told == ["idle", "added", "added", "added", "removed", "started", "paused", "waits", "marked", "aborted", "waits", "resumed", "started", "cleared", "absent", "refused"]


# --- reduction


def upper(words):
    """A model that answers the first words of what it is asked, in capitals, and fails where it is told to."""

    class Upper:
        def generate(self, prompts):
            return [None if "FAIL" in p else "" if "EMPTY" in p else " ".join(p.split()[:words]).upper() for p in prompts]

    return Upper()


def plain_reduce(text, limit, target, model, depth=0, deepest=6):
    """(summary, leaves, greatest depth, verbatim) by recursion."""
    tokens = lambda t: len(t.encode()) // 4 + 1

    def once(body, own):
        answer = model.generate([f"Summarise in about {own} words:\n{body}"])[0]
        return (body, True) if answer is None or not answer.strip() else (answer, False)

    if tokens(text) <= limit or depth >= deepest:
        summary, verbatim = once(text, target)
        return summary, 1, depth, verbatim
    mid = len(text) // 2
    cut = text.find("\n", mid)
    if cut < 0 or cut > len(text) * 3 // 4:
        cut = text.rfind(" ", 0, mid + 1)
        cut = mid if cut < 0 else cut
    share = int(target * (cut / len(text)))
    a, b = plain_reduce(text[:cut], limit, share, model, depth + 1, deepest), plain_reduce(text[cut:], limit, target - share, model, depth + 1, deepest)
    whole, verbatim = a[0] + "\n\n## Part\n\n" + b[0], a[3] or b[3]
    if tokens(whole) <= limit:
        whole, failed = once(whole, target)
        verbatim |= failed
    return whole, a[1] + b[1], max(a[2], b[2]), verbatim


@pytest.mark.parametrize(("words", "deepest"), [(5, 6), (400, 6), (30, 2)])
def test_reduction_equals_recursion(spark, words, deepest):
    rng = random.Random(words)
    texts = [None, "", "short", "x" * 9000, "word " * 3000, "é" * 700 + "\n" + "b " * 900]
    for n in (100, 700, 2500, 9000):
        texts += ["".join(rng.choice(["alpha ", "beta\n", "gamma, ", "x", "ü"]) for _ in range(n)) for _ in range(3)]
    texts += [texts[7] + " FAIL " + texts[8], "EMPTY", "FAIL"]
    notes = spark.createDataFrame(list(enumerate(texts)), "id long, notes string")
    got = reduction.reduce_long(notes, upper(words), context=reduction.ROOM + 300, target=250, deepest=deepest).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(i, *plain_reduce(t or "", 300, 250, upper(words), deepest=deepest)) for i, t in enumerate(texts)]


def test_reduction_of_nothing(spark):
    assert reduction.reduce_long(spark.createDataFrame([], "id long, notes string"), models.HeadOfPrompt()).count() == 0
    assert (reduction.token_limit(4096), reduction.token_limit(1000)) == (2048, 512)


