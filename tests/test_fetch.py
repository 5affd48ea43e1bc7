"""Resumed downloads against a plain client."""

import hashlib
import random

from tessera.operators import fetch


def plain(part, total, expected, answers):
    """One file: ask, append or start over, ask once more."""
    part = part or b""
    total = total or 0
    part = b"" if 0 < total < len(part) else part
    restarts = 0
    if not (total and len(part) == total):
        while True:
            if not answers.get(restarts + 1):
                return "request failed", restarts, part
            status, start, body = answers[restarts + 1]
            if status == 206 and part and start is not None and start != len(part) or status == 416:
                part, restarts = b"", restarts + 1
                if restarts > 1:
                    return "refused twice", 1, part
                continue
            if status not in (200, 206):
                return f"server status {status}", restarts, part
            part = body or b"" if status == 200 else part + (body or b"")
            break
    if total and len(part) != total:
        return "incomplete", restarts, part
    return ("wrong digest", restarts, None) if expected and hashlib.sha256(part).hexdigest() != expected.lower() else ("done", restarts, part)


def test_downloads_equal_the_plain_client(spark):
    rng = random.Random(6)
    parts, answers, want = [], [], {}
    for i in range(400):
        whole = rng.randbytes(rng.choice([1, 10, 40]))
        part = rng.choice([None, b"", whole[:5], whole[:20], whole, whole + b"more"])
        total, good = rng.choice([len(whole), len(whole), None, 0]), hashlib.sha256(whole).hexdigest()
        expected = rng.choice([good, good.upper(), "", None, "0" * 64])
        own = {}
        for attempt in (1, 2):
            status = rng.choice([206, 206, 200, 416, 500, None])
            if status:
                start = rng.choice([len(part or b""), len(part or b""), 3, None])
                own[attempt] = (status, start, rng.choice([whole, whole[len(part or b"") :], whole[len(part or b"") :], whole[:4], None]))
                answers.append((i, attempt, *own[attempt]))
        parts.append((i, part, total, expected))
        want[i] = plain(part, total, expected, own)
    got = fetch.resumed(spark.createDataFrame(parts, "id long, part binary, total long, expected string"), spark.createDataFrame(answers, "id long, attempt int, status int, start long, body binary")).collect()
    for r in got:
        content = None if r.content is None else bytes(r.content)
        assert (r.result, r.restarts, content) == want[r.id], r.id
        assert r.sha256 == (None if content is None else hashlib.sha256(content).hexdigest())
    assert len(got) == 400 and len({w[0] for w in want.values()}) >= 6
