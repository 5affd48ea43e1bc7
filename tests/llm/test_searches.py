"""Hard negatives, similarity join and conversation trie against plain versions, with the edge cases of their docstrings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_trie, hard_negatives, overlap_join
from tessera.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, row string"
TEXTS = "doc_id long, text string, n string, row string"
TURNS = "conv_id long, turn long, role string, text string, path string"


# --- hard negatives


def plain_negatives(rows):
    """The contract of op11 by loops over all rows."""
    kept = []
    for at, (vec_id, vector, label, *_) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((at, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for at, anchor, label, z in kept:
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((sum(p * q for p, q in zip(z, y, strict=False)), i, r, lab) for r, i, lab, y in kept if r != at), key=key)
        for p_score, p_id, _, _ in [x for x in scored if x[3] == label][:5]:
            window = [x for x in scored if x[3] != label and 80 * p_score <= 100 * x[0] <= 100 * p_score][:5]
            out += [(anchor, p_id, k, x[1], p_score, x[0]) for k, x in enumerate(window, 1)]
    return sorted(out, key=repr)


def mined(spark, data, **how):
    df = hard_negatives.mine(hard_negatives.relabelled(spark.createDataFrame(data, VECTORS)), F.col("id") % 100 == 0, **how)
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def cloud(seed, n, dims=6, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    return [(i, [float(np.float32(x)) for x in centre + rng.normal(size=dims) * 0.5], int(rng.integers(labels)), "x") for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"rows": 40, "queries": 2}])
def test_hard_negatives_equal_the_loops(spark, how):
    rows = cloud(1, 420)
    rows += [(1000 + i, rows[0][1], i % 2, "copies") for i in range(60)] + [(200, rows[3][1], 1, "a repeated id"), (200, rows[3][1], 1, "a repeated row")]
    assert mined(spark, rows, **how) == plain_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    rows = cloud(2, 30, dims=3, labels=2)
    rows += [(None, [1.0, 1.0, 1.0], 0, "x"), (400, None, 1, "x"), (500, [1.0, None, 2.0], 1, "x"), (600, [1.0, float("nan"), 2.0], 1, "x"), (700, [float("inf"), 1.0, 1.0], 1, "x"), (800, [1.0, 1.0, 1.0], None, "x")]
    rows += [(900, [], 1, "x"), (1100, [2.0], 0, "x"), (-100, [1.0, 2.0, 3.0], 1, None), (1200, [3e4, -3e4, 3e4], 0, "x")]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(100, [], 1, "x"), (101, [], 1, "x"), (102, [], 2, "x")]) == [(100, 101, 1, 102, 0, 0)]


def test_bounds_hold_scores_between_them(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(-300, 300, size=(500, 7))
    df = spark.createDataFrame([(i, 0, [int(x) for x in row], [i], [i]) for i, row in enumerate(z)], "entry long, label long, z array<long>, ids array<long>, rows array<long>")
    cuts, lower, upper = hard_negatives.cell_bounds(df)
    table = hard_negatives.approximate(df, cuts).toArrow()
    shard = hard_negatives.Shard(table, lower, upper)
    for a in rng.integers(-300, 300, size=(20, 7)):
        lb, ub = shard.bounds(a, 0, len(z))
        score = shard.z @ a
        assert (lb <= score).all() and (score <= ub).all()
        assert (ub - lb).mean() < (score.max() - score.min())


# --- similarity join


def plain_sets(rows, size=3):
    out = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return out


def plain_join(rows):
    sets, parent = plain_sets(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, *_) in enumerate(rows):
        least[find(i)].append(doc_id)
    name = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((doc_id, len(sets[i]), name(least[find(i)]) if sets[i] else doc_id) for i, (doc_id, *_) in enumerate(rows)), key=repr)


def joined(spark, rows, **how):
    return sorted((tuple(r) for r in overlap_join.similar_sets(spark.createDataFrame(rows, TEXTS), **how).collect()), key=repr)


def family(rng, n, words, edits):
    """Texts that differ from one in a few words each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    common = " ".join(f"common{i}" for i in range(20))
    out = []
    for words in (4, 9, 12, 40, 60, 100, 160):
        out += family(rng, 14, words, 1 + words // 40)
    out += [f"{common} " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.randint(20, 90))) for _ in range(60)]
    out += family(rng, 40, 120, 3)
    rng.shuffle(out)
    return [(rng.randrange(10**6), t, "x", "x") for t in out] + [(7, out[0], "x", "a copy"), (7, out[0].upper(), "x", "in capitals")]


@pytest.mark.parametrize("cell", [overlap_join.CELL, 1500])
def test_similar_sets_equal_all_pairs(spark, texts, cell):
    got = joined(spark, texts, cell=cell)
    assert got == plain_join(texts)
    assert 10 < sum(a != b for a, _, b in got)


def test_similar_sets_of_odd_rows(spark):
    rows = [(1, None, None, None), (None, "", "x", "x"), (2, " \t\n", "x", "x"), (3, "one", "x", "x"), (None, "One", "x", "x"), (4, "one two", "x", "x"), (5, "two one", "x", "x"), (6, "one\ttwo", "x", None)]
    rows += [(None, "no id here", "x", "x"), (8, "a " * 60_000, "x", "x"), (9, "a " * 50_000, "x", "x"), (10, "z" * 100_000, "x", "x"), (8, "a " * 60_000, "x", "x"), (12, "one two", "x", "x")]
    assert joined(spark, rows) == plain_join(rows)
    assert joined(spark, []) == []


def test_search_finds_what_reaches_the_overlap():
    rng, rule = np.random.default_rng(8), overlap_join.Overlap(9)
    base = rng.integers(0, 1 << 48, 400).astype(np.uint64)
    sets = []
    for n in rng.integers(20, 400, 60):
        mine = base[: int(n)].copy()
        mine[rng.random(len(mine)) < 0.04] = rng.integers(0, 1 << 48, 1).astype(np.uint64)
        sets.append(np.unique(mine))
    cell = overlap_join.Cell(np.arange(60), np.array([len(x) for x in sets]), sets, rule)
    for x in range(60):
        got = set(cell.rows[cell.search(int(cell.sizes[x]), cell.sets[x], 1, np.arange(60) != x)].tolist())
        own = set(cell.sets[x].tolist())
        want = {int(cell.rows[y]) for y in range(60) if y != x and 10 * len(own & set(cell.sets[y].tolist())) >= 9 * len(own | set(cell.sets[y].tolist()))}
        assert got == want


# --- conversation trie


def plain_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {k: [x[1:] for x in sorted(v, key=lambda x: x[0])] for k, v in by.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(math.fmod(conv, 20))
        seq = own.get(base, [])[:h] + own[conv][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(conv)
        ends[tuple(seq)].append(conv)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, who in members.items():
        under = [q for q in members if q[: len(p)] == p]
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        saved = sum((len(members[q]) - 1) * words(q) for q in under)
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], sum(not kids[q] for q in under), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, **how):
    seqs = conversation_trie.with_heads(conversation_trie.sequences(spark.createDataFrame(rows, TURNS)), 20, 4)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in conversation_trie.prefix_trie(seqs, **how).select(*names).collect()), key=repr)


@pytest.mark.parametrize("least_part", [conversation_trie.LEAST_PART, 60])
def test_trie_equals_the_plain_one(spark, least_part):
    rng = random.Random(2)
    rows = []
    for conv in rng.sample(range(-40, 400), 250):
        n = rng.choice([1, 1, 2, 3, 4, 5, 9, 14])
        for turn in range(n):
            rows.append((conv, turn, rng.choice(["user", "bot"]), " ".join(["a word"] * rng.randint(0, 2)), "x"))
    rng.shuffle(rows)
    assert trie(spark, rows, least_part=least_part) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation", "x"), (1, None, None, None, "x"), (1, 0, "user", "hi", "x"), (2, 5, "", "", "x"), (3, 1, "user", "one two\nthree", None), (40, 2, "user", "q" * 70_000, "x"), (41, 0, "user", "w " * 40_000, "x")]
    rows += [(60, 0, "user", "same", "x"), (60, 0, "user", "same", "x"), (61, 0, "user", "same", "x"), (61, 1, "user", "same", "x")]
    assert trie(spark, rows) == plain_trie(rows)
    assert trie(spark, [(None, 0, "user", "x", "x")]) == []


def test_queries_are_registered():
    assert {"op11_hard_negatives", "op12_ngram_jaccard", "op13_conversation_trie"} <= set(QUERIES)
