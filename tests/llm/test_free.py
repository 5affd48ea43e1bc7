"""The other operators against plain versions, with the edge cases of their docstrings."""

import datetime
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import components, decontaminate, line_dedup, nbsvm, near_dedup, ngram_trie, packing, pii, quality_rules, token_counts
from tessera.llm.bpe import Encoder
from tessera.llm.queries import QUERIES, TOKENIZER
from tessera.llm.staging import new_path

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score string"
EDGE = [(1, None, None, None, "x"), (2, "", "en", "s", None), (3, "The cat sat on the mat", "en", "s", "x"), (3, "The cat sat on the mat", "en", "s", "x"), (None, "no id at all", "en", "s", "x"), (4, "z" * 70000 + " end", "en", "s", "x"), (5, "word " * 20000, "en", "t", "x")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def hf():
    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    return own


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


# --- tokens, packing, counts


def test_ids_equal_the_tokenizer(hf):
    random.seed(4)
    texts = ["".join(random.choice(" \n\t'sabré ’.19 　ll😀") for _ in range(random.randint(0, 40))) for _ in range(500)] + [None, "", "don't 's\n\n x  \n y\n", "a <|endoftext|> b"]
    own, at = Encoder(TOKENIZER, most_words=300), 0
    for row, end, count, ids in own.counts_and_ids(pa.array(texts)):
        assert row == at
        at, bounds = end, np.concatenate([[0], np.cumsum(count)])
        for i in range(row, end):
            assert ids[bounds[i - row] : bounds[i - row + 1]].tolist() == hf.encode(texts[i] or "", add_special_tokens=False).ids
    assert at == len(texts)


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_packing(which, request, hf):
    docs = request.getfixturevalue(which)
    got = packing.pack(docs, TOKENIZER, rows_a_bucket=7).collect()
    want = Counter()
    total = 0
    for r in docs.collect():
        ids = [*hf.encode(r.text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = -(-len(ids) // 2048)
        at = 0
        for p in range(pieces):
            size = len(ids) - (pieces - 1) * 2048 if p == 0 else 2048
            want[r.doc_id, p, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at += size
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1 + len(bins) // 50


def test_fullest_combination_is_the_best_subset():
    random.seed(1)
    for _ in range(60):
        counts = np.zeros(40, np.int64)
        for _ in range(random.randint(1, 7)):
            counts[random.randint(1, 20)] += 1
        room = random.randint(1, 39)
        items = [n for n in range(40) for _ in range(counts[n])]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        parts = packing.fullest([n for n in range(39, 0, -1) if counts[n]], counts, room)
        assert sum(n * k for n, k in parts) == best and all(k <= counts[n] for n, k in parts)


def test_plan_places_every_piece_once():
    random.seed(2)
    counts = np.zeros(101, np.int64)
    for _ in range(3000):
        counts[min(100, 1 + int(random.expovariate(0.04)))] += 1
    slots = packing.plan(counts, 100)
    assert slots["bins"] <= 1.02 * -(-int((counts * np.arange(101)).sum()) // 100) + 1
    assert packing.plan(np.zeros(101, np.int64), 100)["bins"] == 0


def test_packing_nothing(edge):
    assert packing.pack(edge.limit(0), TOKENIZER).count() == 0


def test_rollups_follow_inserts_revisions_and_deletes(spark, edge, hf):
    tokenizers = {"v1": TOKENIZER}
    store = token_counts.Rollup(spark, new_path(spark, "rollup"))
    assert store.totals().count() == 0
    first = token_counts.count_tokens(edge, tokenizers).cache()
    assert store.commit("b1", token_counts.deltas(None, first)) and not store.commit("b1", token_counts.deltas(None, first))
    changed = edge.where("doc_id IS NULL OR doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 2, "now text").otherwise(F.col("text")))
    assert store.commit("b2", token_counts.deltas(first, token_counts.count_tokens(changed, tokenizers)))
    want = defaultdict(lambda: [0, 0])
    for r in changed.collect():
        want[r.source, r.lang][0] += 1
        want[r.source, r.lang][1] += len(hf.encode(r.text or "", add_special_tokens=False).ids)
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in store.totals().collect()} == dict(want)
    assert store.commit("b3", token_counts.deltas(token_counts.count_tokens(changed, tokenizers), None)) and store.totals().count() == 0
    assert store.batches() == ["b1", "b2", "b3"]
    store.compact()
    assert store.batches() == ["b1", "b2", "b3"] and store.totals().count() == 0 and not store.commit("b2", token_counts.deltas(None, first))
    assert store.commit("b4", token_counts.deltas(None, first))
    before = sorted(map(tuple, store.totals().collect()), key=repr)
    store.compact()
    store.compact()
    assert before and sorted(map(tuple, store.totals().collect()), key=repr) == before and store.batches() == ["b1", "b2", "b3", "b4"]
    assert not store.commit("b4", token_counts.deltas(None, first))


def test_token_counts_of_the_query(spark, documents, hf):
    want = defaultdict(lambda: [0, 0, 0])
    for r in documents.collect():
        own = want[r.source, r.lang, "byte_bpe_50k"]
        own[0] += 1
        own[1] += len(r.text or "")
        own[2] += len(hf.encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_chars, r.n_tokens] for r in QUERIES["op10_token_counts"](spark, FOLDER).collect()}
    assert got == dict(want)


# --- decontamination


def plain_hits(text, windows):
    w, cover, items = words(text), set(), set()
    for size in {len(x) for x in windows}:
        for a in range(len(w) - size + 1):
            if found := windows.get(tuple(w[a : a + size])):
                cover.update(range(a, a + size))
                items |= found
    return len(w), len(cover), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(cover) and 20 * len(cover) >= len(w)


@pytest.mark.parametrize("block", [10, 4_000_000])
def test_decontamination(spark, documents, block, monkeypatch):
    monkeypatch.setattr(decontaminate.write_blocks, "__defaults__", (13, block))
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(900, "mat"), (901, "On the"), (902, None), (903, " . "), (None, "cat sat"), (904, "mat")], "item_id long, text string"))
    windows = defaultdict(set)
    for r in bench.collect():
        w = words(r.text)
        for a in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[a : a + min(13, len(w))])].add("" if r.item_id is None else str(r.item_id))
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in EDGE], "doc_id long, text string"))
    want = Counter((r.doc_id, *plain_hits(r.text, windows)) for r in docs.collect())
    out = decontaminate.judge(docs, bench)
    assert Counter(tuple(r)[:6] for r in out.collect()) == want
    kept = decontaminate.without_tests(docs, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in want.elements() if not k[5])


def test_decontamination_by_nothing(spark, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.judge(edge, none).collect()} == {0}
    assert decontaminate.judge(edge.limit(0), none).count() == 0


def plain_longest(text, tests):
    """Length and place of the longest run of words of a text that stands in a test, of a window or a whole shorter test at least."""
    w, best = words(text), (0, -1)
    for test in map(words, tests):
        for p in range(len(w)):
            for q in range(len(test)):
                n = 0
                while p + n < len(w) and q + n < len(test) and w[p + n] == test[q + n]:
                    n += 1
                if n and n >= min(13, len(test)):
                    best = max(best, (n, -p), key=lambda x: (x[0], x[1])) if best[0] else (n, -p)
    return best[0], -best[1] if best[0] else -1


@pytest.mark.parametrize("pairs", [3, 1 << 21])
def test_longest_match(spark, monkeypatch, pairs):
    monkeypatch.setattr(decontaminate._uses, "__defaults__", (pairs,))
    run = lambda a, b, h="w": " ".join(f"{h}{i}" for i in range(a, b))
    tests = [run(0, 30), "x " + run(3, 16) + " y", run(4, 17) + " z", "a b", "the " * 20, run(0, 13, "v") + " " + run(5, 25)]
    texts = ["a b " + run(5, 25) + " c", run(3, 17), "q " + run(3, 16) + " " + run(4, 17), "the " * 40, "b a b", run(5, 25) + " " + run(5, 25), run(0, 12), "", "the " * 12]
    # windows of two tests side by side are no match of both
    texts += [run(1, 14) + " q " + run(4, 17) + " z", run(3, 16) + " " + run(0, 13, "v") + " " + run(5, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(tests)), "item_id long, text string")
    got = {r.doc_id: (r.longest, r.longest_at) for r in decontaminate.judge(docs, bench).collect()}
    assert got == {i: plain_longest(t, tests) for i, t in enumerate(texts)}
    two = spark.createDataFrame([(1, run(0, 13)), (2, run(1, 14))], "item_id long, text string")
    assert decontaminate.judge(spark.createDataFrame([(1, run(0, 14))], "doc_id long, text string"), two).first().longest == 13


def test_decontamination_of_rows_that_share_an_id(spark):
    test = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, test, "a", 1), (1, "clean text", "b", 2), (None, "more", "c", 3), (None, test, "d", 4)], "doc_id long, text string, _id string, row int")
    kept = decontaminate.without_tests(docs, spark.createDataFrame([(1, test)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r._id for r in kept.collect()) == ["b", "c"]


# --- near duplicates


def plain_classes(rows, damping=0.2):
    """For each of rows (doc_id, text): class id, and whether it stands for the class."""
    order = sorted((k for k, (_, t) in enumerate(rows) if words(t)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    rep, shingle = {}, {}
    for k in order:
        if rows[k][1] not in rep:
            rep[rows[k][1]], w = k, words(rows[k][1])
            n = min(5, len(w))
            shingle[k] = Counter(tuple(w[a : a + n]) for a in range(len(w) - n + 1))
    n, df = len(shingle), Counter(s for c in shingle.values() for s in c)
    idf = {s: 1 + damping * math.log(n / d) / math.log(n + 1) for s, d in df.items()}
    total = {i: sum(v * idf[s] for s, v in c.items()) for i, c in shingle.items()}
    owners = defaultdict(list)
    for i, c in shingle.items():
        for s in c:
            owners[s].append(i)
    place = {k: at for at, k in enumerate(order)}
    head = {i: i for i in shingle}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in {p for own in owners.values() for p in itertools.combinations(own, 2)}:
        common = sum(min(v, shingle[b][s]) * idf[s] for s, v in shingle[a].items() if s in shingle[b])
        if common / (total[a] + total[b] - common) >= 0.8:
            x, y = sorted((find(a), find(b)), key=place.get)
            head[y] = x
    return [(rows[h][0], h == k) if words(t) and (h := find(rep[t])) is not None else (i, True) for k, (i, t) in enumerate(rows)]


def test_near_copies(spark, documents):
    random.seed(9)
    base = [f"t{random.randint(0, 10**6)}" for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(r[0], r[1]) for r in EDGE]
    for k in range(25):
        own = list(base)
        own[random.randrange(120)] = f"edit{k}"
        rows.append((5000 + k, " ".join(own)))
    rows += [(6000, "one two"), (6001, "one two"), (6002, "One  two"), (6003, "three")]
    # one id with two texts must not tie their neighbours; rows without an id have classes too
    rows += [(7001, "a b c d e f g"), (7005, "a b c d e f g"), (7005, "h i j k l m n"), (7009, "h i j k l m n"), (None, "h i j k l m n"), (None, "p q r s t u v"), (None, "p q r s t u v")]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, _id int, row string")
    want = plain_classes(rows)
    assert Counter(tuple(r) for r in near_dedup.classes(docs).collect()) == Counter((i, c) for (i, _), (c, _) in zip(rows, want, strict=True))
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r._id for r in kept.collect()) == [k for k, (_, stands) in enumerate(want) if stands]


def test_signatures_agree_as_often_as_vectors_are_similar():
    random_ = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        key = np.sort(random_.integers(0, 1 << 50, 400).astype(np.uint64))
        weight = random_.uniform(0.5, 3, 400).astype(np.float32)
        other = weight * np.where(random_.random(400) < share, 1, random_.uniform(0.3, 2, 400)).astype(np.float32)
        similar = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
        agree = (near_dedup.signature(key, weight, 2000) == near_dedup.signature(key, other, 2000)).mean()
        assert abs(agree - similar) < 0.05


def test_squeeze_round_trip():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 999).astype(np.uint64))
    assert np.array_equal(near_dedup.unsqueeze(near_dedup.squeeze(a)), a) and len(near_dedup.unsqueeze(near_dedup.squeeze(a[:0]))) == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# --- language model


def plain_scores(rows, held):
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of the model with all bigrams and trigrams."""
    text = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["</s>"], h) for (i, t), h in zip(rows, held, strict=True)]
    one, two, three = Counter(), Counter(), Counter()
    for _, w, h in text:
        if not h:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(one.values()), len(one)
    after1, after2 = Counter(a for a, _ in two), Counter((a, b) for a, b, _ in three)
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda a, w: (max(two[a, w] - 0.75, 0) + 0.75 * after1[a] * p1(w)) / one[a] if one[a] else p1(w)
    p3 = lambda a, b, w: (max(three[a, b, w] - 0.75, 0) + 0.75 * after2[a, b] * p2(b, w)) / two[a, b] if two[a, b] else p2(b, w)
    for i, w, _ in text:
        yield i, len(w), sum(x in one for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p1(x) if k == 0 else p2(w[0], x) if k == 1 else p3(w[k - 2], w[k - 1], x)) for k, x in enumerate(w))


@pytest.mark.parametrize("which, shard_tokens", [("edge", 3_000_000), ("edge", 1000), ("documents", 3_000_000), ("documents", 7000)])
def test_language_model(which, shard_tokens, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    want = sorted(plain_scores(rows, held), key=lambda r: repr(r[:4]))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_trie.score_documents(docs, shard_tokens).collect()), key=lambda r: repr(r[:4]))
    for w, g in zip(want, got, strict=True):
        assert w[:4] == g[:4]
        assert abs(w[4] - g[4]) <= 1e-6 * abs(w[4]) and abs(w[5] - g[5]) <= 2e-4 * w[1]


def test_ngrams_of_many_words():
    random_ = np.random.default_rng(6)
    for n_local in (40, 1 << 22):
        local = random_.integers(0, 40, 3000) * (n_local // 40)
        ends = np.array([0, 1, 3, 700, 3000])
        want2, want3 = Counter(), Counter()
        for a, b in itertools.pairwise(ends.tolist()):
            own = local[a:b].tolist()
            want2.update(zip(own, own[1:], strict=False))
            want3.update(zip(own, own[1:], own[2:], strict=False))
        two, three = ngram_trie._ngrams(local, ends, n_local)
        for got, want in ((two, want2), (three, want3)):
            rows = list(zip(*(x.tolist() for x in got), strict=True))
            assert [r[:-1] for r in rows] == sorted(want) and {r[:-1]: r[-1] for r in rows} == want


def test_a_lost_file_of_the_model_is_an_error(edge):
    model = ngram_trie.Trie.build(edge)
    assert model.score(edge).count() == len(EDGE)
    os.remove(f"{model.folder}/order3-0")
    with pytest.raises(Exception, match="order3-0"):
        model.score(edge).collect()
    model.drop(edge)
    assert not os.path.exists(model.folder)


def test_model_without_texts(edge):
    out = ngram_trie.Trie.build(edge.limit(0)).score(edge).collect()
    assert len(out) == len(EDGE) and all(r.score == r.base_score and r.n_known == 0 for r in out)
    assert ngram_trie.score_documents(edge.limit(0)).count() == 0


def test_elias_fano_finds_what_it_holds():
    random_ = np.random.default_rng(8)
    for universe, n in ((1 << 62, 5000), (1000, 900), (1 << 40, 1), (7, 7), (1 << 20, 70000)):
        a = np.unique(random_.integers(0, universe, n).astype(np.uint64))
        ef = ngram_trie.EliasFano(ngram_trie.ef_arrays(a, universe))
        assert np.array_equal(ef.find(a), np.arange(len(a)))
        other = np.setdiff1d(random_.integers(0, universe, 500).astype(np.uint64), a)
        assert (ef.find(other) == -1).all()


# --- classifier


def test_classifier_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = nbsvm.score_quality(docs, labels)
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    pairs = [(a.score, b.score) for a in held for b in held if a.quality > b.quality]
    assert sum(x > y for x, y in pairs) / len(pairs) > 0.97


def test_hinge_loss_is_minimised():
    """The primal value of the fit meets that of projected gradient ascent on the dual, and the bounds of the dual hold."""
    random_ = np.random.default_rng(11)
    rows = [np.sort(random_.choice(30, random_.integers(2, 9), replace=False)).astype(np.int32) for _ in range(80)]
    y = np.where(random_.random(80) < 0.3, 1.0, -1.0)
    ratio = random_.normal(size=30)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / math.sqrt(len(r))
    x[:, 30] = 1
    cost = np.where(y > 0, 80 / (2 * (y > 0).sum()), 80 / (2 * (y < 0).sum()))

    def primal(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(80), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(60000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, cost)
    best = alpha.sum() - alpha @ gram @ alpha / 2
    scaled, bias = nbsvm._hinge(rows, y, ratio, 1.0, 2000, 1, 1e-7)
    got = primal(np.append(scaled / ratio, bias))
    assert abs(got - best) <= 1e-3 * best


def test_classifier_takes_what_its_bound_allows(spark, edge):
    labels = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (4, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in nbsvm.score_quality(edge, labels, max_bytes=0).collect()} == {0.5}
    assert len({r.score for r in nbsvm.score_quality(edge, labels).collect()}) > 1


def test_classifier_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in nbsvm.score_quality(edge, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert nbsvm.score_quality(edge, one).count() == len(EDGE)


# --- pseudonyms


def test_feistel_permutes_every_domain():
    for size in (1, 2, 7, 100, 1000):
        own = pii.Feistel(b"k", "x", size)
        assert sorted(own.apply(x) for x in range(size)) == list(range(size))
        assert all(own.invert(own.apply(x)) == x for x in range(size))
    odd = pii.Feistel(b"k", "x", 100)
    assert sorted(odd.apply(x, lambda v: v % 2 == 1) for x in range(1, 100, 2)) == list(range(1, 100, 2))


VALUES = {
    "card": ["4111 1111 1111 1111", "4539578763621486", "378282246310005"], "ssn": ["123-45-6789"], "phone": ["+1 (408) 555-7800", "408-555-1234"], "ipv4": ["87.229.221.26", "233.1.2.3"],
    "date": ["2024-02-29", "31.12.1999", "1/2/2003", "25/12/2020", "12/25/2020"], "email": ["Ann.Lee42@mail7.example.com"], "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"],
}


def test_pseudonyms_keep_format_and_can_be_inverted():
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    for kind, own in VALUES.items():
        for value in own:
            new = there.replace(kind, value)
            assert new != value and back.replace(kind, new) == value
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", value) or kind in ("ipv4", "email", "iban")
            text, found = there.text(f"x {value}, y")
            assert found == [(kind, 2, 2 + len(value))] and text == f"x {new}, y"
    assert pii.luhn(re.sub(r"\D", "", there.replace("card", "4111 1111 1111 1111")))


def test_invalid_values_stay():
    own = pii.Pseudonyms(b"key")
    for text in ("4111111111111112", "2024-02-30", "999.1.1.1", "666-12-3456", "DE89 3704 0044 0532 0130 01", "v1.2.3", "a@b", "0000000000000000"):
        assert own.text(f"x {text} y")[0] == f"x {text} y"


def test_pseudonymised_documents(spark, edge):
    rows = [(10 + i, f"é call {v} now", "en", "s", "x") for i, v in enumerate(x for own in VALUES.values() for x in own)]
    docs = edge.union(spark.createDataFrame(rows + [(99, rows[0][1], "en", "s", "x")], DOCS))
    out = pii.pseudonymise(docs, b"key").collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == docs.count() and by[1].text is None and by[2].text == "" and by[99].text == by[10].text
    for i, text, *_ in rows:
        assert by[i].text != text and by[i].spans and sum(by[i][f"n_{k}"] for k in pii.KINDS) == 1
    assert pii.pseudonymise(edge.limit(0), b"key").count() == 0


def test_values_with_more_groups_behind():
    own = pii.Pseudonyms(b"key")
    for kind, value, head, tail in [
        ("card", "4111 1111 1111 1111", "", " 123"), ("card", "4111111111111111", "", " 12/25"), ("card", "4111-1111-1111-1111", "", "-123"), ("card", "4111 1111 1111 1111", "1234 ", ""),
        ("iban", "ES91 2100 0418 4502 0005 1332", "", " EUR"), ("iban", "AT61 1904 3002 3457 3201", "", " BIC"), ("iban", "AT61 1904 3002 3457 3201", "AB12 3456 7890 ", " BIC"),
    ]:
        new = own.replace(kind, value)
        assert own.text(f"x {head}{value}{tail} y") == (f"x {head}{new}{tail} y", [(kind, 2 + len(head), 2 + len(head) + len(value))])
    assert own.text("x " + "1 " * 20000 + "y")[0].startswith("x ")


def test_addresses_in_texts_without_digits(spark):
    rows = [(1, "mail joe@example.com", "en", "s", "x"), (2, "7 mails to joe@example.com", "en", "s", "x"), (3, "no name at all", "en", "s", "x"), (4, None, "en", "s", "x")]
    by = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, DOCS), b"key").collect()}
    new = pii.Pseudonyms(b"key").replace("email", "joe@example.com")
    assert new != "joe@example.com" and by[1].text == f"mail {new}" and by[2].text == f"7 mails to {new}"
    assert [by[i].n_email for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and by[1].spans == "email:5:20" and by[3].text == rows[2][1] and by[4].text is None


def plain_finds(text):
    """Valid values from left to right by definitions of their own: all kinds and lengths at a place, longest first, no search ahead."""
    own, out, i = pii.Pseudonyms(b"key"), [], 0
    digits = lambda t: re.sub(r"\D", "", t)
    while i < len(text):
        best = None
        for kind, form in pii.FORMS.items():
            m = re.compile(form).match(text, i)
            if not m:
                continue
            ends = [m.end()]
            if kind == "card":
                ends += [e for e in range(m.end() - 1, i, -1) if text[e] in " -" and len(digits(text[i:e])) >= 13]
            if kind == "iban":
                cut = [e for e in range(m.end() - 1, i, -1) if text[e] == " "]
                size = pii.IBAN_LENGTHS.get(m[0][:2])
                own_size = [e for e in [*cut, m.end()] if len(text[i:e].replace(" ", "")) == size]
                ends = [*ends, *cut] if size is None else [*[e for e in own_size if e != m.end()], m.end()]
            found = next((e for e in ends if own.replace(kind, text[i:e]) is not None), None)
            if found is not None:
                best = (kind, i, found)
                break
            if kind == "iban" and size is not None and own_size and not any(re.compile(pii.FORMS[k]).match(text, i) for k in ("email",)):
                # an IBAN with wrong check digits is passed over whole
                best = (None, i, own_size[0])
                break
        if best is None:
            i += 1
            continue
        if best[0]:
            out.append(best)
        i = best[2]
    return out


def test_finds_equal_a_plain_scanner(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    random_ = random.Random(12)
    values = [v for own in VALUES.values() for v in own] + ["AB12", "4111 1111 1111 1112", "GB29", "DE89 3704 0044 0532 0130 01", "2024-02-30", "12/25", "123", "EUR", "joe@x.org", "12", "+1"]
    texts += [random_.choice(["", "x", "Ref. "]) + "".join(random_.choice(values) + random_.choice([" ", " ", " ", "-", "", ", ", "\n"]) for _ in range(random_.randint(1, 6))) for _ in range(3000)]
    own = pii.Pseudonyms(b"key")
    for t in texts:
        if t and len(t) < 20000:
            assert own.text(t)[1] == plain_finds(t), t
    assert own.text("ref AB12 4111 1111 1111 1111 end")[1] == [("card", 9, 28)]


# --- pipeline


def test_pipeline_equals_its_plain_version(spark, hf):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_outliers(docs).where("kept").collect()}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    clean = {r.doc_id: r.text for r in line_dedup.without_repeats(docs.where(F.col("doc_id").isin(sorted(kept)))).collect()}
    clean = dict(sorted(clean.items()))
    clean = {i: t for (i, t), (_, stands) in zip(clean.items(), plain_classes(list(clean.items())), strict=True) if stands}
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        for a in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[a : a + min(13, len(w))])].add(str(r.item_id))
    clean = {i: t for i, t in clean.items() if not plain_hits(t, windows)[4]}
    want = {i: len(hf.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id] += r.length
    assert got == want and len(text) > len(clean) > 50


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_query_names():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert datetime and public_tokenizers
