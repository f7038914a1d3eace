"""Pair operators against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from cellweave.llm import simhash, topk
from cellweave.llm.components import components
from cellweave.llm.queries import op6_simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def closure(fps, limit):
    sets = Sets()
    for i, a in enumerate(fps):
        sets.find(i)
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= limit:
                sets.join(i, j)
    return [sets.find(i) for i in range(len(fps))]


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_classes(name, request):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    root = closure(fps, 4)
    ids = {}
    for r, c in zip(rows, root, strict=True):
        if r["doc_id"] is not None:
            ids[c] = min(ids.get(c, r["doc_id"]), r["doc_id"])
    expected = sorted(((r["doc_id"], f, ids.get(c)) for r, f, c in zip(rows, fps, root, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.classes(df).collect()), key=str)
    assert got == expected


def test_hot_copies_join_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_COPIES", 5)
    texts = ["one two three four five"] * 20 + [f"w{k} x{k} y{k} z{k}" for k in range(20)] + [None] * 7
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df).collect()}
    assert len(got) == 47 and {got[k] for k in range(20)} == {0} and {got[k] for k in range(40, 47)} == {40}
    assert all(got[k] <= k for k in got)


def test_query_writes_hex(spark, sf_dir):
    row = op6_simhash(spark, sf_dir).where("doc_id = 3").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id = 3").first()["text"]
    assert row["fingerprint"] == f"{brute_fingerprint(text):016x}"


def near_fps(n=700):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(n // 2)]
    while len(fps) < n:
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return list(dict.fromkeys(fps))


def test_forest_connects_what_brute_force_connects():
    fps = near_fps()
    sets = Sets()
    for i in range(len(fps)):
        sets.find(i)
    edges = simhash.forest(np.asarray(fps, np.uint64), 4)
    for a, b in edges:
        assert bin(fps[a] ^ fps[b]).count("1") <= 4
        sets.join(a, b)
    assert [sets.find(i) for i in range(len(fps))] == closure(fps, 4) and len(edges) < len(fps)


@pytest.mark.parametrize("n", [10, 10**8, 10**12, 10**15])
def test_segments_share_one(n):
    rng = random.Random(3)
    masks = simhash.segment_masks(n)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_hot_buckets_are_dealt_without_loss(spark, monkeypatch):
    fps = near_fps(500)
    monkeypatch.setattr(simhash, "BUCKET", 32)
    monkeypatch.setattr(simhash, "segment_masks", lambda n, limit: [0])  # one bucket for all
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps], "fp long")
    sets = Sets()
    for x in fps:
        sets.find(x)
    for r in simhash.link(df).collect():
        sets.join(r["a"] % (1 << 64), r["b"] % (1 << 64))
    groups = closure(fps, 4)
    smallest = {}
    for x, c in zip(fps, groups, strict=True):
        smallest[c] = min(smallest.get(c, x), x)
    assert [sets.find(x) for x in fps] == [smallest[c] for c in groups]


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in sets if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    five = lambda t: {" ".join(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    return len(five(a) & five(b)) / len(five(a) | five(b))


def test_near_duplicates_are_found_and_others_stay(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, copies = [], []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows.append((1000 + k, " ".join(words)))
        copy = list(words)
        for _ in range(max(1, len(words) // 150)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        copies.append((2000 + k, " ".join(copy)))
    rows += copies + [(3000, rows[0][1]), (3001, None), (3002, ""), (1000, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as root", "1 as k1")
    close = [k for k in range(60) if jaccard(rows[k][1], copies[k][1]) >= 0.8]
    apart = [k for k in range(60) if jaccard(rows[k][1], copies[k][1]) < 0.8]
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(i for i in kept if i < 2000) == list(range(1000, 1060))
    assert 3000 not in kept and sum(i in (3001, 3002) for i in kept) == 1
    assert sum(2000 + k in kept for k in close) <= 0.03 * len(close) and len(close) > 30 and all(2000 + k in kept for k in apart)


def test_nearest_gives_each_row_its_partner():
    fps = np.asarray(near_fps(300), np.uint64)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(int) + 99 * np.eye(len(fps), dtype=int)
    edges = simhash.nearest(fps, 6)
    assert all(apart[i, j] <= 6 and (apart[i, j] == apart[i].min() or apart[i, j] == apart[j].min()) for i, j in edges)
    assert {k for e in edges for k in e} == set(np.flatnonzero(apart.min(1) <= 6).tolist())


def test_survivors_are_all_pairs_within_the_limit():
    fps = np.asarray(near_fps(300), np.uint64)
    got = {(min(i, j), max(i, j)) for i, near, _ in simhash.survivors(fps, 5) for j in near.tolist()}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= 5}


def family(rng, n, words, changes, name):
    base = [f"{name}{k}" for k in range(words)]
    for c in range(n):
        copy = list(base)
        for at in rng.sample(range(words), changes):
            copy[at] = f"{name}x{c}x{at}"
        yield " ".join(copy)


def assert_closure(spark, texts):
    """near_duplicates gives the components of all pairs at 0.8 or more."""
    sets = Sets()
    for i, a in enumerate(texts):
        sets.find(i)
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                sets.join(i, j)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == {i: sets.find(i) for i in range(len(texts))}
    return len(set(got.values()))


def test_families_about_the_threshold_are_linked_whole(spark):
    rng = random.Random(8)
    texts = [t for k in range(4) for t in family(rng, 60, 400, 5, f"f{k}w")]
    assert assert_closure(spark, texts) == 4


def test_pairs_that_share_no_key_are_linked(spark, monkeypatch):
    sketch = simhash.sketch

    def apart(hashes):  # no two texts share a key
        fp, keys = sketch(hashes)
        return fp, np.asarray([int(hashes.sum() % 2**61) + k for k in range(len(keys))], np.int64)

    monkeypatch.setattr(simhash, "sketch", apart)
    rng = random.Random(9)
    texts = [t for k in range(30) for t in family(rng, 2, 100 + 8 * k, 1 + k % 3, f"f{k}w")]
    assert 30 <= assert_closure(spark, texts) < 60


def test_links_do_not_depend_on_the_likely_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIKELY", -1)  # no pair is likely
    rng = random.Random(4)
    assert assert_closure(spark, [t for k in range(5) for t in family(rng, 20, 200, 2, f"f{k}w")]) >= 5


def test_pairs_near_by_bits_but_under_the_threshold_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIKELY", 30)  # many pairs under the threshold are likely
    rng = random.Random(12)
    texts = [t for k in range(40) for t in family(rng, 2, 60, 1, f"f{k}w")]
    assert 40 < assert_closure(spark, texts) <= 80


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    often = np.arange(0, 400, 3, dtype=np.uint64)
    counts = rng.integers(3, 9, len(often))
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = rng.choice(1000, n, replace=False)
        b = a[: int(np.ceil(0.8 * n))]
        firsts = [set(simhash.prefix(np.unique(x).astype(np.uint64), 0.8, often, counts).tolist()) for x in (a, b)]
        assert firsts[0] & firsts[1]


def test_partners_leave_out_only_what_cannot_be_similar():
    rng = np.random.default_rng(9)
    sets = []
    for k in range(60):
        own = rng.integers(0, 2**63, int(rng.choice([5, 40, 60, 70, 300, 2000])), dtype=np.uint64)
        sets += [np.unique(own), np.unique(np.concatenate([own[: int(len(own) * rng.uniform(0.75, 1))], rng.integers(0, 2**63, int(len(own) * rng.uniform(0, 0.2)), dtype=np.uint64)]))]
    size, tree = np.asarray([len(x) for x in sets]), np.arange(len(sets))
    got = set(simhash.partners(size, tree, np.arange(len(sets))[:, None], [simhash.parity(x) for x in sets], 0.8))
    held = [set(x.tolist()) for x in sets]
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j])}
    assert len(similar) > 10 and similar <= got and len(got) < 4 * len(similar)
    assert not simhash.partners(size, np.zeros(len(sets)), np.arange(len(sets))[:, None], [simhash.parity(x) for x in sets], 0.8)


def test_drop_near_duplicates_edges(edge, empty):
    kept = simhash.drop_near_duplicates(edge)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edge.columns and ids.count(5) == 1 and ids.count(4) + ids.count(8) == 1 and None in ids
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.classes(empty).count() == 0


def brute_top(rows, k=10):
    sound = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in sound), default=0)
    ints = [(i, [int(np.floor(1024 * float(x))) for x in v] + [0] * (width - len(v))) for i, v in sound]
    out = []
    for a, (i, q) in enumerate(ints):
        if i % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(ints) if a != b)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(topk, "STRIP", 100)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "SEEDS", 50)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=16) * (1 + k % 7)]) for k in range(1000)]
    rows += [(2000 + k, rows[3][1]) for k in range(30)] + [(200, rows[5][1]), (None, rows[5][1]), (3000, None), (3100, [1.0, None]), (3200, [float("nan")] * 16), (3300, [float("inf")] + [0.0] * 15), (3400, [0.5, 0.25]), (3500, []), (3600, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as strip", "2.0 as norm", "3 as uid")
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(rows)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 1")).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [1e3, 2e6])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["vec_id"], r["score"] > 0) for r in sorted(got, key=lambda r: r["rank"])][0] == (1, True) and len(got) == 3
