import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import minhash, neardup_vectors
from folioscope.llm.common import Workspace, connected_components, run_hashes
from tests.llm.conftest import frame


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    n = min(width, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_equals_all_pairs(spark, corpus, width):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, corpus), width).collect()}
    sets = {i: shingles(t, width) for i, t, *_ in corpus}
    g, ids = Groups(sets), sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                g.join(ids[a], ids[b])
    assert got == {i: (len(s), g.find(i), g.find(i) == i) for i, s in sets.items()}
    assert len({g.find(i) for i in ids}) < len(ids) - 40


def test_minhash_on_empty_and_nameless_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    got = minhash.near_duplicates(frame(spark, [(None, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5), (9, "q r s", None, None, None), (None, None, None, None, None)]))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == [("4", 2, "4"), ("4", 2, "4"), ("9", 2, "9"), ("None", 0, "None"), ("None", 2, "4")]


def test_signature_estimates_similarity():
    r = np.random.RandomState(2)
    a, b = minhash._multipliers(600)
    x = r.randint(0, 2**62, 900).astype(np.uint64)
    y = np.concatenate([x[:800], r.randint(0, 2**62, 100).astype(np.uint64)])
    (lx, hx), (ly, hy) = (minhash.signature(np.unique(s), a, b) for s in (x, y))
    both = np.concatenate([lx == ly, hx == hy]).mean()
    assert both == pytest.approx(800 / 1000, abs=0.05)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(5000, 5000), (7, 8)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {n: 0 if n < 1000 else 1000 if n < 2000 else 2000 if n < 5000 else 5000 for e in edges for n in e}
    for few in (1_000_000, 100, 0):  # in one task at once, after some rounds, and by rounds alone
        got = {r.node: r.component for r in connected_components(df, Workspace(spark, "t"), few=few).collect()}
        assert got == want
        assert connected_components(df.where("false"), Workspace(spark, "t"), few=few).count() == 0


def test_components_of_random_links(spark):
    r = random.Random(14)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(450)]
    g = Groups({n for e in edges for n in e})
    for a, b in edges:
        g.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (1000, 20):
        assert {x.node: x.component for x in connected_components(df, Workspace(spark, "t"), few=few).collect()} == {n: g.find(n) for n in g.up}


def test_a_hot_bucket_and_a_giant_group(spark):
    """A third of all rows in one group of slightly different texts, which share most buckets and frequent shingles."""
    r = random.Random(15)
    base = [f"w{k}" for k in range(120)]
    data = [(k, " ".join(w if r.random() > 0.02 else f"q{r.randrange(40)}" for w in base), "en", "s", 0) for k in range(300)]
    data += [(1000 + k, " ".join(f"x{r.randrange(3000)}" for _ in range(60)), "en", "s", 0) for k in range(600)]
    sets = {i: shingles(t, 2) for i, t, *_ in data}
    g, ids = Groups(sets), sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if ids[a] < 1000 and 100 * len(x & y) >= 80 * len(x | y):
                g.join(ids[a], ids[b])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame(spark, data)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: g.find(i) for i in ids} and len({g.find(i) for i in range(300)}) < 100


def test_texts_of_any_length_are_hashed_alike():
    r = random.Random(16)
    words = ["".join(r.choices("abcé中", k=r.choice((1, 3, 9, 400)))) for _ in range(300)] + ["y" * 40_000]
    text = " ".join(words)
    codes = np.frombuffer(text.encode(), np.uint8)
    own = run_hashes(codes, codes != 32)
    assert len(own) == len(words) and len(set(own.tolist())) == len(set(words))
    assert np.array_equal(own, run_hashes(codes, codes != 32, block=1 << 30)) and np.array_equal(own, run_hashes(codes, codes != 32, block=7))
    assert all(run_hashes(np.frombuffer(w.encode(), np.uint8), np.ones(len(w.encode()), bool))[0] == h for w, h in zip(words, own, strict=True))


def vectors():
    r = np.random.RandomState(5)
    data = []
    add = lambda v, label: data.append((len(data), None if v is None else [None if x is None else float(x) for x in v], label))
    for label in range(3):
        base = r.randn(16)
        for share in (0.0, 0.0, 0.05, 0.1, 0.2, 0.3, 0.35, 0.4, 0.5) * 12:
            v = base / np.linalg.norm(base) + share * r.randn(16) / 4
            add(np.float32(v * r.uniform(0.1, 9)), label)
        for _ in range(150):
            add(np.float32(r.randn(16)), label)
    add(np.zeros(16), 0)
    add(None, 0)
    add([], 0)
    add([float("nan")] * 16, 1)
    add([float("inf")] + [1.0] * 15, 1)
    add([None] + [1.0] * 15, 1)
    add(data[0][1], None)
    add(data[0][1][:8], 0)
    add([1e-30] * 16, 2)
    add([1e30] * 16, 2)
    return data


@pytest.mark.parametrize(("block", "kind"), [(neardup_vectors.BLOCK, "float"), (16, "double")])
def test_vectors_equal_all_pairs(spark, monkeypatch, block, kind):
    monkeypatch.setattr(neardup_vectors, "BLOCK", block)
    data = vectors()
    df = frame(spark, data, "vec_id long, embedding array<float>, label int").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(df).collect()}
    links, g, by = defaultdict(int), Groups(range(len(data))), defaultdict(list)
    for i, v, label in data:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            u /= np.abs(u).max()
            by[label, len(v)].append((i, u / np.linalg.norm(u)))
    for own in by.values():
        for a in range(len(own)):
            for b in range(a):
                if own[a][1] @ own[b][1] >= 0.93:
                    links[own[a][0]] += 1
                    links[own[b][0]] += 1
                    g.join(own[a][0], own[b][0])
    assert got == {i: (links[i], g.find(i), g.find(i) == i) for i, _, _ in data} and sum(links.values()) > 1000


def test_vectors_on_empty_and_linkless_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = neardup_vectors.near_duplicates(spark.createDataFrame([(3, None, 1), (None, [1.0, 2.0], 1)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links) for r in got) == [("3", 0), ("None", 0)]


def test_tiles_of_blocks_miss_no_link(monkeypatch):
    monkeypatch.setattr(neardup_vectors, "TILE", 8)
    r = np.random.RandomState(7)
    x = np.concatenate([c + 0.12 * r.randn(20, 12) / 3 for c in r.randn(6, 12)])
    x = x[np.argsort(x[:, 0])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    basis = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    for a, b in ((x, x), (x[:50], x[50:])):
        same = a is b
        got = np.zeros((len(a), len(b)), bool)
        pairs = 0
        for i, j, mask in neardup_vectors.block_links(a, b, same, basis, 0.93):
            got[i : i + mask.shape[0], j : j + mask.shape[1]] |= mask
            if same:
                got[j : j + mask.shape[1], i : i + mask.shape[0]] |= mask.T
            pairs += 1
        want = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T >= 0.93
        if same:
            np.fill_diagonal(want, False)
        assert (got == want).all() and pairs


def test_forest_keeps_components():
    r = random.Random(1)
    for _ in range(30):
        n, m = r.randrange(1, 12), r.randrange(1, 12)
        mask = np.array([[r.random() < 0.15 for _ in range(m)] for _ in range(n)])
        full, some = Groups(range(n + m)), Groups(range(n + m))
        for i, j in zip(*np.nonzero(mask), strict=True):
            full.join(int(i), n + int(j))
        edges = neardup_vectors.forest(mask)
        for i, j in edges:
            assert mask[i, j]
            some.join(i, n + j)
        assert [full.find(x) for x in range(n + m)] == [some.find(x) for x in range(n + m)] and len(edges) < n + m
