import itertools
import random

import numpy as np
import pytest
import xxhash

from tidewindow.llm import simhash as S
from tidewindow.runtime import Scratch


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fp = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    out = {}
    for i in sorted(fp):
        if i not in out:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in out:
                    out[x] = i
                    stack += [y for y in fp if y not in out and (fp[x] ^ fp[y]).bit_count() <= 3]
    return fp, out


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    rows, a = S.anchors(x)
    assert (np.bitwise_count(x[rows] ^ a) <= 2).all() and np.bincount(rows).max() <= 17
    own = [set(a[rows == i].tolist()) for i in range(len(x))]
    for bit in range(32):
        rows2, a2 = S.anchors(x ^ np.uint64(1 << bit))
        assert all(own[i] & set(a2[rows2 == i].tolist()) for i in range(0, len(x), 7))


def test_links_span_the_components():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 2))) for _ in range(40)]))
    seen = {int(f): int(f) for f in fps}
    find = lambda x: x if seen[x] == x else find(seen[x])
    for a, b in S.spanning_links(fps):
        for x, y in zip(a.tolist(), b.tolist()):
            assert (x ^ y).bit_count() <= 3
            seen[find(x)] = find(y)
    for x in fps.tolist():
        for y in fps.tolist():
            if (x ^ y).bit_count() <= 3:
                assert find(x) == find(y)


def test_against_brute_force(spark, frame):
    random.seed(5)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = random.choices(vocab, k=random.choice([1, 2, 4, 60, 300]))
        for _ in range(random.choice([1, 2, 8])):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 2])):
                w[random.randrange(len(w))] = random.choice(vocab)
            rows.append(" ".join(w))
    rows += ["", None, " \n\t", "ONE two", "one TWO", "one\ttwo", "ünïcode ÀB", "x" * 100_000]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(rows)] + [(5, "one two"), (5, "one two"), (None, "one two"), (None, "lone words here now")]
    fp, out = slow_components([(i, t) for i, t in rows])
    got = S.near_duplicates(frame(rows, extra=True), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == fp[r.doc_id] and r.component_id == out[r.doc_id], r
    assert sorted((r.component_id is None) for r in got if r.doc_id is None) == [False, True]


def test_finer_keys_lose_no_pair():
    rng = np.random.default_rng(4)
    for half in (0, 1):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        flips = np.array([sum(1 << int(b) for b in rng.choice(32, 3, replace=False)) for _ in range(400)], dtype=np.uint64)
        y = x ^ (flips << np.uint64(32 if half == 0 else 0))
        anchor, sub = np.full(400, half << 32, dtype=np.int64), np.zeros(400, np.int32)
        a, b = S.sub_keys(anchor, sub, x), S.sub_keys(anchor, sub, y)
        assert all(any(p[i] == q[i] for p, q in zip(a, b)) for i in range(400))
        for p, q in zip(a, b):
            at = np.flatnonzero(p == q)
            c, d = S.sub_keys(anchor[at], p[at], x[at]), S.sub_keys(anchor[at], p[at], y[at])
            assert (np.stack(c) == np.stack(d)).any(axis=0).all() and np.stack(c).min() > 1024


def test_thousands_of_fingerprints_at_one_anchor(spark):
    """One half is the same throughout; the other is compared with all its neighbours by lookup."""
    bits, rng = 25, np.random.default_rng(6)
    high = rng.choice(1 << bits, 12_000, replace=False).astype(np.int64)
    df = spark.createDataFrame([(int(h << 32 | 5),) for h in high], "fp long")
    scratch = Scratch(spark, "t")
    got = {r.node: r.root for r in S.components(S.links(df, scratch), scratch).collect()}
    label = np.full(1 << bits, -1, dtype=np.int32)
    label[high] = np.arange(len(high))
    masks = [sum(1 << b for b in c) for k in (1, 2, 3) for c in itertools.combinations(range(bits), k)]
    pairs = [(at, label[high[at] ^ m]) for m in masks for at in [np.flatnonzero(label[high ^ m] >= 0)]]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    top = np.arange(len(high))
    while True:
        new = top.copy()
        np.minimum.at(new, a, top[b])
        new = new[new]
        if (new == top).all():
            break
        top = new
    mine = np.array([got.get(int(h << 32 | 5), int(h << 32 | 5)) for h in high])
    _, first = np.unique(mine, return_inverse=True)
    assert len(set(zip(first.tolist(), top.tolist()))) == len(set(first.tolist())) == len(set(top.tolist()))


def test_one_of_each_with_ties_and_missing_ids(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "x"), (5, "q r s t u", "y"), (9, "A b c d", "z"), (2, "q r s t u", "w"), (None, "n o p", "1"), (None, "n o p", "2"), (None, None, "3"), (None, "", "4"), (7, "a b c d", "5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    got = S.one_of_each(docs, Scratch(spark, "t"))
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == [(0, ""), (0, "n o p"), (2, "q r s t u"), (5, "a b c d")]


def test_chain_and_hot_group(spark):
    fps = [0]
    for i in range(20):  # a chain: each three bits from the last
        fps.append(fps[-1] ^ (0b111 << (3 * i)))
    edges = spark.createDataFrame([(a, b) for a, b in zip(fps, fps[1:])] + [(10**15, 10**15 + i) for i in range(1, 300)] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges, Scratch(spark, "t")).collect()}
    assert {got[f] for f in fps} == {0} and {got[10**15 + i] for i in range(300)} == {10**15} and len(got) == 321


def test_empty_and_threshold(spark, frame):
    assert S.near_duplicates(frame([]), Scratch(spark, "t")).collect() == []
    with pytest.raises(ValueError):
        S.near_duplicates(frame([]), Scratch(spark, "t"), threshold=4)
    assert [r.doc_id for r in S.one_of_each(frame({1: "a b c", 2: "a b c", 3: "d e f"}), Scratch(spark, "t")).orderBy("doc_id").collect()] == [1, 3]
