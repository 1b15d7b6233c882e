import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewindow.llm import suffixtree as S
from tidewindow.llm.words import blocks
from tidewindow.runtime import Scratch


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def texts(n=300):
    random.seed(11)
    syllables = ["tion", "er", "an", "the", "schö", "ing", "re"]
    make = lambda: "".join(random.choices(syllables, k=random.choice([1, 2, 3]))).title()
    return [None, "", " \n", "x", "Ab c"] + [random.choice([" ", "\n "]).join(make() for _ in range(random.choice([1, 3, 80]))) for _ in range(n)]


def test_symbols_and_histories():
    t = texts(60)
    for k in blocks(pa.array(t), lower=True, size=300):
        s, first = S.symbols(k)
        want = [(" ".join(words(x)) + "\n").encode() for x in t[k.lo : k.hi]]
        assert [s[a:b].tobytes() for a, b in zip(first[:-1], first[1:])] == want
        h = S.histories((s & 63).astype(np.uint8), S.END)
        i = 0
        for w in want:
            for j in range(len(w)):
                back = [w[j - d - 1] & 63 if j > d else S.END for d in range(S.DEPTH)]
                assert h[i] == sum(x << (S.BITS * d) for d, x in enumerate(back))
                i += 1


def test_distributions_sum_to_one_and_depth_pays(spark):
    t = texts()
    df = spark.createDataFrame([(x,) for x in t], "text string")
    tree = S.fit(df)
    assert np.allclose((10.0 ** tree.logp).sum(axis=1), 1, atol=1e-4) and len(tree.contexts) > 20
    kept = set(tree.contexts)
    assert all((d - 1, c & ((1 << S.BITS * (d - 1)) - 1)) in kept for d, c in kept if d)
    h = np.random.default_rng(3).integers(0, 1 << S.BITS * S.DEPTH, 3000, dtype=np.uint64)
    h[:1500] = [c | (int(x) << (S.BITS * d) & (1 << S.BITS * S.DEPTH) - 1) for x, (d, c) in zip(h, (tree.contexts * 1500)[:1500])]
    for x, state in zip(h.tolist(), tree.lookup().states(h).tolist()):
        assert tree.contexts[state] == max((d, x & ((1 << S.BITS * d) - 1)) for d in range(S.DEPTH + 1) if (d, x & ((1 << S.BITS * d) - 1)) in kept)
    inner = 10.0 ** tree.inner
    per_class = Counter()
    for b in range(256):
        per_class[int(tree.classes[b])] += inner[b]
    assert all(abs(v - 1) < 1e-9 for v in per_class.values())


def test_query_against_brute_force(spark, frame):
    rows = [*enumerate(texts()), (None, "no id here"), (7, "twice"), (7, "twice"), (900, "long word " * 30_000)]
    got = S.scored(frame(rows, extra=True), Scratch(spark, "t")).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out(i) for w in [*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), "\n"])
    want = sorted((str(i), out(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), "\n"]), n, round(base(t), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert held and all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_alone_or_together_scores_agree(spark):
    tree = S.fit(spark.createDataFrame([(x,) for x in texts()], "text string"))
    t, table = texts(40), tree.lookup()
    together = np.concatenate([tree.scores(k, table) for k in blocks(pa.array(t), lower=True)])
    alone = np.concatenate([tree.scores(k, table) for x in t for k in blocks(pa.array([x or ""]), lower=True)])
    assert np.allclose(together, alone)


def test_empty(spark, frame):
    assert S.scored(frame([]), Scratch(spark, "t")).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = S.scored(frame({only: "a b"}), Scratch(spark, "t")).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, True) and r.base_score == pytest.approx(0.0)


@pytest.mark.parametrize("held", [7, 1000, 1 << 20])
def test_runs_are_counted_whole(monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    t, classes = texts(60), (np.arange(256) & 63).astype(np.uint8)
    want = Counter()
    for k in blocks(pa.array(t), lower=True):
        s = classes[S.symbols(k)[0]]
        want.update(((S.histories(s, S.END) << np.uint64(S.BITS)) | s).tolist())
    got = Counter()
    for b in S._runs(iter([pa.record_batch([pa.array(t)], ["text"])]), classes, S.END):
        for r, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[r] += n
    assert got == want


def test_every_passing_context_is_kept_in_any_number_of_shards(spark, monkeypatch):
    """Against a plain count of all contexts; the former cut would keep 3 of a depth here."""
    t = texts(120)
    for name in ("CANDIDATES", "STATES"):
        monkeypatch.setattr(S, name, 3, raising=False)
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(x,) for x in t], "text string")
    byte_counts = sum(np.bincount(S.symbols(k)[0], minlength=256) for k in blocks(pa.array(t), lower=True))
    classes, _ = S.classes_of(byte_counts)
    after = {}
    for k in blocks(pa.array(t), lower=True):
        s = classes[S.symbols(k)[0]]
        for h, x in zip(S.histories(s, int(classes[S.END])).tolist(), s.tolist()):
            for d in range(1, S.DEPTH + 1):
                after.setdefault((d, h & ((1 << S.BITS * d) - 1)), Counter())[x] += 1
    n = np.bincount(classes, byte_counts, S.CLASSES)
    p, want = {(0, 0): (n + 0.5) / (n.sum() + 0.5 * S.CLASSES)}, {(0, 0)}
    for d, c in sorted(after):
        m = np.array([after[d, c][x] for x in range(S.CLASSES)])
        above, seen, weight = p.get((d - 1, c & ((1 << S.BITS * (d - 1)) - 1))), m.sum(), S.STRENGTH * (m > 0).sum()
        if seen >= S.LEAST:
            p[d, c] = (m + weight * above) / (seen + weight)
            if sum(x * math.log(x / seen / q) for x, q in zip(m, above) if x) >= S.GAIN:
                want |= {(j, c & ((1 << S.BITS * j) - 1)) for j in range(1, d + 1)}
    whole = S.fit(df)
    assert set(whole.contexts) == want and len(want) > 100
    assert np.allclose(10.0 ** whole.logp, [p[x] for x in whole.contexts], atol=1e-6)
    shard_of, parts = S.shards(*S.learn(df, scratch), scratch, size=40)
    parts = list(parts)
    assert len(parts) > 3 and {x for tree in parts for x in tree.contexts} == want
    for k in blocks(pa.array(t), lower=True):
        x = S.Symbols(k, whole.classes, whole.inner, shard_of)
        for i, tree in enumerate(parts):
            x.add(tree.lookup(), i)
        assert np.allclose(x.score, whole.scores(k, whole.lookup()))
