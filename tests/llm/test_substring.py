import hashlib
import random
import re

import pytest

from tidewindow.llm import substring as S
from tidewindow.runtime import Scratch


def slow(rows, window=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone.update(range(p, p + window))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


def corpus():
    random.seed(3)
    vocab = [f"wört{i}" for i in range(300)] + ["A", "a", "b c"]
    make = lambda n: random.choices(vocab, k=n)
    passages = [make(n) for n in (49, 50, 51, 120, 700)]
    rows = []
    for i in range(60):
        w = make(random.choice([0, 1, 20, 49, 50, 200]))
        for _ in range(random.choice([0, 1, 2])):
            at = random.randrange(len(w) + 1)
            w[at:at] = random.choice(passages)
        rows.append((i * 7 % 61, random.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100 + i, rows[5][1]) for i in range(6)] + [(200 + i, "same " * 120) for i in range(3)]
    return rows + [(300, None), (301, ""), (302, " \n "), (303, "x" * 200_000), (None, rows[5][1]), (5, rows[9][1]), (7, rows[3][1]), (7, rows[3][1])]


def test_against_brute_force(spark, frame):
    rows = corpus()
    want = sorted(((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in slow(rows)), key=str)
    got = sorted(map(tuple, S.Repeats(frame(rows, extra=True), Scratch(spark, "t")).digests().collect()), key=str)
    assert got == want and sum(g for _, _, g, _ in want) > 1000


def test_texts(spark, frame):
    rows = corpus()
    out = S.remove_repeats(frame(rows, extra=True), Scratch(spark, "t"))
    assert out.columns == frame(rows, extra=True).columns
    got = sorted(((r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect()), key=str)
    assert got == sorted(((i, k.split(" ") if k else []) for i, _, _, k in slow(rows)), key=str)


def test_levels_thin_out_and_end(spark, frame):
    rng = random.Random(9)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    short, middle, long = make(20), make(40), make(60)
    rows = [(i, " ".join(make(80) + p + make(80))) for i, p in enumerate([short] * 9 + [middle] * 5 + [long] * 3)]
    found = S.Repeats(frame(rows), Scratch(spark, "t"))
    (a, _, docs_a), (b, _, docs_b) = found.survived
    assert (a, b) == (13, 25) and docs_a >= docs_b and 3 <= docs_b <= 8 and docs_a <= 17
    got = {r.doc_id: r.n_removed for r in found.digests().collect()}
    assert got == {i: 60 if i > 14 else 0 for i in range(17)}
    none = S.Repeats(frame([(i, " ".join(make(90))) for i in range(5)]), Scratch(spark, "t"))
    assert none.survived == [(13, 0, 0)] and none.digests().count() == 5


def test_stand_ins_depend_on_the_window_alone():
    rng = random.Random(2)
    rng_tokens = [rng.randrange(1 << 63) for _ in range(130)]
    import numpy as np

    for window in (4, 5, 50):
        whole = np.array(rng_tokens[:40] * 3 + rng_tokens, dtype=np.uint64)
        for i in range(1, len(S.levels(window)) + 1):
            at = S._stand_ins(whole, window, S.levels(window)[:i])
            for p in range(0, len(at), 3):
                assert S._stand_ins(whole[p : p + window], window, S.levels(window)[:i]).tolist() == [at[p] - p]
                assert 0 <= at[p] - p <= window - S.levels(window)[i - 1]


def test_other_widths_and_empty(spark, frame):
    rows = [(1, "a b c d e f"), (2, "x a b c d y"), (3, "a b c")]
    for width in (2, 3, 4, 5):
        got = sorted(map(tuple, S.Repeats(frame(rows), Scratch(spark, "t"), window=width).digests().select("doc_id", "n_removed").collect()))
        assert got == [(i, g) for i, _, g, _ in slow(rows, width)]
    assert S.Repeats(frame([]), Scratch(spark, "t")).digests().collect() == []
    with pytest.raises(ValueError):
        S.Repeats(frame([]), Scratch(spark, "t"), window=1)
