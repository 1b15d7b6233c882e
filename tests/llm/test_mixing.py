import math
import random
from fractions import Fraction

import pytest

from tidewindow.llm import mixing as M
from tidewindow.runtime import Scratch


def plain(blocks, weights):
    """Earliest deadline first, all sources looked at in every slot, in exact fractions."""
    left, done, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        w, nth, t = {s: Fraction(weights[s]) / total for s in left}, dict.fromkeys(left, 0), 0
        while True:
            ready = [s for s in left if math.floor(nth[s] / w[s]) <= t]
            if any(not left[s] for s in ready):
                break
            s = min(ready, key=lambda s: (math.ceil((nth[s] + 1) / w[s]), w[s], s))
            out.append((s, done[s]))
            done[s], nth[s], left[s], t = done[s] + 1, nth[s] + 1, left[s] - 1, t + 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_whole_order_against_a_plain_scan():
    rng = random.Random(1)
    for _ in range(40):
        k = rng.randrange(1, 10)
        weights = {f"s{i}": rng.random() ** 3 + 1e-4 for i in range(k)}
        blocks = {s: rng.choice([0, 1, 5, 60]) for s in weights}
        assert list(M.timetable(blocks, weights)) == plain(blocks, weights)


def test_blocks_grow_with_the_corpus():
    assert M.block_size(0) == M.block_size(M.SLOTS * 32) == 32 and M.block_size(M.SLOTS * 32 + 1) == 64
    assert 10**12 / M.block_size(10**12) <= M.SLOTS


def test_every_row_once_and_on_weight(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", "a", i) for i in range(3000)] + [(7, None, "b", 0), (7, None, "b", 0), (None, "hot", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, block string, slot long")
    weights = {"hot": 0.1, "s1": 0.3, "s2": 0.3, "s3": 0.1, "s4": 0.1, "s0": 0.09, "": 0.01}
    got = M.placed(docs, Scratch(spark, "t"), weights, block=4).collect()
    assert len(got) == len(rows) and len({r.place for r in got}) == len(rows)
    assert sorted((r.doc_id or 0, r.source) for r in got) == sorted((a or 0, b or "") for a, b, _, _ in rows)
    per_block = {}
    for r in got:
        per_block.setdefault((r.source, r.block), []).append(r)
    assert all(len({r.slot for r in v}) == 1 and len(v) <= 4 for v in per_block.values())
    assert sum(weights.values()) == pytest.approx(1)
    order = [r.source for r in sorted({(r.slot, r.source): r for r in got}.values(), key=lambda r: r.slot)]
    for t in range(1, 65):  # no source but '' has run out
        assert all(abs(order[:t].count(s) - w * t) < 1 for s, w in weights.items() if s)
    again = M.placed(docs.repartition(7), Scratch(spark, "t"), weights, block=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_order_of_documents_and_empty(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", f"text {i}", 6) for i in range(200)] + [(None, None, None, None), (3, "s1", "text 3", 6)], "doc_id long, source string, text string, place long")
    out = M.in_mixed_order(docs, Scratch(spark, "t"), block=8)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    place = {(r.doc_id, r.source): r.place for r in M.placed(docs.select("doc_id", "source").distinct(), Scratch(spark, "t"), block=8).collect()}
    seen = [place[r.doc_id, r.source or ""] for r in out.collect()]
    assert seen == sorted(seen)
    assert M.placed(docs.limit(0), Scratch(spark, "t")).collect() == [] and M.in_mixed_order(docs.limit(0), Scratch(spark, "t")).collect() == []
    with pytest.raises(ValueError):
        M.placed(docs, Scratch(spark, "t"), {"s0": 0.0})


def test_within_one_block_of_the_weights_at_every_prefix():
    cases = [{"hot": 0.9} | {f"s{i}": 0.1 / 200 for i in range(200)}, {"hot": 20000**0.7} | {f"s{i}": (2000.0 + i) ** 0.7 for i in range(19)}, {"half": 0.5, "tiny": 1e-5} | {f"s{i}": 0.49999 / 998 for i in range(998)}]
    for w in cases:
        total, slots = sum(w.values()), 100_000 if len(w) < 300 else 20_000
        seen, last = dict.fromkeys(w, 0), dict.fromkeys(w, 0)
        for t, (s, b) in zip(range(1, slots + 1), M.timetable(dict.fromkeys(w, slots), w)):
            # a source is furthest behind just before a block of its own, and furthest ahead just after
            assert b == seen[s] and seen[s] > w[s] / total * (t - 1) - 1 - 1e-9 and seen[s] < w[s] / total * t + 1e-9
            seen[s], last[s] = seen[s] + 1, t
        assert all(abs(seen[s] - w[s] / total * slots) < 1 for s in w)


def test_places_follow_the_weights_exactly(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id < 4000 THEN 'half' ELSE concat('s', id % 40) END AS source")
    weights = {"half": 0.5} | {f"s{i}": 0.5 / 40 for i in range(40)}
    got = M.placed(docs, Scratch(spark, "t"), weights, block=2).collect()
    order = [r.source for r in sorted(got, key=lambda r: r.place)]
    assert len(order) == 6000 and {r.slot for r in got} == set(range(3000))
    for t in range(1, 1900):
        assert abs(order[: 2 * t].count("half") / 2 - t / 2) < 1
