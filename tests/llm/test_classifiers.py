import random
import zlib

import numpy as np
import pyarrow as pa

from tidewindow.llm import quality, rules, toxicity
from tidewindow.llm.grams import labelled
from tidewindow.llm.words import blocks


def corpus(spark, bad, n=400):
    random.seed(2)
    vocab = ["".join(random.choices("abcdefgh", k=random.choice([2, 4, 7]))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        w = random.choices(vocab, k=random.choice([60, 150, 400]))
        y = random.random() < 0.4
        if y:
            bad(w)
        docs.append((i, " ".join(w), "en", i))
        labels.append((i, int(y)))
    extra = [(n, None, None, 0), (n + 1, "", "", None), (n + 2, "word " * 50_000, "", 1), (None, "a b", "", 2), (3, docs[3][1], "en", 3)]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, score string, label long"), labels


def test_toxicity_learns_pairs_and_is_held_out(spark):
    def insult(w):
        for _ in range(4):
            w.insert(random.randrange(len(w)), "zlorp" + random.choice(["en", "ung", "s", ""]))

    docs, labels = corpus(spark, insult)
    table = spark.createDataFrame([(i, y) for i, y in labels] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, table, "toxic", 3, 1)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 404 and np.mean([(s >= 0.7) == y for s, y in held]) > 0.97 and all(0 <= s <= 1 for s in got.values())
    flipped = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in labels], "doc_id long, toxic int")
    again = toxicity.toxicity(docs, toxicity.fit(spark, docs, flipped, "toxic", 3, 1)).collect()
    assert {r.doc_id: r.score for r in again} == got  # labels held out change nothing
    none = toxicity.fit(spark, docs, table.limit(0), "toxic", 3, 1)
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0} and toxicity.toxicity(docs.limit(0), model).collect() == []


def test_machine_fits_an_interaction():
    """Neither term alone says anything; both together do."""
    rng = np.random.default_rng(0)
    y, rows, terms = [], [], []
    for i in range(400):
        a, b = rng.integers(0, 2, 2)
        y.append(float(a and b))
        for t in [0] * a + [1] * b + list(rng.integers(2, 6, 2)):
            rows.append(i), terms.append(int(t))
    m = toxicity.FactorizationMachine(6, 4)
    m.fit(np.array(rows), np.array(terms), np.array(y), epochs=300)
    p = m.raw(np.array(rows), np.array(terms), 400) > 0
    assert (p == np.array(y)).mean() > 0.98


def test_raw_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(20, 4)
    m.bias, m.w, m.v = 0.3, rng.normal(size=20), rng.normal(size=(20, 4))
    docs = [rng.choice(20, k, replace=False) for k in (0, 1, 2, 7, 20)]
    rows = np.repeat(np.arange(5), [len(d) for d in docs])
    want = [0.3 + sum(m.w[i] for i in d) + sum(m.v[i] @ m.v[j] for a, i in enumerate(d) for j in d[:a]) for d in docs]
    assert np.allclose(m.raw(rows, np.concatenate(docs).astype(int), 5), want)


def test_labels_of_pairs_alone_are_learned(spark):
    """Half of all documents hold zlorp, half hold bramf; toxic are those that hold both or none, so neither tells."""
    rng, words = random.Random(5), [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnprst"]
    rows = []
    for i in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = rng.choices(words, k=30) + ["zlorp"] * a + ["bramf"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit(spark, docs, docs.selectExpr("doc_id", "y AS toxic"), "toxic", 3, 1)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.99


def test_quality(spark):
    docs, labels = corpus(spark, lambda w: w.__setitem__(slice(None), [x + random.choice(["%%%", "$$$"]) for x in w]))
    table = spark.createDataFrame([(i, 1 - y) for i, y in labels], "doc_id long, quality int")
    weights = quality.fit(spark, docs, table, "quality", 4, 2)
    out = quality.with_score(docs, weights)
    assert out.columns == [*docs.columns, "__score"]
    got = {r.doc_id: r["__score"] for r in out.collect()}
    held = [(got[i], 1 - y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert out.count() == docs.count() and np.mean([(s >= 0.7) == y for s, y in held]) > 0.97 and got[400] == got[401]
    assert quality.with_score(docs.limit(0), weights).collect() == []


def test_samples_are_bounded_and_exclude_held_out(spark):
    table = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(4, 1), (None, 0), (6, None)], "doc_id long, toxic int")
    got = labelled(table, "toxic", 3, 1, 20).collect()
    assert len(got) == 40 and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)


def slow_faults(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_rules(spark):
    random.seed(9)
    texts = ["", " \n ", "a", "a b c a b c", "é ü é ü é ü | # <x>\nA\nA\n A\n\n\nA", "x " * 3000, "same line\n" * 80]
    texts += ["".join(random.choices("ab é\n\t#|", k=random.choice([30, 300]))) for _ in range(40)]
    column = pa.array(texts)
    got = [r for k in blocks(column, size=500) for r in zip(*(x.tolist() for x in rules.faults(k)))]
    assert got == [slow_faults(t) for t in texts]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (None, "a b"), (2, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] * 2 + [(None, 1)], "doc_id long, quality int")
    rows = rules.judged(docs, labels).collect()
    assert len(rows) == len(texts) + 3 and all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert {r.log_ratio for r in rules.judged(docs, labels.limit(0)).collect()} == {0.0} and rules.judged(docs.limit(0), labels).collect() == []


def test_rules_ratio(spark):
    clean = ["alpha beta gamma delta " * 3 + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    junk = [" ".join(f"w{i}x{j} ###" for j in range(60)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in rules.judged(docs, labels).collect()}
    assert all(got[i] == (i < 30) for i in range(60))


def test_trusted_ids_by_bitmap_and_by_join(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 10**12, -1, -5, -32768, -32769, None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids + [2, 9, 40_000, -2, 7]], "doc_id long, text string")
    for good in (ids[::2], ids[1::2], []):
        table = spark.createDataFrame([(i,) for i in good + good], "doc_id long")
        want = sorted(f"t{i}" for i in ids + [2, 9, 40_000, -2, 7] if i is not None and i in good)
        assert sorted(r.text for r in rules._trusted(docs, table).collect()) == want == sorted(r.text for r in rules._trusted(docs, table, 0).collect())


def test_rules_against_a_plain_version_with_clashing_columns(spark):
    import re
    from collections import Counter

    random.seed(4)
    vocab = ["alpha", "beta", "gamma", "x1", "!", "Été", "no"]
    texts = [" ".join(random.choices(vocab, k=random.choice([0, 3, 60, 120]))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1.0, 5) for i, t in enumerate(texts)], "doc_id long, text string, log_ratio double, bucket long")
    good = set(range(0, 40, 3))
    labels = spark.createDataFrame([(i, int(i in good), "z") for i in range(40)], "doc_id long, quality int, text string")

    def grams(t):
        w = re.findall(r"[0-9a-z\u0080-\uffff]+|[^0-9a-z\u0080-\uffff\s]+", "".join(c.lower() if c.isascii() else c for c in t))
        return w + [("again",) if a == b else (a, b) for a, b in zip(w, w[1:])]

    target, raw = Counter(g for i in good for g in grams(texts[i])), Counter(g for t in texts for g in grams(t))
    size = 1 << rules.BITS
    p = lambda c, g: np.log((c[g] + rules.SMOOTH) / (sum(c.values()) + rules.SMOOTH * size))
    for r in rules.judged(df, labels).collect():
        g = grams(texts[r.doc_id])
        want = sum(p(target, x) - p(raw, x) for x in g) / max(1, len(g))
        assert abs(r.log_ratio - want) < 1e-9 and r.kept == (not r.base_failed and want >= rules.THRESHOLD)
