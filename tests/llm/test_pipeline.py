import hashlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from tests_llm_helpers import slow_cut, slow_groups
from tidewindow.llm import bpe, quality
from tidewindow.runtime import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_against_a_plain_version(spark, documents):
    """The stages over, in plain Python, but for the classifier's scores, which have tests of their own."""
    weights = quality.fit(spark, documents, spark.read.parquet(f"{SF}/labels.parquet"), "quality", 4, 2)
    rows = {r.doc_id: (r.text or "", r.source) for r in quality.with_score(documents, weights).collect() if r["__score"] >= corpus_pipeline.QUALITY}
    groups = slow_groups({i: t for i, (t, _) in rows.items()})
    rows = {i: v for i, v in rows.items() if groups[i] == i}
    texts = slow_cut({i: t for i, (t, _) in rows.items()})
    t = bpe.Tokenizer(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    want = []
    for i, text in texts.items():
        ids = t.encode_batch([text])[0]
        want.append((i, rows[i][1], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and 20 < len(got) < documents.count()


def test_stages_keep_columns_and_take_odd_rows(spark, documents):
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, None, 0), (10**6, "", None, None, 0)], documents.schema)
    docs = documents.limit(40).unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_columns_named_like_helpers_stay(spark, documents):
    docs = documents.limit(60).selectExpr("*", *[f"'z' AS {c}" for c in ("__score", "__id", "__key", "__KEPT", "__source", "__place", "___place", "fp", "component_id", "key")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r[0] for r in out.select("__score").collect()} == {"z"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_target_weights_decide_places(spark, documents, monkeypatch, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    mix, last = stages["mixing sources to target weights"], corpus_pipeline.STAGES[-1][1]

    def places(name):
        mix(spark, documents, SF).write.parquet(f"{tmp_path}/{name}")
        return {r.doc_id: r.place for r in last(spark, spark.read.parquet(f"{tmp_path}/{name}"), SF).collect()}

    usual = places("usual")
    assert sorted(usual.values()) == list(range(documents.count()))
    want = corpus_pipeline.mixing.in_mixed_order(documents, Scratch(spark, "t"), corpus_pipeline.mixing.tempered(corpus_pipeline.mixing.source_counts(documents)))
    assert sorted(usual, key=usual.get) == [r.doc_id for r in want.collect()]
    heavy = max(corpus_pipeline.mixing.source_counts(documents))
    monkeypatch.setattr(corpus_pipeline.mixing, "tempered", lambda counts: {s: 1000.0 if s == heavy else 1.0 for s in counts})
    assert places("changed") != usual


def test_labels_of_both_kinds_are_needed(spark, documents, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(ValueError):
        corpus_pipeline.keep_quality(spark, documents, str(tmp_path))
