import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewindow.llm import media as M
from tidewindow.runtime import Scratch


def texts():
    random.seed(8)
    passage = "".join(random.choices("abcdefgh äöü\n", k=9000))
    out = [None, "", " ", "a", "a" + " " * 191, "x" * 192, "x" * 193, "z" * 50_000, passage, passage[3000:] + "tail", "head" + passage]
    for i in range(40):
        t = "".join(random.choices("abcdefgh ", k=random.choice([10, 300, 3000])))
        at = random.randrange(len(t))
        out.append(t[:at] + (passage if i % 4 == 0 else "") + t[at:])
    return out + out[20:30]


def test_gear_and_cuts():
    data = np.frombuffer(random.Random(1).randbytes(3000), dtype=np.uint8)
    h = M.gear(data)
    for i in (0, 5, 40, 2999):
        assert int(h[i]) == sum(int(M.GEAR[data[j]]) << (i - j) for j in range(max(0, i - 31), i + 1)) % (1 << 32)
    loads = [M.payload((t or "").encode()) for t in texts()]
    for p, n in zip(loads, M.cuts(loads)):
        assert sum(n) == len(p) and max(n) <= M.MOST and min(n[:-1], default=M.LEAST) >= M.LEAST and [n] == M.cuts([p])


@pytest.mark.parametrize("bits", [M.FILTER_BITS, 40_000, 8])
def test_round_trip(spark, frame, bits):
    rows = [*enumerate(texts()), (3, "a"), (3, "other text of the same id"), (None, "no id"), (None, None)]
    store = M.ChunkStore(frame(rows, extra=True), Scratch(spark, "t"), bits)
    of = {(r.doc_id, r.n_bytes, bytes(r.object)) for r in store.of_docs.collect()}
    back = {bytes(r.object): bytes(r.payload) for r in store.payloads().collect()}
    want = {(i, len((t or "").encode()), M.payload((t or "").encode())) for i, t in rows}
    assert store.of_docs.count() == len(rows) and {(i, n, back[o]) for i, n, o in of} == want
    kept = store.table.selectExpr("sum(length(bytes))").first()[0]
    assert kept < 0.8 * sum(len(p) for p in {p for _, _, p in want})
    got = store.features().collect()
    assert len(got) == len(back)
    for r in got:
        p = back[bytes(r.object)]
        assert r.payload_bytes == len(p) and r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:]) and r.media_bytes > len(p)
    # the stored form, put together from the stored columns alone
    rows = store.table.collect()
    shared = {bytes(r.digest): bytes(r.bytes) for r in rows if r.digest is not None}
    form = {}
    for r in (r for r in rows if r.object is not None):
        data, at, own = bytes(r.manifest), 16, 0
        for kind in r.kinds:
            n, digest = int.from_bytes(r.manifest[at : at + 4], "little"), bytes(r.manifest[at + 4 : at + 20])
            data += bytes(r.bytes[own : own + n]) if kind == M.PRIVATE else shared[digest]
            own, at = own + (n if kind == M.PRIVATE else 0), at + 20
        form[bytes(r.object)] = (len(data), hashlib.sha256(data).hexdigest())
    assert {bytes(r.object): (r.media_bytes, r.media_sha256) for r in got} == form
    x = np.frombuffer(p, dtype=np.uint8).astype(float)
    assert f"step={np.abs(np.diff(x)).mean():.6f}" in {bytes(g.object): g.feature for g in got}[M._digest(p)]
    assert store.table.filter("digest IS NOT NULL").count() == store.table.filter("digest IS NOT NULL").select("digest").distinct().count() > 0


def test_filter_passes_what_was_put_in(spark):
    for bits in (8, 40_000, M.FILTER_BITS):
        picks = np.random.default_rng(bits).integers(-(1 << 63), 1 << 63, 500)
        marked = M._filter(spark.createDataFrame([(x,) for x in [0, -1, *picks.tolist()]], "pick long"), bits)
        assert M._passes(pa.array([0, -1, *picks.tolist()]), marked, bits).all()
        others = M._passes(pa.array(picks + 12345), marked, bits)
        assert np.unpackbits(marked).sum() <= 502 and others.mean() < (1.1 if bits == 8 else 0.1)


def test_damage_is_found_and_empty(spark, frame):
    d = M._digest(b"abc")
    assert M.assemble([d], [3], b"\0", b"abc", {}) == [b"abc"]
    with pytest.raises(ValueError):
        M.assemble([d], [3], b"\0", b"abd", {})
    with pytest.raises(ValueError):
        M.assemble([d], [3], b"\2", b"", {0: b"xyz"})
    whole = M.manifest([3], [d])
    assert M.read_manifest(whole) == ([3], [d])
    for bad in (b"", whole[:-1], b"X" + whole[1:], whole[:4] + b"\1" + whole[5:]):
        with pytest.raises(ValueError):
            M.read_manifest(bad)
    store = M.ChunkStore(frame([]), Scratch(spark, "t"))
    assert store.features().collect() == [] and store.of_docs.collect() == []


def test_chunks_repeated_within_one_payload_are_stored_once(spark, frame):
    passage = "".join(random.Random(4).choices("abcdefgh ", k=9000))
    rows = {1: passage * 12, 2: "y" * 60_000, 3: "alone"}
    store = M.ChunkStore(frame(rows), Scratch(spark, "t"))
    assert store.table.selectExpr("sum(length(bytes))").first()[0] < 50_000
    back = {bytes(r.object): bytes(r.payload) for r in store.payloads().collect()}
    assert {r.doc_id: back[bytes(r.object)] for r in store.of_docs.collect()} == {i: M.payload(t.encode()) for i, t in rows.items()}
