import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tidewindow.llm import bpe as B

FILE = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def pair():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}
    return B.Tokenizer(FILE, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(own, text):
    return [int.from_bytes(x[i : i + 4], "little") for x in own.encode_batch([text]) for i in range(0, len(x), 4)]


def texts():
    random.seed(4)
    letters = "abcdefghijklmnop ETAOIN\n\t 0123456789.,!'éüßñ漢字😀 ​\x1c\x85'sll"
    out = ["", " ", "  \n  x", "it's we'll I'd", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "x" * 5000, "ab" * 300, "=" * 777, " " * 999 + "z", "\r\n\r\n"]
    out += ["".join(random.choices(letters, k=random.choice([1, 5, 50, 400]))) for _ in range(200)]
    return out + ["".join(chr(c) for c in (random.randrange(0x20, 0x3000) for _ in range(300)) if not 0xD800 <= c < 0xE000) for _ in range(20)]


def test_same_as_the_library(pair):
    own, lib = pair
    for t in texts():
        assert ids(own, t) == lib.encode_ordinary(t), repr(t)
        assert own.decode(own.encode_batch([t])[0]) == t.encode()


def test_wide_rows_and_matrix_agree(pair):
    own, lib = pair
    random.seed(1)
    of = lambda x: [int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)]
    for n in (2, 3, 7, 16, 60, 128):
        for _ in range(20):
            p = bytes(random.choices(b"aeinrst the", k=n))
            assert of(own._matrix([p], n)[0]) == of(own._wide(p)) == lib._encode_single_piece(p) or p in own.ranks
    for p in (b"=" * 3001, b" " * 40_000, "漢字".encode() * 700, bytes(random.choices(b"aeinrstdlc", k=9000)), bytes(random.choices(range(256), k=4000)), b"ab" * 2000 + b"a"):
        assert of(own._wide(p)) == lib._encode_single_piece(p)


def test_wide_rows_on_any_ranks():
    """Ranks that no training gives, where a merge can make a pair of lower rank."""
    random.seed(3)
    for _ in range(60):
        tokens = {bytes([i]): i for i in range(256)}
        made = {bytes(random.choices(b"abc", k=random.choice([2, 2, 3, 4, 5]))) for _ in range(25)}
        tokens |= {t: 256 + i for i, t in enumerate(random.sample(sorted(made), len(made)))}
        own = B.Tokenizer(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in tokens.items()), P.PATTERN)
        for _ in range(20):
            p = bytes(random.choices(b"abc", k=random.choice([5, 40, 200])))
            w = [p[i : i + 1] for i in range(len(p))]
            while ranks := [tokens[a + b] for a, b in zip(w, w[1:]) if a + b in tokens]:
                i = next(i for i in range(len(w) - 1) if tokens.get(w[i] + w[i + 1]) == min(ranks))
                w[i : i + 2] = [w[i] + w[i + 1]]
            assert own._wide(p) == b"".join(tokens[x].to_bytes(4, "little") for x in w)


def test_query(spark, frame, pair):
    lib = pair[1]
    rows = list(enumerate(texts()[:40])) + [(7, "again"), (7, "again"), (None, None), (99, "long " * 50_000)]
    got = B.public_codec(spark).digests(frame(rows, extra=True), "doc_id").collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, t) in zip(got, rows):
        want = lib.encode_ordinary(t or "")
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.public_codec(spark).digests(frame([]), "doc_id").collect() == []
