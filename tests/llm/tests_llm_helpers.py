"""Plain versions of operators that several tests compare with."""

import re

import xxhash


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(texts):
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    out = {}
    for i in sorted(fp):
        if i not in out:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in out:
                    out[x] = i
                    stack += [y for y in fp if y not in out and (fp[x] ^ fp[y]).bit_count() <= 3]
    return out


def slow_cut(texts, window=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    first = {}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = {p + j for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for j in range(window)}
        out[i] = " ".join(x for q, x in enumerate(w) if q not in gone) if gone else texts[i]
    return out
