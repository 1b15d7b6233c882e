"""LM scoring by a probabilistic suffix tree, beside a unigram base.

The model reads a document as its lower-cased words, each followed by a space, the last by a line end, which is the
end token (a document without words is a line end alone).  Symbols are bytes; the 63 most frequent have a class each,
the rest share one.  A context is up to DEPTH preceding symbols, running back into the end of the text before,
which is always the line end.  A context is retained if it was seen LEAST times and its next-symbol distribution
diverges from that of its suffix by GAIN nats over all its occurrences; the suffixes of a retained context are
retained too.  Distributions are smoothed towards the suffix's: (n(s, x) + k * P(x | suffix)) / (n(s) + k), with k STRENGTH times
the number of different symbols that followed s.
A symbol is scored at the longest retained context.

Symbol runs are counted over all training documents, in tables that grow with them; each context is tested against its
suffix by a join of one depth's runs with the next shorter ones, and every context that passes is kept.  The model grows
with the corpus too.  It is cut into shards of about SHARD contexts by their KEYED nearest symbols (shorter contexts are
in every shard), so that a position needs one shard only.  Driver and tasks hold one shard at a time: a task puts its
pack's positions through one after the other.

Word counts grow with the corpus and are never gathered.  Documents are packed, some megabytes of text to a pack, each
with its list of distinct words; counts travel to a pack's words and back by joins, once a word and pack.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, settings
from .grams import held_out
from .words import Block, blocks, release

DEPTH, CLASSES, BITS = 6, 64, 6
#: Depth up to which one dense table finds the state; longer contexts are reached from there, a symbol at a time.
DENSE = 3
LEAST, GAIN, STRENGTH = 5, 4.0, 5.0
#: Contexts of a shard, and the nearest symbols that tell which shard a position needs.
SHARD, KEYED = 1 << 16, 2
END = 0x0A
#: The end token among word hashes, and text bytes in a pack.
END_HASH, PACK = np.uint64(0x5DEECE66D1234567), 16 << 20
#: Symbols whose runs a task counts at a time.
HELD = 12 << 20


def symbols(k: Block) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the model reads for a block, and where each document starts in them (and the end)."""
    n_docs = k.hi - k.lo
    words = np.diff(k.first)
    empty = np.flatnonzero(words == 0)
    at = k.first[empty]  # an empty document is a word of length zero
    starts, ends = np.insert(k.starts, at, 0), np.insert(k.ends, at, 0)
    size = ends - starts + 1
    stop = np.cumsum(size)
    source = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size - starts, size)
    out = np.full(len(source), 0x20, dtype=np.uint8)
    inside = np.ones(len(source), dtype=bool)
    inside[stop - 1] = False
    out[inside] = k.buf[source[inside]]
    last = np.cumsum(np.maximum(words, 1))
    out[stop[last - 1] - 1] = END
    return out, np.concatenate(([0], stop[last - 1])).astype(np.int64) if n_docs else np.zeros(1, np.int64)


def histories(s: np.ndarray, end_class: int) -> np.ndarray:
    """The DEPTH classes before each position, nearest in the low bits; s is classes, texts ending in END.

    Before the first text there is end after end; a text's first symbol sees the end of the one before, and no
    further, so that scores do not depend on neighbours.
    """
    h = np.zeros(len(s), dtype=np.uint64)
    for d in range(DEPTH):
        x = np.full(len(s), end_class, dtype=np.uint64)
        x[d + 1 :] = s[: max(0, len(s) - d - 1)]
        h |= x << np.uint64(BITS * d)
    start = np.concatenate(([0], np.flatnonzero(s == end_class) + 1))
    into = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    near = np.flatnonzero(into < DEPTH)
    own = (np.uint64(1) << (BITS * into[near]).astype(np.uint64)) - np.uint64(1)
    h[near] = (h[near] & own) | (np.uint64(sum(end_class << (BITS * d) for d in range(DEPTH))) & ~own)
    return h


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, dtype=np.int64)
    for b in batches:
        for k in blocks(b.column(0), lower=True):
            total += np.bincount(symbols(k)[0], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["symbol", "n"])


def _runs(batches: Iterator[pa.RecordBatch], classes: np.ndarray, end_class: int) -> Iterator[pa.RecordBatch]:
    """(run, n): histories with the next symbol in the low bits, counted over HELD symbols at a time.

    One buffer holds them and is sorted in place, so that a task needs little more than its 8 bytes a symbol.
    """
    held, size = np.empty(HELD, dtype=np.uint64), 0

    def emit():
        part = held[:size]
        part.sort()
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        n = np.diff(np.append(first, size))
        for i in range(0, len(first), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(part[first[i : i + (1 << 16)]].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["run", "n"])

    for b in batches:
        for k in blocks(b.column(0), lower=True):
            s = classes[symbols(k)[0]]
            run = (histories(s, end_class) << np.uint64(BITS)) | s
            at = 0
            while at < len(run):
                if size == HELD:
                    yield from emit()
                    size = 0
                n = min(HELD - size, len(run) - at)
                held[size : size + n] = run[at : at + n]
                at, size = at + n, size + n
    if size:
        yield from emit()
    del held
    release()


def _low(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


class SuffixTree:
    """A model, or a shard of one.  classes: of each byte.  inner: log10 of a byte within its class.

    Immutable; counts travel, and distributions and lookup are built where the model is used.
    """

    def __init__(self, byte_counts: np.ndarray, runs: np.ndarray, counts: np.ndarray, depths: np.ndarray):
        """runs of each depth: a retained context with the next symbol in the low bits, and how often it was seen.

        With a context come all its suffixes, and every symbol that followed it.
        """
        self.classes, self.inner = classes_of(byte_counts)
        n = np.bincount(self.classes, byte_counts, CLASSES)
        self.root = (n + 0.5) / (n.sum() + 0.5 * CLASSES)
        order = np.lexsort((runs, depths))
        self.runs, self.counts, self.depths = runs[order], counts[order], depths[order].astype(np.uint8)
        self.end_class = int(self.classes[END])

    def _levels(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: contexts, first of their runs, next symbols and counts."""
        for d in range(1, DEPTH + 1):
            at = slice(*np.searchsorted(self.depths, [d, d + 1]))
            context, first = np.unique(self.runs[at] >> BITS, return_index=True)
            yield context, first, self.runs[at] & (CLASSES - 1), self.counts[at]

    @property
    def contexts(self) -> list[tuple[int, int]]:
        """(depth, context) of each state, sorted."""
        return [(0, 0)] + [(d, c) for d, level in enumerate(self._levels(), 1) for c in level[0].tolist()]

    @property
    def logp(self) -> np.ndarray:
        """log10 of a class after each state."""
        rows, shorter, above = [self.root[None]], np.zeros(1, np.int64), self.root[None]
        for d, (context, first, nxt, n) in enumerate(self._levels(), 1):
            size = np.diff(np.append(first, len(nxt)))
            weight = STRENGTH * size
            p = above[np.searchsorted(shorter, context & _low(d - 1))] * weight[:, None]
            of = np.repeat(np.arange(len(context)), size)
            seen = np.bincount(of, n, len(context))
            p[of, nxt] += n
            p /= (seen + weight)[:, None]
            rows.append(p)
            shorter, above = context, p
        return np.concatenate([np.log10(x).astype(np.float32) for x in rows])

    def lookup(self) -> Lookup:
        return Lookup([level[0] for level in self._levels()], self.logp)

    def scores(self, k: Block, lookup: Lookup) -> np.ndarray:
        """log10 probability of each document of a block."""
        t = Symbols(k, self.classes, self.inner, np.zeros(1 << BITS * KEYED, np.uint16))
        t.add(lookup, 0)
        return t.score


class Lookup:
    """history -> state of the longest retained context, and logp of a class after a state."""

    def __init__(self, levels: list[np.ndarray], logp: np.ndarray):
        """levels: contexts of each depth, sorted."""
        self.logp = logp
        self.dense = np.zeros(1 << BITS * DENSE, dtype=np.uint32)
        #: of a state: the row of its longer contexts, and per row and older symbol the state (0: none)
        self.row = np.zeros(len(logp), dtype=np.uint32)
        rows = [np.zeros((1, CLASSES), dtype=np.uint32)]
        start, before, n_rows = 1, 0, 1
        for d, context in enumerate(levels, 1):
            state = np.arange(start, start + len(context), dtype=np.uint32)
            if d <= DENSE:  # longer ones overwrite
                self.dense.reshape(-1, 1 << BITS * d)[:, context] = state
            elif len(context):
                up, at = np.unique(before + np.searchsorted(levels[d - 2], context & _low(d - 1)), return_inverse=True)
                self.row[up] = np.arange(n_rows, n_rows + len(up))
                longer = np.zeros((len(up), CLASSES), dtype=np.uint32)
                longer[at, context >> BITS * (d - 1)] = state
                rows.append(longer)
                n_rows += len(up)
            before, start = start, start + len(context)
        self.rows = np.concatenate(rows)

    def states(self, h: np.ndarray) -> np.ndarray:
        out = self.dense[h & np.uint64(_low(DENSE))]
        at = np.arange(len(h))
        for d in range(DENSE, DEPTH):
            row = self.row[out[at]]
            at, row = at[row > 0], row[row > 0]
            longer = self.rows[row, (h[at] >> np.uint64(BITS * d)) & np.uint64(CLASSES - 1)]
            at, longer = at[longer > 0], longer[longer > 0]
            out[at] = longer
        return out


class Symbols:
    """The symbols of a block, 3 bytes each, while their shards come by; score: of each document, so far."""

    def __init__(self, k: Block, classes: np.ndarray, inner: np.ndarray, shard_of: np.ndarray):
        s, first = symbols(k)
        # DEPTH ends before each text are the history of its first symbol
        self.c = np.insert(classes[s], np.repeat(first[:-1], DEPTH), classes[END])
        self.first = first + DEPTH * np.arange(len(first))
        self.score = np.add.reduceat(inner[s], first[:-1]) if len(first) > 1 else np.zeros(0)
        self.shard = np.full(len(self.c), len(shard_of), dtype=np.uint16)
        key = np.zeros(max(0, len(self.c) - DEPTH), dtype=np.uint16)
        for d in range(KEYED):
            key |= self.c[DEPTH - 1 - d : len(self.c) - 1 - d].astype(np.uint16) << np.uint16(BITS * d)
        self.shard[DEPTH:] = shard_of[key]
        pad = (self.first[:-1, None] + np.arange(DEPTH)).ravel()
        self.shard[pad] = np.iinfo(np.uint16).max

    def add(self, lookup: Lookup, shard: int) -> None:
        """Adds what the positions of a shard score."""
        at = np.flatnonzero(self.shard == shard)
        h = np.zeros(len(at), dtype=np.uint64)
        for d in range(DEPTH):
            h |= self.c[at - 1 - d].astype(np.uint64) << np.uint64(BITS * d)
        each = lookup.logp[lookup.states(h), self.c[at]]
        total = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
        self.score += np.diff(total[np.searchsorted(at, self.first)])


def classes_of(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, log10 of a byte within its class); the end has a class of its own."""
    weight = byte_counts.astype(np.float64).copy()
    weight[END] = np.inf
    order = np.argsort(-weight, kind="stable")
    classes = np.full(256, CLASSES - 1, dtype=np.uint8)
    classes[order[: CLASSES - 1]] = np.arange(CLASSES - 1)
    inner = np.zeros(256)
    rest = order[CLASSES - 1 :]
    inner[rest] = np.log10((byte_counts[rest] + 0.5) / (byte_counts[rest].sum() + 0.5 * len(rest)))
    return classes, inner


def retained(runs: DataFrame, root: np.ndarray, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of runs(run, n) of depth DEPTH: (depth, context) of all retained contexts, and (depth, run, n) of their runs."""
    spark = runs.sparkSession
    # p: the smoothed probability of a run's last symbol after its context
    above = spark.createDataFrame([(x, float(p)) for x, p in enumerate(root)], "run long, p double")
    counts = {DEPTH: runs}
    for d in range(DEPTH - 1, 0, -1):
        counts[d] = scratch.save(counts[d + 1].groupBy(F.col("run").bitwiseAND(_low(d + 1)).alias("run")).agg(F.sum("n").alias("n")), "runs")
    levels: dict[int, DataFrame] = {}
    for d in range(1, DEPTH + 1):
        # a context has at most CLASSES followers
        whole = counts[d].groupBy(F.shiftright("run", BITS).alias("context")).agg(F.sum("n").alias("seen"), F.collect_list(F.struct("run", "n")).alias("followers"))
        each = whole.filter(F.col("seen") >= LEAST).select("seen", (STRENGTH * F.size("followers")).alias("weight"), F.inline("followers"))
        each = each.withColumn("up", F.col("run").bitwiseAND(_low(d))).join(above.select(F.col("run").alias("up"), F.col("p").alias("above")), "up")
        p = (F.col("n") + F.col("weight") * F.col("above")) / (F.col("seen") + F.col("weight"))
        gain = F.col("n") * F.log(F.col("n") / F.col("seen") / F.col("above"))
        levels[d] = above = scratch.save(each.select("run", "n", p.alias("p"), gain.alias("gain")), "level")
        scratch.drop(counts[d])
    keep, contexts, model = None, [], []
    for d in range(DEPTH, 0, -1):
        passing = levels[d].groupBy(F.shiftright("run", BITS).alias("context")).agg(F.sum("gain").alias("gain")).filter(F.col("gain") >= GAIN).select("context")
        if keep is not None:  # suffixes of what is kept
            passing = passing.unionByName(keep.select(F.col("context").bitwiseAND(_low(d)).alias("context"))).distinct()
        keep = scratch.save(passing, "keep")
        contexts.append(keep.select(F.lit(d).alias("depth"), "context"))
        of = levels[d].withColumn("context", F.shiftright("run", BITS)).join(keep, "context", "left_semi")
        model.append(of.select(F.lit(d).alias("depth"), "run", "n"))
    both = []
    for name, tables in (("contexts", contexts), ("model", model)):
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        both.append(scratch.save(out, name))
    scratch.drop(*levels.values())
    return both[0], both[1]


def learn(texts: DataFrame, scratch: Scratch) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Byte counts, and retained contexts and their runs, of every row of texts(text)."""
    found = texts.mapInArrow(_bytes, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    byte_counts = np.zeros(256, dtype=np.int64)
    byte_counts[found.column("symbol").to_numpy()] = found.column("n").to_numpy()
    classes, _ = classes_of(byte_counts)
    runs = texts.mapInArrow(partial(_runs, classes=classes, end_class=int(classes[END])), "run long, n long")
    runs = scratch.save(runs.groupBy("run").agg(F.sum("n").alias("n")), "runs")
    none = np.zeros(0, np.int64)
    return byte_counts, *retained(runs, SuffixTree(byte_counts, none, none, none).root, scratch)


def _tree(byte_counts: np.ndarray, model: DataFrame) -> SuffixTree:
    t = model.select("run", "n", "depth").toArrow()
    return SuffixTree(byte_counts, *(t.column(c).to_numpy() for c in ("run", "n", "depth")))


def fit(texts: DataFrame, scratch: Scratch | None = None) -> SuffixTree:
    """The whole model in one piece, of every row of texts(text)."""
    byte_counts, _, model = learn(texts, scratch or Scratch(texts.sparkSession, "tree"))
    return _tree(byte_counts, model)


def shards(byte_counts: np.ndarray, contexts: DataFrame, model: DataFrame, scratch: Scratch, size: int | None = None) -> tuple[np.ndarray, Iterator[SuffixTree]]:
    """The shard of each value of the KEYED nearest symbols, and the shards, one at a time."""
    size = size or SHARD
    key = lambda c: c.bitwiseAND(_low(KEYED)).cast("int").alias("key")
    n = np.zeros(1 << BITS * KEYED, dtype=np.int64)
    for r in contexts.filter(F.col("depth") >= KEYED).groupBy(key(F.col("context"))).count().collect():
        n[r.key] = r["count"]
    shard_of, i, held = np.zeros(len(n), dtype=np.uint16), 0, 0
    for k in np.argsort(-n, kind="stable").tolist():
        if held and held + n[k] > size:
            i, held = i + 1, 0
        shard_of[k], held = i, held + n[k]
    table = model.sparkSession.createDataFrame([(k, s) for k, s in enumerate(shard_of.tolist())], "key int, shard int")
    own = model.filter(F.col("depth") >= KEYED).withColumn("key", key(F.shiftright("run", BITS))).join(F.broadcast(table), "key").drop("key")
    if i:
        own = scratch.save(own.repartitionByRange("shard", "run").sortWithinPartitions("shard", "run"), "shards")
    short = model.filter(F.col("depth") < KEYED)
    return shard_of, (_tree(byte_counts, short.unionByName(own.filter(F.col("shard") == s).drop("shard"))) for s in range(i + 1))


#: The lookup of a model of one shard, by its broadcast.
_lookups: dict[int, tuple[object, Lookup]] = {}


def _score(held: list[Symbols], trees: list) -> np.ndarray:
    """Scores of the documents of several blocks; one shard is in memory at a time."""
    for i, tree in enumerate(trees):
        lookup = _lookups[id(tree)][1] if id(tree) in _lookups else tree.value.lookup()
        if len(trees) == 1:
            if id(tree) not in _lookups:
                _lookups.clear()
                _lookups[id(tree)] = (tree, lookup)
        else:
            tree.__dict__.pop("_value", None)  # read again for the next pack
        for x in held:
            x.add(lookup, i)
        del lookup
    return np.concatenate([x.score for x in held])


def _pack(batches: Iterator[pa.RecordBatch], trees: list, byte_counts: np.ndarray, shard_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to packs: scores by the tree, distinct words, and each document's words by number."""
    classes, inner = classes_of(byte_counts)
    part, n = TaskContext.get().partitionId(), 0
    held: dict[str, list] = {x: [] for x in ("doc_id", "held_out", "score", "n", "words", "train")}
    size = 0

    def emit():
        score = _score(held["score"], trees)
        held["score"].clear()
        tokens = np.concatenate(held["words"])
        words, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
        train = np.bincount(back, np.concatenate(held["train"]), len(words)).astype(np.int64)
        order = np.argsort(-count, kind="stable")  # common words get small numbers, which compress
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words))
        planes = np.ascontiguousarray(rank[back].view(np.uint8).reshape(-1, 4).T)
        lists = [pa.array(held["doc_id"]), pa.array(held["held_out"]), pa.array(score), pa.array(np.concatenate(held["n"])), pa.array(words[order].view(np.int64)), pa.array(train[order])]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), x) for x in lists]
        data = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        pack = pa.array([(part << 20) + n], type=pa.int64())
        yield pa.RecordBatch.from_arrays([pack, *columns, pa.array([data], type=pa.binary())], ["pack", "doc_ids", "held", "scores", "sizes", "words", "train", "tokens"])
        for x in held.values():
            x.clear()

    for b in batches:
        for k in blocks(b.column(2), lower=True):
            out_of = np.array(b.column(1)[k.lo : k.hi].to_pylist(), dtype=bool)
            per = np.diff(k.first) + 1
            words = np.insert(k.hashes(), k.first[1:], END_HASH)
            held["doc_id"] += b.column(0)[k.lo : k.hi].to_pylist()
            held["held_out"] += out_of.tolist()
            held["score"].append(Symbols(k, classes, inner, shard_of))
            held["n"].append(per)
            held["words"].append(words)
            held["train"].append(np.repeat(~out_of, per))
            size += len(k.buf)
            if size >= PACK:
                yield from emit()
                n, size = n + 1, 0
                release()
    if held["doc_id"]:
        yield from emit()
    release()


PACKED = "pack long, doc_ids array<long>, held array<boolean>, scores array<double>, sizes array<long>, words array<long>, train array<long>, tokens binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _base(key, left: pa.Table, right: pa.Table, total: int, distinct: int) -> pa.Table:
    """One pack (left) and the training counts of its words (right: at, c)."""
    out = {x: [] for x in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
    for row in left.to_pylist():
        count = np.zeros(len(row["train"]), dtype=np.int64)
        count[right.column("at").to_numpy()] = right.column("c").to_numpy()
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), dtype=np.uint8).reshape(4, -1)
        tokens = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        logs = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
        sizes = np.array(row["sizes"])
        first = np.cumsum(sizes) - sizes
        out["doc_id"] += row["doc_ids"]
        out["held_out"] += row["held"]
        out["n_tokens"] += row["sizes"]
        out["n_known"] += np.add.reduceat((count > 0)[tokens].astype(np.int64), first).tolist()
        out["train_tokens"] += [total] * len(sizes)
        out["base_score"] += np.add.reduceat(logs[tokens], first).tolist()
        out["score"] += row["scores"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(v, type=t) for v, t in zip(out.values(), types)], names=list(out))


def scored(docs: DataFrame, scratch: Scratch, modulus: int = 10, remainder: int = 0) -> DataFrame:
    """SCORED for every row of docs(doc_id, text).

    A null or empty text is one end token.  Rows without an id are learned from; repeated rows count each time.
    If every row is held out, nothing is known and the tree is its uniform root.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(modulus, remainder).alias("held_out"), "text")
    byte_counts, contexts, model = learn(rows.filter("NOT held_out").select("text"), scratch)
    shard_of, parts = shards(byte_counts, contexts, model, scratch)
    trees = [spark.sparkContext.broadcast(x) for x in parts]
    packs = scratch.save(rows.mapInArrow(partial(_pack, trees=trees, byte_counts=byte_counts, shard_of=shard_of), PACKED), "packs")
    for x in trees:
        x.unpersist()
    words = packs.select("pack", F.posexplode(F.arrays_zip("words", "train")).alias("at", "w")).select("pack", "at", F.col("w.words").alias("word"), F.col("w.train").alias("train"))
    counts = scratch.save(words.filter("train > 0").groupBy("word").agg(F.sum("train").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = words.select(F.col("pack").alias("of_pack"), "at", "word").join(counts, "word").select("of_pack", "at", "c")
    return packs.drop("words").groupBy("pack").cogroup(known.groupBy("of_pack")).applyInArrow(_with(total, distinct), SCORED)


def _with(total: int, distinct: int):
    def run(key, left, right):
        return _base(key, left, right, total, distinct)

    return run


def op8_suffix_tree_scoring(spark, sf_dir: str) -> DataFrame:
    settings(spark)
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op8"))
