"""Exact removal of long repeated substrings, by bounded interval expansion on Burrows-Wheeler transforms.

Every byte is removed that is covered by a string of `length` bytes which also starts anywhere else. A whole-corpus
suffix array can't be built in one place, so equal strings are first brought together:

1. In each window of `length` bytes the ANCHOR-byte string with the least hash is its anchor. Equal windows have equal
   anchors at equal places, so only windows whose anchors have equal hashes need to meet. An anchor's context is the text
   of all windows that it stands for.
2. Anchors that occur once are settled. Contexts that occur twice or more are repeated as they are; they are counted, not
   gathered, so groups of copies collapse before anything is joined.
3. Of the other anchors, one context of each kind is read from its document. Blocks of such contexts are concatenated,
   and breadth-first backward extension on the block's Burrows-Wheeler transform derives the common prefixes of
   neighbouring suffixes by increasing value and stops at `length`: neighbours without a value share that much.
4. An anchor with more than MAX_CONTEXTS different contexts isn't put in one block: its windows are compared by hashes,
   counted by window.

Strings are judged on the input. Distributed sets of hashes are thinned by a bit table of fixed size, which never drops
a match.

Defined cases: null counts as empty; texts shorter than `length` keep every byte; rows that repeat a text (with the same
or another doc_id) count as different documents; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docframe.cluster import durable, ship
from docframe.llm import kernels as K

LENGTH = 200
ANCHOR = 32
MAX_CONTEXTS = 8192
#: Bytes of contexts that are transformed together, unless one anchor has more.
BLOCK = 1 << 19
#: Bits of the table of anchors that occur twice; 4 MB to every task at any size of the corpus.
TABLE_BITS = 1 << 25
#: Bytes of a document that are looked at together; longer ones in overlapping parts.
PART = 1 << 22
SEPARATOR = 0xFF  # never in UTF-8


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes (a power of two) from each place on."""
    h, n = K.BYTE[data], 1
    with np.errstate(over="ignore"):
        while n < ANCHOR:
            h = h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + (h[n:] ^ (h[n:] >> np.uint64(29)))
            n *= 2
    return K.splitmix(h)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    m = x
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - n : len(x) - n + 1])


_INVERSE = pow(int(K.powers(2)[1]), -1, 1 << 64)
_BACK = np.ones(1, np.uint64)


def _back(n: int) -> np.ndarray:
    global _BACK
    if len(_BACK) < n:
        p = np.full(n, np.uint64(_INVERSE), np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _BACK = np.multiply.accumulate(p)
    return _BACK


class _Hasher:
    """Hashes of any substrings of a byte array."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.BYTE[data] * K.powers(len(data) + 1)[: len(data)], dtype=np.uint64)))

    def __call__(self, start: np.ndarray, end: np.ndarray, salt) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * _back(len(self.sums))[start]
            return K.splitmix(h ^ K.splitmix(((end - start).astype(np.uint64) << np.uint64(20)) + np.asarray(salt, np.uint64)))


def _parts(data: np.ndarray, at: np.ndarray, length: int):
    """(row of each, offset in the row's text, bytes, document ends): joined short texts, or parts of a long one."""
    small = []
    for row in range(len(at) - 1):
        n = int(at[row + 1] - at[row])
        if n < length:
            continue
        if n <= PART:
            small.append(row)
        else:
            for a in range(0, n - length + 1, PART):
                b = min(n, a + PART + length - 1)
                yield np.array([row]), np.array([a]), data[at[row] + a : at[row] + b], np.array([0, b - a])
    if small:
        sizes = np.array([at[r + 1] - at[r] for r in small])
        yield np.array(small), np.zeros(len(small), np.int64), np.concatenate([data[at[r] : at[r + 1]] for r in small]), np.concatenate(([0], np.cumsum(sizes)))


def _anchors(data: np.ndarray, ends: np.ndarray, length: int):
    """document, anchor place, first and last window start, anchor hash, context hash of each anchor."""
    width = length - ANCHOR + 1
    h = _anchor_hashes(data)
    keyed = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    least = _sliding_least(keyed, width)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= ends[doc + 1])
    place = (least[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
    place = place[new]
    context = _Hasher(data)(first, last + length, place - first)
    return doc[first], place, first, last, h[place], context


def _scan(length: int, table):
    """The hashes h of all anchors; with a table, rows (h, c, doc_id, t, s, e) of those whose hash is in it."""

    def run(batches):
        bits = np.frombuffer(table.value, np.uint8) if table is not None else None
        for batch in batches:
            for part in K.slices(batch):
                data, at = K.text_buffers(part.column(2))
                for rows, offset, text, ends in _parts(data, at, length):
                    doc, _, first, last, h, context = _anchors(text, ends, length)
                    if bits is not None:
                        low = h & np.uint64(TABLE_BITS - 1)
                        keep = (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        doc, first, last, h, context = (x[keep] for x in (doc, first, last, h, context))
                    if not len(h):
                        continue
                    move = offset[doc] - ends[doc]
                    own = pa.array(rows[doc])
                    columns = [pa.array(h.view(np.int64))]
                    if bits is not None:
                        columns += [pa.array(context.view(np.int64))] + [part.column(k).take(own) for k in range(2)] + [pa.array(first + move), pa.array(last + move)]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "doc_id", "t", "s", "e"][: len(columns)])

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text in the order of the first `depth` bytes (or more) from there on."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    # Past the end counts as less than any byte: the last places differ by their own rank below.
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    reach = 8
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(~same)))
    while reach < depth and same.any():
        ahead = np.full(n, -1, np.int64)
        ahead[: n - reach] = rank[reach:] if reach < n else ahead[:0]
        key = (rank << 32) | (ahead + 1)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        rank[order] = np.concatenate(([0], np.cumsum(~same)))
        reach *= 2
    return order


def shared_with_next(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For k from 1 on, whether the suffixes order[k - 1] and order[k] share at least `length` bytes.

    Breadth-first: the intervals of all strings of one length are extended backwards by every byte; where an interval of
    a string of l + 1 bytes ends for the first time, the neighbours' common prefix is l. What has no value when l reaches
    `length` shares that much. Strings with a separator are never visited.
    """
    n = len(text)
    before = np.where(order > 0, text[order - 1], SEPARATOR).astype(np.uint8)
    by_byte = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[by_byte] = np.arange(n)
    first = before[by_byte]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        width = high - low
        single = low[width == 1]
        single = back[single[before[single] != SEPARATOR]]
        a, w = low[width > 1], width[width > 1]
        idx = np.repeat(np.arange(len(a)), w)
        at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(a, w)
        ok = before[at] != SEPARATOR
        key = np.sort((idx[ok] << 32) | back[at[ok]])
        lows, highs = single, single + 1
        if len(key):
            where, place = key >> 32, key & 0xFFFFFFFF
            new = np.ones(len(key), bool)
            new[1:] = (where[1:] != where[:-1]) | (first[place[1:]] != first[place[:-1]])
            starts = np.flatnonzero(new)
            lows = np.concatenate((single, place[starts]))
            highs = np.concatenate((single + 1, place[np.append(starts[1:], len(key)) - 1] + 1))
        fresh = ~known[highs]
        low, high = lows[fresh], highs[fresh]
        known[high] = True
    return ~known[1:n]


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the contexts, the places from which `length` bytes also start elsewhere in the block."""
    text = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)
    order = suffix_order(text, length)
    shared = shared_with_next(text, order, length)
    hit = np.zeros(len(text), bool)
    hit[order[1:][shared]] = True
    hit[order[:-1][shared]] = True
    out, at = [], 0
    for c in contexts:
        out.append(np.flatnonzero(hit[at : at + max(0, len(c) - length + 1)]))
        at += len(c) + 1
    return out


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate(([0], cut + 1))], places[np.append(cut, len(places) - 1)]


#: A run of window starts from s to e is one number.
PACK = 1 << 20


def _found(rows: list[tuple], kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["doc_id", "t", "run"])


def _transform(length: int):
    """Runs of repeated window starts of single contexts, from rows (h, n, doc_id, t, s, context) sorted by h."""

    def block(rows, kind):
        out = []
        for (_, n, doc_id, t, s, _), places in zip(rows, repeated_starts([r[5] for r in rows], length)):
            if n == 1:
                out += [(doc_id, t, (s + int(a)) * PACK + int(b - a)) for a, b in zip(*_runs(places))]
        return _found(out, kind)

    def run(batches):
        held, size, now, kind = [], 0, None, None
        for batch in batches:
            kind = batch.schema.field(2).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and row[0] != now:
                    yield block(held, kind)
                    held, size = [], 0
                held.append(row)
                size, now = size + len(row[5]), row[0]
        if held:
            yield block(held, kind)

    return run


_CONTEXT = ("h", "n", "doc_id", "t", "s", "context")


def _cut(length: int):
    """From rows (text, places, doc_id, t): the contexts."""

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(2).type
            for text, places, doc_id, t in zip(*(c.to_pylist() for c in batch.columns)):
                data, n = text.encode(), len(places)
                h, copies, kinds, s = (pa.array([p[k] for p in places], pa.int64()) for k in ("h", "n", "kinds", "s"))
                contexts = pa.array([data[p["s"] : p["e"] + length] for p in places], pa.binary())
                yield pa.RecordBatch.from_arrays([h, copies, pa.array([doc_id] * n, kind), pa.array([t] * n, pa.int64()), s, contexts, kinds], names=[*_CONTEXT, "kinds"])

    return run


def _windows(length: int):
    """The windows of contexts (h, n, doc_id, t, s, context) as two hashes each."""

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(2).type
            for _, n, doc_id, t, s, context in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(context, np.uint8)
                start = np.arange(len(part) - length + 1)
                one = _Hasher(part)(start, start + length, 1).view(np.int64)
                two = _Hasher(part[::-1])(len(part) - start - length, len(part) - start, 2).view(np.int64)
                k = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array([n] * k, pa.int64()), pa.array([doc_id] * k, kind), pa.array([t] * k, pa.int64()), pa.array((start + s) * PACK)], names=["w1", "w2", "n", "doc_id", "t", "run"])

    return run


def _table(hashes: DataFrame) -> bytes:
    """A bit for each value of h modulo TABLE_BITS."""
    low = hashes.select(F.col("h").bitwiseAND(TABLE_BITS - 1).alias("low"))
    words = low.select(F.shiftright("low", 5).cast("int").alias("w"), F.expr("shiftleft(1L, cast(low & 31 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(TABLE_BITS // 32, np.uint32)
    if words.num_rows:
        out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return out.tobytes()


def repeated_windows(keyed: DataFrame, length: int = LENGTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """doc_id, t, run: runs of window starts that also start elsewhere, packed; keyed: doc_id, t, text.

    doc_id is not null; t is a hash of the text, so that rows which share a doc_id are told apart.
    """
    spark = keyed.sparkSession
    ship(spark)
    scan = keyed.mapInArrow(_scan(length, None), "h long")
    table = spark.sparkContext.broadcast(_table(scan.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    # Anchors that occur once and meet another's bit pass here and are dropped with `several` below.
    hits = durable(keyed.mapInArrow(_scan(length, table), f"h long, c long, doc_id {kind}, t long, s long, e long"))

    contexts = durable(hits.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "s", "e")).alias("at")))
    packed = (F.col("s") * PACK + F.col("e") - F.col("s")).alias("run")
    plain = hits.join(contexts.where("n > 1").select("h", "c"), ["h", "c"]).select("doc_id", "t", packed)
    several = contexts.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("h", "kinds")
    open_ones = durable(contexts.join(several, "h").select("h", "n", "kinds", "at.*"))

    # The texts are read once, for contexts of either kind; what is read is kept if it is needed twice.
    places = open_ones.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "n", "kinds", "s", "e")).alias("places"))
    cut = keyed.join(places, ["doc_id", "t"]).select("text", "places", "doc_id", "t").mapInArrow(_cut(length), f"h long, n long, doc_id {kind}, t long, s long, context binary, kinds long")
    crowded = not open_ones.where(F.col("kinds") > max_contexts).isEmpty()
    cut = durable(cut) if crowded else cut
    found = cut.where(F.col("kinds") <= max_contexts).select(*_CONTEXT).repartition("h").sortWithinPartitions("h").mapInArrow(_transform(length), f"doc_id {kind}, t long, run long")
    out = plain.unionByName(found)
    if crowded:
        large = cut.where(F.col("kinds") > max_contexts).select(*_CONTEXT)
        windows = durable(large.mapInArrow(_windows(length), f"w1 long, w2 long, n long, doc_id {kind}, t long, run long"))
        again = windows.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2")
        out = out.unionByName(windows.where("n = 1").join(again, ["w1", "w2"]).select("doc_id", "t", "run"))
    return out


def _removed(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                spans: list[list[int]] = []
                for s, e in sorted((r // PACK, r // PACK + r % PACK + length) for r in runs or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                kept, last = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(data[last:s])
                    last = e
                kept.update(data[last:])
                out.append((doc_id, len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = F.coalesce("doc_id", F.lit(-1 << 63)) if kind == "bigint" else F.coalesce("doc_id", F.lit(0).cast(kind))
    keyed = docs.select("doc_id", own.alias("_id"), F.xxhash64("text").alias("t"), "text")
    some = keyed.where("text is not null").select(F.col("_id").alias("doc_id"), "t", "text")
    found = repeated_windows(some, length, max_contexts).groupBy(F.col("doc_id").alias("_id"), "t").agg(F.collect_set("run").alias("runs"))
    return keyed.join(found, ["_id", "t"], "left").select("doc_id", "text", "runs").mapInArrow(_removed(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
