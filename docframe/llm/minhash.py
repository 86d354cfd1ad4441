"""MinHash near-duplicate detection by a multi-index Hamming join, confirmed on full shingle sets.

A signature has CHUNKS * WIDTH symbols of 16 bits (b-bit minwise hashing). Two signatures that differ in fewer than
2 * CHUNKS symbols have, by pigeonhole, a chunk with at most one differing symbol; each chunk is therefore indexed
under every choice of the one symbol that may differ. Candidates that meet under a key are confirmed on the full sets.

The candidates of a key are never paired with each other wholesale:

1. texts with equal shingle sets are one node (their rows are tied to the smallest doc_id);
2. every node is compared with one centre of each key it is in, and confirmed links are joined into components;
3. in keys that still hold several components, nodes of different components are compared by signature and by a longer
   sketch. Of the near pairs only a spanning forest leaves the key: it says which nodes belong into one cluster;
4. the shingle sets of a cluster's nodes are brought together once. A node with too many shingles that no other node of
   its cluster has can't be linked and leaves; the others are compared on full sets under the rare shingles that similar
   sets must share, and a spanning forest of the links found is kept.

Steps 2 to 4 together test every pair that shares a key and isn't connected already, so no link is lost. Rows that leave a
step are at most as many as those that enter it.

A pair of similarity s shares no key with probability (1 - s**5 - 5 * s**4 * (1 - s))**8: 5e-7 at 0.85, 2e-5 at 0.8.

Defined cases: null text counts as empty; a text without words has an empty set and no links; a row without doc_id has
none either (component_id null, kept true). Rows that repeat a doc_id are versions of one document: it is linked if a
version is; each row is returned. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docframe.cluster import durable, ship
from docframe.llm import kernels as K
from docframe.llm.components import components

CHUNKS, WIDTH = 8, 5
SYMBOLS = CHUNKS * WIDTH
#: Differing symbols up to which a pair that met under a key stays a candidate: at a similarity of 0.85 the mean is 6 and
#: the standard deviation 2.3, at 0.8 they are 8 and 2.5.
MAX_DIFFERING = 22
#: Symbols of the longer sketch (8 bits each) that pairs of different components pass before their sets are compared, and
#: the standard deviations above the mean that they may differ by.
SKETCH, SIGMAS = 512, 4.5
#: Rows of a key, and nodes and shingles of a cluster, that are compared with each other at once.
BLOCK, NODES, SHINGLES = 16384, 4096, 1 << 20
_MUL = K.splitmix(np.arange(1, SYMBOLS + SKETCH + 1)) | np.uint64(1)
_ADD = K.splitmix(np.arange(1001, SYMBOLS + SKETCH + 1001))


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the word shingles of each text of an Arrow column."""
    data, at = K.text_buffers(column)
    data = K.LOWER[data]
    starts, ends, of = K.words(data, at)
    hashes = K.span_hashes(data, starts, ends)
    windows = K.window_hashes(hashes, size)
    bounds = np.searchsorted(of, np.arange(len(at)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            out.append(K.window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least(own: np.ndarray, first: int, n: int) -> np.ndarray:
    least = np.full(n, ~np.uint64(0))
    mul, add = _MUL[first : first + n, None], _ADD[first : first + n, None]
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 4096):
            least = np.minimum(least, ((own[None, k : k + 4096] ^ add) * mul).min(axis=1))
    return K.splitmix(least)


def signature(own: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of 16 bits of one non-empty set."""
    return (_least(own, 0, SYMBOLS) >> np.uint64(48)).astype(np.uint16)


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH symbols of 8 bits, of functions other than the signature's."""
    return (_least(own, SYMBOLS, SKETCH) >> np.uint64(56)).astype(np.uint8)


def sketch_limit(percent: int) -> int:
    """Symbols of two sketches that may differ at this similarity."""
    p = (1 - percent / 100) * 255 / 256
    return int(SKETCH * p + SIGMAS * (SKETCH * p * (1 - p)) ** 0.5)


def _features(size: int):
    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                sets = shingle_sets(part.column(1), size)
                sums = [_sums(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _signed(x for x, _ in sums),
                        _signed(x for _, x in sums),
                        pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig"],
                )

    return run


def _signatures(column) -> np.ndarray:
    return K.fixed(column, "<u2", SYMBOLS)


def _keys(batches):
    """For each node and chunk, a key for each symbol that may differ."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunks = _signatures(batch.column(1)).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        keys = np.empty((batch.num_rows, CHUNKS, WIDTH), np.uint64)
        for j in range(WIDTH):
            packed = np.zeros(chunks.shape[:2], np.uint64)
            for i in (i for i in range(WIDTH) if i != j):
                packed = packed << np.uint64(16) | chunks[:, :, i]
            keys[:, :, j] = K.splitmix(K.splitmix(packed) + K.splitmix(np.arange(CHUNKS) * WIDTH + j)[None, :])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), SYMBOLS))], names=["key", "node"])


def _sets_once(ids, texts, size: int) -> list[np.ndarray]:
    """The set of each row; a run of rows of the same id and text is cut into words once."""
    ids = ids.to_numpy()
    new = np.ones(len(ids), dtype=bool)
    order = np.argsort(ids, kind="stable")
    same = pc.equal(texts.take(pa.array(order[1:])), texts.take(pa.array(order[:-1]))).to_numpy(zero_copy_only=False).astype(bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | ~same
    sets = shingle_sets(texts.take(pa.array(order[new])), size)
    out = [None] * len(ids)
    for at, k in zip(order, np.cumsum(new) - 1):
        out[at] = sets[k]
    return out


def _confirm(size: int, percent: int):
    """Of rows (u, v, text of u, text of v), those whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "tu"):
                for sub in K.slices(part, "tv"):
                    left, right = _sets_once(sub.column(0), sub.column(2), size), _sets_once(sub.column(1), sub.column(3), size)
                    ok = []
                    for a, b in zip(left, right):
                        both = len(a) + len(b) - len(np.union1d(a, b))
                        ok.append(len(a) > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                    yield sub.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near(batches):
    """Of rows (u, v, signature of u, signature of v), those that differ in few symbols."""
    for batch in batches:
        if batch.num_rows:
            far = (_signatures(batch.column(2)) != _signatures(batch.column(3))).sum(axis=1)
            yield batch.select(["u", "v"]).filter(pa.array(far <= MAX_DIFFERING))


def _sums(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return (int(K.splitmix(own).sum()), int(K.splitmix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())) if len(own) else (0, 0)


def _signed(values) -> pa.Array:
    return pa.array(np.array(list(values), np.uint64).view(np.int64))


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                sets = shingle_sets(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), _signed(_sums(s)[0] for s in sets), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["node", "s1", "sketch"])

    return run


def _listed(size: int):
    """Rows (node, text, cluster, component) with the set in the place of the text."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                sets = shingle_sets(part.column(1), size)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), _signed(_sums(s)[0] for s in sets), own, part.column(2), part.column(3)], names=["node", "s1", "shingles", "cluster", "component"])

    return run


def _linked(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])


def _across(limit: int):
    """A spanning forest of the near pairs of different components in each key.

    Rows: key, i, j, block, node, component, sig, sketch; sorted by key, i, j.
    """

    def forest(rows):
        i, j = (rows.column(k)[0].as_py() for k in (1, 2))
        block, node, comp = (rows.column(k).to_numpy() for k in (3, 4, 5))
        if (comp == comp[0]).all():
            return
        sig, long = K.fixed(rows.column(6), "<u2", SYMBOLS), K.fixed(rows.column(7), np.uint8, SKETCH)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        root, out = np.arange(len(node)), []
        for a in range(0, len(left), 64):
            rows_at = left[a : a + 64]
            for b in range(0, len(right), 1024):
                cols_at = right[b : b + 1024]
                x, y = np.nonzero((comp[rows_at][:, None] != comp[cols_at][None, :]) & (root[rows_at][:, None] != root[cols_at][None, :]))
                for k in range(0, len(x), 8192):
                    u, v = rows_at[x[k : k + 8192]], cols_at[y[k : k + 8192]]
                    apart = root[u] != root[v]
                    u, v = u[apart], v[apart]
                    near = (sig[u] != sig[v]).sum(axis=1) <= MAX_DIFFERING
                    u, v = u[near], v[near]
                    near = (long[u] != long[v]).sum(axis=1) <= limit
                    for s, t in zip(u[near], v[near]):
                        if root[s] != root[t]:
                            root[root == root[t]] = root[s]
                            out.append((s, t))
        if out:
            yield _linked(*node[np.array(out)].T)

    def run(batches):
        for rows in K.runs(batches, 3):
            if rows.num_rows > 1:
                yield from forest(rows)

    return run


def similar_pairs(sets: list[np.ndarray], sides: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the pairs of sets whose similarity is at least percent.

    sides: bit 1 and bit 2 of each set; pairs are those of one set with bit 1 and one with bit 2. Sets of that similarity
    share one of the rarest size - ceil(percent * size / 100) + 1 values of each.
    """
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(sizes)))
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(of)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(len(sets)), sizes)
    value = rank[of]
    value = value[np.lexsort((value, owner))]
    need = -(-percent * sizes // 100)
    first = (np.arange(len(value)) - at[owner]) < (sizes - need + 1)[owner]
    asked = first & (sides[owner] & 2 > 0)
    order = np.argsort(value[asked], kind="stable")
    holders, begins = owner[asked][order], np.searchsorted(value[asked][order], np.arange(len(often) + 1))
    root, marked, out = np.unique(comp, return_inverse=True)[1], np.zeros(len(often), bool), []
    for a in np.flatnonzero(sides & 1):
        keys = value[at[a] : at[a + 1]]
        met = [holders[begins[k] : begins[k + 1]] for k in keys[: sizes[a] - need[a] + 1]]
        met = np.unique(np.concatenate([*met, np.zeros(0, np.int64)]))
        met = met[(root[met] != root[a]) & (100 * np.minimum(sizes[met], sizes[a]) >= percent * np.maximum(sizes[met], sizes[a]))]
        if not len(met):
            continue
        marked[keys] = True
        for part in np.split(met, np.flatnonzero(np.diff(np.cumsum(sizes[met]) >> 18)) + 1):
            part = part[root[part] != root[a]]
            if len(part):
                n = sizes[part]
                place = np.concatenate(([0], np.cumsum(n)[:-1]))
                both = np.add.reduceat(marked[value[np.arange(n.sum()) - np.repeat(place, n) + np.repeat(at[part], n)]].astype(np.int64), place)
                for b in part[100 * both >= percent * (n + sizes[a] - both)]:
                    if root[a] != root[b]:
                        root[root == root[b]] = root[a]
                        out.append((a, b))
        marked[keys] = False
    return out


def _similar(percent: int):
    """Links of different components in each cluster. Rows: cluster, i, j, block, node, component, shingles; sorted."""

    def run(batches):
        for rows in K.runs(batches, 3):
            i, j = (rows.column(k)[0].as_py() for k in (1, 2))
            block, node, comp = (rows.column(k).to_numpy() for k in (3, 4, 5))
            if (comp == comp[0]).all():
                continue
            lists = rows.column(6)
            at, data = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            out = similar_pairs([data[a:b] for a, b in zip(at[:-1], at[1:])], (block == i) + 2 * (block == j), comp, percent)
            if out:
                yield _linked(*node[np.array(out)].T)

    return run


def _blocked(rows: DataFrame, by: str, blocks, *columns: str) -> DataFrame:
    """Rows of each group in blocks, each pair of blocks in one place: by, i, j, block, columns."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    return rows.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id long, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    feat = durable(docs.mapInArrow(_features(size), "doc_id long, n_shingles long, s1 long, s2 long, sig binary"))
    groups = durable(feat.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig"), F.count("*").alias("copies")))
    same = feat.where("doc_id is not null").join(groups.where("copies > 1").drop("sig"), ["n_shingles", "s1", "s2"]).where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))

    keys = groups.select("node", "sig").mapInArrow(_keys, "key long, node long")
    order = F.xxhash64("node", F.pmod("key", F.lit(4)))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", order).alias("centre")).where("n > 1")
    shared = durable(keys.join(shared, "key"))
    sigs = groups.select("node", "sig")
    met = shared.where("node <> centre").select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v")).distinct()
    met = met.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
    stars = durable(met.select("u", "v", "su", "sv").mapInArrow(_near, "u long, v long"))
    texts = durable(docs.where("text is not null").join(shared.select(F.col("node").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id", "text"]))

    def confirmed(pairs):
        wide = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")
        return wide.select("u", "v", "tu", "tv").mapInArrow(_confirm(size, percent), "u long, v long")

    links = durable(same.unionByName(confirmed(stars)))
    found = durable(components(links))

    # Keys that still hold several components.
    sketches = durable(texts.mapInArrow(_sketches(size), "node long, s1 long, sketch binary").dropDuplicates(["node", "s1"]))
    placed = shared.join(found, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    rows = placed.join(mixed, "key").join(groups.select("node", "s1", "sig"), "node").join(sketches, ["node", "s1"])
    near = _blocked(rows, "key", F.ceil(F.col("n") / BLOCK), "node", "component", "sig", "sketch").mapInArrow(_across(sketch_limit(percent)), "u long, v long")
    clusters = components(near).withColumnRenamed("component", "cluster").join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))

    # Clusters: sets that have too few values in common with all others of the cluster leave, the rest are compared.
    sets = texts.withColumnRenamed("doc_id", "node").join(clusters, "node").select("node", "text", "cluster", "component")
    sets = durable(sets.mapInArrow(_listed(size), "node long, s1 long, shingles array<long>, cluster long, component long").withColumn("m", F.size("shingles")))
    alone = sets.select("cluster", "node", "s1", F.explode("shingles").alias("x")).groupBy("cluster", "x").agg(F.count("*").alias("c"), F.min(F.struct("node", "s1")).alias("of"))
    alone = alone.where("c = 1").groupBy("of").agg(F.count("*").alias("own")).select("of.node", "of.s1", "own")
    able = sets.join(alone, ["node", "s1"], "left").where(f"100 * (m - coalesce(own, 0)) >= {percent} * m")
    several = able.groupBy("cluster").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("nodes"), F.sum("m").alias("values")).where("a <> b")
    rows = able.join(several.select("cluster", "nodes", "values"), "cluster")
    blocks = F.greatest(F.ceil(F.col("nodes") / NODES), F.ceil(F.col("values") / SHINGLES))
    new = durable(_blocked(rows, "cluster", blocks, "node", "component", "shingles").mapInArrow(_similar(percent), "u long, v long"))
    if not new.isEmpty():
        found = durable(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new)))
    return (
        feat.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def stage(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates: of each component the document with the smallest doc_id stays, in one row."""
    found = durable(near_duplicates(docs, size, percent))
    ids = found.where("doc_id is not null")
    gone = ids.where("not kept").select("doc_id").distinct()
    again = ids.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = docs.join(gone.unionByName(again), "doc_id", "left_anti")
    repeated = docs.join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(_first())).where("_n = 1").drop("_n")
    return once.unionByName(repeated.select(*docs.columns))


def _first():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
