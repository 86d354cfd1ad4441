"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (languages by `BUCKETS`), fitted on a bounded sample of labelled rows,
broadcast, and applied to batches: the score of a text is the product of its sparse n-gram count vector with the
matrix, summed here over the n-grams in place. Whole texts are scored. A language takes 128 KB of the broadcast matrix.

Defined cases: null text or text without a letter gives `und` with score 0; an empty table gives no rows; with no
labelled row every prediction is `und`. Ties between languages go to the first in code-point order. Repeated rows
are scored one by one. A row without doc_id is not held out. Columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docframe.cluster import ship
from docframe.llm import kernels as K

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Rows of each language that the model is fitted on, at most.
TRAIN_ROWS = 4000
#: The pipeline rejects a document whose best language has less than this share of the posterior.
MIN_SCORE = 0.5
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point of the first plane (else itself), and whether a code point is a letter."""
    if not _TABLES:
        low = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x10000):
            if len(x := chr(c).lower()) == 1:
                low[c] = ord(x)
        _TABLES["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _TABLES["low"] = low
    return _TABLES["low"], _TABLES["letter"]


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point but the last order - 1."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        h = (h ^ points[k : n + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(17)


def _prepared(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    low, _ = _tables()
    points, at = K.code_points(*K.text_buffers(batch.column(batch.schema.get_field_index("text"))))
    return low[points], at


def _inside(at: np.ndarray, n: int, order: int) -> np.ndarray:
    """Whether the n-gram that starts at a position ends in the same document."""
    ok = np.ones(max(0, n - order + 1), dtype=bool)
    for k in range(1, order):
        bad = at[1:-1] - k
        ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    return ok


def _count(batches):
    """Rows (lang, bucket, n) of one partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in K.slices(batch):
            points, at = _prepared(part)
            langs = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), dtype=object)
            of = np.repeat(np.arange(len(langs)), np.diff(at))
            for order in ORDERS:
                g, ok = grams(points, order), _inside(at, len(points), order)
                for lang in set(langs):
                    mine = ok & (langs == lang)[of[: len(g)]]
                    sums[lang] = sums.get(lang, 0) + np.bincount(g[mine], minlength=BUCKETS)
    for lang, n in sums.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])


def held_out(doc_id="doc_id", modulus: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Languages and their log probabilities, from the rows with text and lang that are not held out.

    Counts of rows by language come from all rows; the n-gram counts from at most about train_rows of each language,
    chosen by a hash of doc_id.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "logp": np.zeros((0, BUCKETS), np.float32), "prior": np.zeros(0)}
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, train_rows / sizes[lang])))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_003)) / 1_000_003.0 < share[F.col("lang")])
    counted = chosen.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(langs), BUCKETS))
    if counted.num_rows:
        row = {lang: i for i, lang in enumerate(langs)}
        n[[row[x] for x in counted["lang"].to_pylist()], counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    logp = np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    total = sum(sizes.values())
    return {"langs": langs, "logp": logp.astype(np.float32), "prior": np.log([sizes[x] / total for x in langs])}


def score_batch(batch: pa.RecordBatch, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language (-1: none) and its posterior, for each row."""
    points, at = _prepared(batch)
    rows, langs = batch.num_rows, len(model["langs"])
    _, letter = _tables()
    some = np.flatnonzero(np.diff(at))
    has = np.zeros(rows, dtype=bool)
    if len(some):
        has[some] = np.add.reduceat(letter[points].astype(np.int64), at[some]) > 0
    if not langs or not has.any():
        return np.full(rows, -1), np.zeros(rows)
    total = np.tile(model["prior"], (rows, 1))
    for order in ORDERS:
        g, ok = grams(points, order), _inside(at, len(points), order)
        here = some[at[some] < len(g)]
        if not len(here):
            continue
        g = np.where(ok, g, BUCKETS)
        for k in range(langs):
            weight = np.append(model["logp"][k], np.float32(0))
            total[here, k] += np.add.reduceat(weight[g].astype(np.float64), at[here])
    total -= total.max(axis=1, keepdims=True)
    share = np.exp(total)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    return np.where(has, best, -1), np.where(has, share[np.arange(rows), best], 0.0)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        m = known.value
        names = np.array([*m["langs"], "und"], dtype=object)
        for batch in batches:
            for part in K.slices(batch):
                best, score = score_batch(part, m)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, lang_pred string, score double")


def stage(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is recognised: not `und`, and with at least min_score of the posterior.

    The decision is made where the row is, without a shuffle of texts.
    """
    model = fit(docs)
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                best, score = score_batch(part, known.value)
                yield part.filter(pa.array((best >= 0) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)
