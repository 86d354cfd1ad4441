"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

The raw model counts hashed one- and two-word n-grams over all documents, the target model over labelled documents of
good quality (a bounded sample of labels); it starts from PRIOR n-grams spread as the raw text's are, so that rare ones
say little. A document's log weight is the sum of log(target / raw) over its n-grams: the importance of the document, the
ratio of its densities under the two models. Adding Gumbel noise and taking the k largest keys draws k documents without
replacement in proportion to their weights. The noise follows
from doc_id and the seed. k is the number of documents times the share of good ones among labelled documents.

The k-th key is found exactly by counting keys in ever narrower ranges; no sort gathers the documents.

Defined cases: null text or text without words has log weight 0; rows tied with the k-th key are all kept, so rows that
repeat a document share its fate; without labels every row is kept with log weight 0; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docframe.cluster import durable, ship
from docframe.llm import kernels as K

BUCKETS = 1 << 16
#: Labelled documents that the target model is fitted on, about; the ids are broadcast.
TARGET_ROWS = 20_000
#: Weight of the raw text's distribution in the target model, in n-grams.
PRIOR = 20_000
SEED = 17
#: Keys that are compared one by one at the end of the search for the k-th.
LEAST = 5_000


def _features(column) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a batch, and the row of each."""
    data, at = K.text_buffers(column)
    starts, ends, of = K.words(data, at)
    one = K.span_hashes(data, starts, ends)
    two = K.window_hashes(one, 2)
    ok = of[: len(two)] == of[1:] if len(two) else np.zeros(0, bool)
    return np.concatenate((one, two[ok])) % np.uint64(BUCKETS), np.concatenate((of, of[: len(two)][ok]))


def _count(batches):
    sums = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in K.slices(batch):
            buckets, of = _features(part.column(0))
            target = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            sums[0] += np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
            sums[1] += np.bincount(buckets[target[of]].astype(np.int64), minlength=BUCKETS)
    some = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> tuple[np.ndarray, float]:
    """log(target / raw) by bucket, and the share of labelled documents that are good."""
    ship(docs.sparkSession)
    labels = labels.where("doc_id is not null and quality is not null")
    n, good = labels.agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    if not good:
        return np.zeros(BUCKETS), 1.0
    ids = labels.where("quality = 1").where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003)) < 1_000_003 * min(1.0, target_rows / good)).select("doc_id", F.lit(True).alias("target")).dropDuplicates(["doc_id"])
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    rows = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if rows.num_rows:
        raw[rows["bucket"].to_numpy()], target[rows["bucket"].to_numpy()] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    p = (raw + 1) / (raw.sum() + BUCKETS)
    q = (target + PRIOR * p) / (target.sum() + PRIOR)
    return np.log(q) - np.log(p), good / n


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight of each row."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                buckets, of = _features(part.column(1))
                total = np.bincount(of, weights=known.value[buckets.astype(np.int64)], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(total, 9))], names=["doc_id", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, log_weight double")


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column without nulls; None if there are fewer than k."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    if k < 1 or n < k:
        return None
    while n > LEAST and low < high:
        step = (high - low) / 1024
        part = F.least(F.floor((F.col(column) - low) / F.lit(step)), F.lit(1023))
        counts = {r["part"]: r for r in rows.where(F.col(column).between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for p in sorted(counts, reverse=True):
            if k <= counts[p]["n"]:
                break
            k -= counts[p]["n"]
        if counts[p]["n"] == n:
            break
        low, high, n = counts[p]["low"], counts[p]["high"], counts[p]["n"]
    if low == high or n > LEAST:
        return low
    return rows.where(F.col(column).between(low, high)).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]


def resampled(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, sample_key, kept of each row."""
    ratio, share = fit(docs, labels)
    even = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    rows = durable(weights(docs, ratio).withColumn("sample_key", F.col("log_weight") - F.log(-F.log(even))))
    total = rows.count()
    least = kth_largest(rows, "sample_key", round(total * share))
    return rows.withColumn("kept", F.lit(False) if least is None else F.col("sample_key") >= F.lit(least))
