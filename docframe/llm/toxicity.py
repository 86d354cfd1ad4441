"""Toxicity by compression distance with separate zstandard dictionaries.

Two dictionaries are trained by zstandard's own trainer. The ordinary one comes from ordinary text. The toxic one is the
same, as toxic text is written in the same language, with a part in front that is trained on toxic text only: on what sets
a toxic document apart, its words that are CONTRAST times as frequent in toxic documents as in ordinary ones. A text is cut
into windows of WINDOW words; each window is compressed with either dictionary under the same parameters, and the
difference of the two lengths is its evidence. The distribution of the differences is turned into a score by a logistic
model, calibrated on halves of the labelled rows with dictionaries of the other half. Whole texts are scored.

The model is fitted on a sample, on rows that are not held out only: at most about TRAIN_ROWS labelled rows of each class
and TRAIN_BYTES of text in all, chosen by a hash of doc_id among texts of at most LONGEST bytes. Dictionaries are trained
on the driver, whose memory follows TRAIN_BYTES; the sample is measured by the executors. Scoring reads only the text.

Defined cases: null or empty text has no evidence and gets the score of an empty text; if a class has no labelled rows,
every score is the share of toxic rows (0 without labels); where the sample is too small for the trainer, its last bytes
are the dictionary; repeated rows are scored one by one, ties get the same score; rows without a doc_id are scored and
not held out; labels with a null are left out, repeated labels of a document count once; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from docframe.cluster import ship

WINDOW = 4
TRAIN_ROWS, TRAIN_BYTES, LONGEST = 5000, 16 << 20, 1 << 18
THRESHOLD = 0.7
#: Bytes of the ordinary dictionary, and of the part of the toxic one that is trained on toxic text.
ORDINARY, TOXIC = 16384, 4096
#: The trainer's segment sizes for the two.
SEGMENT, TOXIC_SEGMENT = 8, 20
#: How much more frequent words of the toxic part's samples are, and how long at least (bytes, with a blank on each side).
CONTRAST, SHORTEST = 30, 6
#: Differences in bytes that are told apart, in either direction.
STEPS = 9
_STRIP = ".,!?;:*#$%&|<>\"()"
#: What stands before and after a window: the block's fixed costs are paid by the first, and zstandard finds no match that
#: begins in the last eight bytes.
_LEAD, _TAIL = 48, b" and the of a "
# Both dictionaries under the same parameters, so that only their content makes a difference.
_PARAMETERS = {"window_log": 17, "chain_log": 15, "hash_log": 16, "search_log": 3, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY}
FEATURES = 4 * STEPS + 1


def _words(text: str) -> list[str]:
    return [w.strip(_STRIP) for w in text.lower().split()]


def _samples(text: str) -> list[bytes]:
    """The different words of a text in order, each between blanks."""
    return [f" {w} ".encode("utf-8", "replace") for w in dict.fromkeys(_words(text)) if w]


def _distinct(texts: list[str]) -> list[str]:
    """The texts whose beginning and end were not seen before; copies would count one finding many times."""
    seen, out = set(), []
    for t in texts:
        ends = {("a", t[:64]), ("z", t[-64:])}
        if not ends & seen:
            out.append(t)
        seen |= ends
    return out


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text
        return b"".join(samples)[-size:]


def characteristic(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """For each toxic document, its words that are CONTRAST times as frequent in toxic documents as in ordinary ones."""
    ones, zeros = Counter(w for t in toxic for w in t), Counter(w for t in ordinary for w in t)
    least = CONTRAST * len(toxic) / max(1, len(ordinary))
    picked = (b"".join(w for w in t if len(w) >= SHORTEST and ones[w] > least * (zeros[w] + 1)) for t in toxic)
    return [p for p in picked if p]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The toxic dictionary and the ordinary one."""
    ones, zeros = [_samples(t) for t in _distinct(toxic)], [_samples(t) for t in _distinct(ordinary)]
    common = _trained([w for t in zeros for w in t], ORDINARY, SEGMENT)
    return _trained(characteristic(ones, zeros), TOXIC, TOXIC_SEGMENT) + common, common


def compressors(dictionaries: tuple[bytes, bytes]):
    out = []
    for content in dictionaries:
        d = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters(**_PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d))
    return out


def differences(text: str | None, lead: bytes, coders) -> list[int]:
    """For each window, the bytes that the toxic dictionary saves."""
    words = _words(text or "")
    one, two = coders
    out = []
    for k in range(0, len(words), WINDOW):
        window = lead + f" {' '.join(words[k : k + WINDOW])} ".encode("utf-8", "replace") + _TAIL
        out.append(len(two.compress(window)) - len(one.compress(window)))
    return out


def evidence(text: str | None, lead: bytes, coders) -> np.ndarray:
    """FEATURES of one text: logarithms and shares of the windows by what the toxic dictionary saves or loses at least."""
    saved = np.clip(np.array(differences(text, lead, coders), dtype=np.int64), -STEPS, STEPS)
    n = len(saved)
    count = np.bincount(saved + STEPS, minlength=2 * STEPS + 1)
    above, below = np.cumsum(count[::-1])[::-1][STEPS + 1 :], np.cumsum(count)[:STEPS]
    return np.concatenate((np.log1p(above), np.sqrt(above / max(n, 1)), np.log1p(below), np.sqrt(below / max(n, 1)), [np.log1p(n)]))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + penalty, x.T @ (w * (y - p)) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> dict:
    """Dictionaries and calibration."""
    ship(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {"constant": float(1 in sizes)}
    share = F.when(F.col("toxic") == 1, min(1.0, train_rows / sizes[1])).otherwise(min(1.0, train_rows / sizes[0]))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) / 1_000_003.0
    chosen = marks.withColumn("place", place / share).where("place < 1")
    texts = docs.where(f"octet_length(text) <= {LONGEST}").select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.where(F.col("place") < min(1.0, train_bytes / max(1, total))).select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)).alias("half"))
    found = rows.toArrow().sort_by("doc_id")
    held = list(zip(*(found[c].to_pylist() for c in ("text", "toxic", "half"))))
    if len({t for _, t, _ in held}) < 2:
        return {"constant": sizes[1] / (sizes[0] + sizes[1])}
    # Each half is measured with dictionaries of the other; the dictionaries kept are trained on both.
    parts = [train_dictionaries(*([x for x, t, h in held if t == k and (part is None or h != part)] for k in (1, 0))) for part in (0, 1, None)]

    def measured(batches):
        coders = [compressors(p) for p in parts[:2]]
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                yield pa.RecordBatch.from_arrays([pa.array([toxic], pa.int32()), pa.array([evidence(text, parts[half][1][-_LEAD:], coders[half]).tolist()])], names=["toxic", "x"])

    got = rows.select("doc_id", "text", F.col("toxic").cast("int"), F.col("half").cast("int")).mapInArrow(measured, "toxic int, x array<double>").toArrow()
    y = np.array(got["toxic"].to_pylist())
    x = np.array(got["x"].to_pylist()).reshape(len(y), FEATURES)
    w = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return {"pair": parts[2], "lead": parts[2][1][-_LEAD:], "mean": mean, "scale": scale, "weights": _logistic((x - mean) / scale, y, w / w.mean())}


def scored(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of each row."""
    ship(docs.sparkSession)

    def run(batches):
        coders = compressors(model["pair"]) if "pair" in model else None
        for batch in batches:
            if coders:
                texts = batch.column(1).to_pylist()
                x = (np.array([evidence(t, model["lead"], coders) for t in texts]).reshape(len(texts), FEATURES) - model["mean"]) / model["scale"]
                score = 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))
            else:
                score = np.full(batch.num_rows, model["constant"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
