"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths, in numpy over batches.

For each n-gram length the share of word characters inside repeats of an earlier n-gram is measured, and the share
inside lines equal to an earlier line. A text fails if a share is above its limit. All texts are used whole.

Defined cases: null counts as empty; a text without words has only zeros and fails the base rule for length; repeated
rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docframe.cluster import ship
from docframe.llm import kernels as K

#: Share of word characters that repeats of n-grams may cover, by n; and repeats of lines.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS = 50
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it occurred earlier."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether each of `total` words is in one of the n-word windows that start at `starts`."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measures(column) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the covered characters of each text."""
    data, at = K.text_buffers(column)
    rows = len(at) - 1
    starts, ends, of = K.words(data, at)
    firsts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = firsts[ends] - firsts[starts]
    words = np.searchsorted(of, np.arange(rows + 1))
    hashes = K.span_hashes(data, starts, ends)
    out = {"n_words": np.diff(words), "word_chars": _by_document(chars, words), "n_symbols": _by_document(_SYMBOL[data], at)}

    # Lines, without those that have no word.
    cuts = np.unique(np.concatenate((np.flatnonzero(data == 10) + 1, at)))
    cuts = cuts[cuts < len(data)] if len(data) else cuts[:0]
    line_ends = np.append(cuts[1:], len(data))
    line_ends -= (data[line_ends - 1] == 10) if len(cuts) else 0
    word_at = np.searchsorted(starts, cuts)
    next_at = np.searchsorted(starts, line_ends)
    full = next_at > word_at
    cuts, line_ends, word_at, next_at = cuts[full], line_ends[full], word_at[full], next_at[full]
    line_of = np.searchsorted(at, cuts, side="right") - 1
    _, later = _repeats(K.span_hashes(data, cuts, line_ends) ^ K.splitmix(line_of))
    out["n_dup_lines"] = np.bincount(line_of[later], minlength=rows)
    total = np.concatenate(([0], np.cumsum(chars)))
    out["line_chars"] = np.bincount(line_of[later], weights=(total[next_at] - total[word_at])[later], minlength=rows).astype(np.int64)

    salt = K.splitmix(of)

    def windows(n):
        h = K.window_hashes(hashes, n)
        ok = np.flatnonzero(of[: len(h)] == of[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        return ok, h[ok] ^ salt[ok]

    ok, keys = windows(3)
    twice, _ = _repeats(keys)
    out["n_repeat_words"] = _by_document(_covered(ok[twice], 3, len(starts)), words)
    candidate = None
    for n in LIMITS:
        ok, keys = windows(n)
        if candidate is not None:  # a repeat of n words begins with a repeat of fewer
            some = candidate[ok]
            ok, keys = ok[some], keys[some]
        twice, later = _repeats(keys)
        candidate = np.zeros(len(starts), bool)
        candidate[ok[twice]] = True
        out[f"chars_{n}"] = _by_document(_covered(ok[later], n, len(starts)) * chars, words)
    return out


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row."""
    ship(docs.sparkSession)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                m = measures(part.column(1))
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                most = np.maximum(m["word_chars"], 1)
                good = m["line_chars"] <= LINE_LIMIT * most
                for n, limit in LIMITS.items():
                    good &= m[f"chars_{n}"] <= limit * most
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[c], pa.int64()) for c in columns), pa.array(failed), pa.array(~failed & good)], names=["doc_id", *columns, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in columns)}, base_failed boolean, kept boolean")
