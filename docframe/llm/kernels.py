"""numpy kernels over Arrow string batches: bounded slices, words, hashes.

All kernels see whole texts. A batch is cut into slices of about `SLICE` bytes between documents, so that working
memory follows one slice or the longest single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
U = np.uint64


def splitmix(x):
    """The finaliser of the splitmix64 generator over uint64 values."""
    with np.errstate(over="ignore"):
        x = (np.asarray(x, dtype=U) + U(0x9E3779B97F4A7C15)).astype(U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: One random 64-bit value for each byte value.
BYTE = splitmix(np.arange(256))
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = np.ones(1, dtype=U)


def powers(n: int) -> np.ndarray:
    """1, B, B**2 ... modulo 2**64, at least n of them."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), U(0xD6E8FEB86659FD95), dtype=U)
        p[0] = U(1)
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(p)
    return _POWERS


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE):
    """Cut a batch between documents into parts of about `limit` bytes of text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(size)
    yield batch.slice(first)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run of non-blank bytes inside one document), and its document's place."""
    solid = ~BLANK[data]
    if not solid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are not empty, ordered and do not overlap."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    place = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum())) - np.repeat(place, lengths)
    at = within + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(BYTE[data[at]] * powers(int(lengths.max()) + 1)[within], place)
        return splitmix(sums + lengths.astype(U) * U(0x632BE59BD9B4E019))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes, wherever they start; len(hashes) - n + 1 of them."""
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += splitmix(hashes[k : len(hashes) - n + 1 + k] ^ U(0x51ED270B9F0C2A35 * (k + 1) & (1 << 64) - 1))
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 bytes, and the documents' offsets among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, count[offsets]


def fixed(column, dtype, width: int) -> np.ndarray:
    """A binary column whose values all hold `width` items, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def runs(batches, n: int):
    """Each run of rows that agree in the first n columns, which have no nulls, as one batch."""
    held: list[pa.RecordBatch] = []

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(n)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for k, c in enumerate(columns):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= not held or held[-1].column(k)[-1].as_py() != c[0]
        cuts = np.flatnonzero(new)
        if len(cuts) == 0 or cuts[0] > 0:
            held.append(batch.slice(0, cuts[0] if len(cuts) else batch.num_rows))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            if held:
                yield whole()
            held = [batch.slice(a, b - a)]
    if held:
        yield whole()
