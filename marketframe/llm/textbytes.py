"""Vectorised word and byte hashing over Arrow string columns.

The text operators run inside ``mapInArrow``: Spark partitions and shuffles the rows, and these
helpers turn the text column of a record batch into numpy arrays (word starts and ends, 64-bit
word hashes, rolling window hashes) without a Python loop over words.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``; a word never crosses a document. Null text
is the empty text. Batches are cut into slices of about ``SLICE_BYTES`` of text, so memory is
bounded by that or by the longest single document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SLICE_BYTES = 2 << 20
#: For operators that send nothing a slice: what a worker once needed stays with it, so smaller slices keep
#: its memory low.
SMALL_SLICE = 1 << 19
_U = np.uint64
#: Odd multiplier of the polynomial hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)


#: Rows of an Arrow batch at most. Documents are long: Spark's default of 10,000 rows is some 35 MB
#: of average text in the JVM and again in each Python worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs):
    """Lowers the session's Arrow batch size to ``BATCH_ROWS``, if it is larger; returns ``docs``."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return docs


def slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Zero-copy row slices of ``batch`` holding at most ``limit`` bytes of text (or one row)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; document ``i`` is ``bytes[offsets[i]:offsets[i+1]]``."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(column.buffers()[1], kind, len(column) + 1,
                        column.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8, off[-1] - off[0], off[0]) if buf and off[-1] > off[0] \
        else np.zeros(0, np.uint8)
    return data, off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first): byte bounds of every word and, per document, its first word's index
    (``first`` has one entry more than there are documents)."""
    solid = ~_SPACE[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    begins[head] = solid[head]
    stops[tail] = solid[tail]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


_tables: dict = {}


def _powers(n: int):
    """BASE^i and BASE^-i modulo 2^64 for i < n, grown on demand and kept per worker."""
    have = _tables.get("p")
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES)
        out = []
        for b in (BASE, _INVERSE):
            a = np.full(n, b, _U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _tables["p"] = have = tuple(out)
    return have


@lru_cache(maxsize=8)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * BASE^i`` modulo 2^64, with a leading 0."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(len(values))[0][:len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of the values in [start, end), independent of the place they stand at."""
    inverse = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U))


# ------------------------------------------------------------------ hashes of words, lines and windows
# Polynomial hashes modulo 2^64 (above) let certain long texts collide, whatever the base. The ones
# below draw a random number for every (place, letter), and mix before they add what is longer.
CHUNK = 64
STEP_BYTES = 1 << 18
_MULTIPLIER = _U(0xD6E8FEB86659FD93)
_PLACE = _U(0xA0761D6478BD642F)


@lru_cache(maxsize=8)
def _places(seed: int) -> np.ndarray:
    """A random number for every letter at every place of a chunk."""
    return np.random.default_rng(seed).integers(0, 1 << 64, CHUNK * 256, dtype=_U)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the disjoint, rising byte runs [starts, ends). A chunk of 64 bytes is the sum
    of its letters' numbers, a run the sum of its mixed chunks; both depend on the place."""
    size = ends - starts
    chunks = -(-size // CHUNK)
    which = np.repeat(np.arange(len(size)), chunks)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = starts[which] + nth * CHUNK
    length = np.minimum(ends[which] - begin, CHUNK)
    sums, table = np.empty(len(which), _U), _places(seed)
    upto = np.cumsum(length)
    a = 0
    while a < len(which):                       # some bytes at a time, so that the arrays stay small
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - length[a] + STEP_BYTES, "right")))
        n = length[a:b]
        cut = np.cumsum(n) - n
        place = np.arange(cut[-1] + n[-1], dtype=np.int32) - np.repeat(cut.astype(np.int32), n)
        letters = data[np.repeat(begin[a:b], n) + place]
        sums[a:b] = np.add.reduceat(table[(place << 8) | letters], cut)
        a = b
    sums = mix(sums + (nth + 1).astype(_U) * _PLACE)
    out = np.zeros(len(size), _U)
    single = chunks == 1
    out[single] = sums[single[which]]
    np.add.at(out, which[~single[which]], sums[~single[which]])
    return mix(out + size.astype(_U))


def word_hashes(data, starts, ends, seed: int = 1) -> np.ndarray:
    return run_hashes(data, starts, ends, seed)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix(left * _MULTIPLIER + ((right << _U(23)) | (right >> _U(41))))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word indices at which a window of ``k`` words of one document starts."""
    n = int(first[-1])
    ok = np.ones(n, bool)
    last = np.repeat(first[1:], np.diff(first))
    ok &= np.arange(n) + k <= last
    return np.flatnonzero(ok)


def window_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` entries that start at ``at``: windows of doubling length are
    joined, the last two overlap."""
    h, span = words, 1
    while span * 2 <= k:
        h = joined(h[:-span], h[span:])
        span *= 2
    if span == k:
        return h[at]
    return joined(h[at], h[at + (k - span)])


def part_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short runs of entries, of any length from 1."""
    h, size = words[begin], end - begin
    for j in range(1, int(size.max(initial=1))):
        more = size > j
        h[more] = joined(h[more], words[begin[more] + j])
    return mix(h + size.astype(_U) * _PLACE)


def owner(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the document that holds item ``at``."""
    return np.searchsorted(first, at, "right") - 1
