"""Packed shuffles for operators that send one small entry a word or byte position.

Entries of a slice of documents that go to the same bucket travel in one row: a table of the
slice's documents (id, mark, length), the entries' hashes as raw numbers and their positions as
gaps in byte planes (which Spark's shuffle compression reduces to about a byte an entry).
Also a filter of fixed size over document ids, used to keep texts out of a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.textbytes import SLICE_BYTES, small_batches

Key = Tuple[pa.Scalar, ...]
Batches = Iterator[pa.RecordBatch]


def planes(values: np.ndarray, width: int = 4) -> bytes:
    """Non-negative numbers as ``width`` planes of bytes, lowest first."""
    raw = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    return np.ascontiguousarray(raw.T).tobytes()


def unplanes(raw: bytes, width: int = 4) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(rows.T).reshape(-1).view(f"<u{width}").astype(np.int64)


def gaps(at: np.ndarray) -> bytes:
    """Rising positions."""
    return planes(np.diff(at, prepend=0))


def ungaps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw))


def doc_table(ids: np.ndarray, marks: np.ndarray, first: np.ndarray) -> bytes:
    """Ids (any int64), marks (int32) and item counts of a slice's documents."""
    n = np.array([len(ids)], np.int64).tobytes()
    step = np.diff(ids.astype(np.int64), prepend=np.int64(0)).view(np.uint64)
    return n + planes(step, 8) + marks.astype(np.int32).tobytes() + planes(np.diff(first))


def read_doc_table(raw: bytes):
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    a, b = 8 + 8 * n, 8 + 12 * n
    ids = np.cumsum(unplanes(raw[8:a], 8).astype(np.int64))
    return ids, np.frombuffer(raw[a:b], np.int32), np.concatenate([[0], np.cumsum(unplanes(raw[b:]))])


def entry_table(ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """(documents, positions) of entries: ``doc``, rising, says which of ``ids`` and ``marks`` an entry
    is of; ``at``, rising in each document, where it stands. Holds only documents that have entries,
    so its size follows theirs, however many buckets a slice is dealt out over."""
    head = np.flatnonzero(first_of_runs(doc))
    gap = np.diff(at, prepend=0)
    gap[head] = at[head]
    return doc_table(ids[doc[head]], marks[doc[head]], np.append(head, len(doc))), planes(gap)


def read_entries(docs: bytes, at: bytes):
    """(id, mark, position) of every entry."""
    ids, marks, first = read_doc_table(docs)
    gap, size = unplanes(at), np.diff(first)
    total = np.cumsum(gap)
    return np.repeat(ids, size), np.repeat(marks, size), total - np.repeat((total - gap)[first[:-1]], size)


def by_bucket(bucket: np.ndarray, n: int):
    """(bucket, indices of its entries in their order) for every bucket that has some."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), order[ends[b]:ends[b + 1]]


def n_buckets(docs: DataFrame) -> int:
    """One bucket a shuffle partition: the session's setting follows the size of the data."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_mark(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): the mark tells apart rows that share an id but not the text."""
    return small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.coalesce("text", F.lit(""))).alias("mark"),
        F.coalesce("text", F.lit("")).alias("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


# ------------------------------------------------------------------ texts in a shuffle
def zipped(texts: pa.Array) -> pa.Array:
    """Every text compressed by itself: a shuffle's own compression leaves about two thirds of short texts."""
    codec = pa.Codec("zstd", compression_level=1)
    return pa.array([None if t is None else codec.compress(t, asbytes=True)
                     for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unzipped(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Batches:
    """Slices of ``batch`` with the texts restored, at most ``limit`` bytes of text (or one row) in each;
    ``n_bytes`` has the texts' lengths. Null texts become empty."""
    codec = pa.Codec("zstd")
    text, place = batch.column("text"), batch.schema.get_field_index("text")
    size = np.where(text.is_valid().to_numpy(zero_copy_only=False), batch.column("n_bytes").to_numpy(), 0)
    total = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        raw = b"".join(codec.decompress(t, int(n), asbytes=True) if n else b""
                       for t, n in zip(text.slice(start, stop - start).to_pylist(), size[start:stop]))
        off = pa.py_buffer((total[start:stop + 1] - total[start]).astype(np.int64).tobytes())
        texts = pa.Array.from_buffers(pa.large_binary(), stop - start, [None, off, pa.py_buffer(raw)])
        yield batch.slice(start, stop - start).set_column(place, "text", texts)
        start = stop


def first_of_runs(*columns) -> np.ndarray:
    """True where any of the (sorted) columns differs from the entry before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbours (by doubling)."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[:len(x) - (width - span)], x[width - span:])


# ------------------------------------------------------------------ filter of fixed size
FILTER_BITS = 23       # 1 MB, whatever the table's size


def filter_cell(ident: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(ident), 64 - FILTER_BITS)


def id_filter(ids: DataFrame):
    """Bitmap over the hashed values of the only column of ``ids``: no false negatives. With very
    many ids it lets more rows through, which costs shuffle and changes no result."""
    cell = filter_cell(F.col(ids.columns[0]))
    bits = ids.select(cell.alias("c")).distinct().select(
        F.expr("cast(c div 65536 as int)").alias("part"), F.expr("cast(c % 65536 as int)").alias("bit"))

    def pack(key: Key, batches: Batches) -> Batches:
        on = np.zeros(65536, np.uint8)
        for batch in batches:
            on[batch.column("bit").to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()),
                                          pa.array([np.packbits(on).tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in bits.groupBy("part").applyInArrow(pack, "part int, bits binary").collect():
        out[r.part * 8192:(r.part + 1) * 8192] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out)


def passes(bits, cells) -> np.ndarray:
    """Rows whose cell is set."""
    return np.unpackbits(bits.value).astype(bool)[cells.to_numpy()]
