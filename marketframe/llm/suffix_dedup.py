"""Removal of repeated byte strings by a hash-compared suffix sort.

Sorting every suffix of a corpus would move every byte position. Two passes leave only the
suffixes whose place in the order is open:

1. Every string of ``length`` bytes is assigned to the anchor inside it, the run of ``ANCHOR``
   bytes with the least hash (about one position in sixteen is an anchor; equal strings choose the
   same). An anchor's context is all the bytes of the strings assigned to it. Anchors meet in
   hash buckets (packed rows): where a whole context also stands in a document with a smaller id,
   all its strings go. Copies inside a slice of documents are settled before the shuffle.
2. What remains open are contexts that share an anchor and differ. Two equal strings that begin 15
   bytes or more before the anchor have the 15 bytes left of it in common, two others the 16 bytes
   right of it: only contexts that share a 12-bit hash of either with another document's may hold
   equal strings, which keeps out nearly all anchors that meet by chance (their share of all anchors
   grows with the table). The bytes of the others are sent, one row a context. Their suffixes are put into buckets by anchor and distance to it, and each bucket is
   sorted by quicksort. Two suffixes are compared by prefix polynomial hashes: binary search finds
   their common extension in logarithmic steps and the next byte decides. Neighbours in the order
   that agree on ``length`` bytes are verified byte by byte; if a hash collided, the order is made
   anew from the bytes. A string goes when an equal one stands in a document with a smaller id.
   Where more than ``HEAVY`` contexts of an anchor are open, its strings are sent one by one and
   dealt out by anchor, distance and a hash of all their bytes, which equal strings share; copies
   inside a slice are compared byte by byte and settled before the shuffle.

Texts are shuffled only for documents with an open context or a removed byte, compressed one by one.
What a pass leaves on disk follows the number of its entries: rows name only documents that have
entries in them, and the shuffle files of a pass are removed when its result is checkpointed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm import packing as pk
from marketframe.llm import textbytes as tb
from marketframe.llm.block_dedup import _slice_rows
from marketframe.llm.packing import Batches, Key
from marketframe.session import cut_released

LENGTH = 50            # bytes of a repeat
ANCHOR = 20            # bytes of an anchor
HEAVY = 4096           # open contexts of an anchor that meet in one group at most (some 6 KB each)
STEP = 1 << 15         # positions hashed at a time
ROW = 1000             # anchors of a packed row aimed at
HELD = 1 << 19         # anchors held for that at most (some 8 MB of text)
_SEED = 3


def _anchor_hash(prefix, inverse, at):
    """Hashes of the ``ANCHOR`` bytes at ``at``, positions or a slice of them."""
    after = slice(at.start + ANCHOR, at.stop + ANCHOR) if isinstance(at, slice) else at + ANCHOR
    return tb.mix((prefix[after] - prefix[at]) * inverse[at] + np.uint64(ANCHOR))


def _sides(prefix, at, lo, hi, length):
    """Hashes, from 1, of the bytes left of the anchor that its strings share which begin ``half`` bytes
    or more before it, and of those right of it that its other strings share; 0 where it has none."""
    half = (length - ANCHOR + 1) // 2
    left = tb.range_hash(prefix, np.maximum(at - half, 0), at)
    right = tb.range_hash(prefix, at + ANCHOR, np.minimum(at + length - half + 1, len(prefix) - 1))
    return tuple(np.where(some, (x >> np.uint64(32)) % np.uint64(4095) + np.uint64(1), np.uint64(0)).astype(np.uint16)
                 for x, some in ((left, at - lo >= half), (right, at - hi < half)))


def anchors(data: np.ndarray, off: np.ndarray, length: int, sides: bool = False):
    """(document, anchor, first and last start of its strings, anchor hash, context hash), all
    positions in ``data``; with ``sides`` also the hashes of the bytes beside it."""
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2 + (np.uint16,) * 2 * sides)
    if len(data) < length:
        return none
    prefix = tb.prefix_hash(tb._letters(_SEED)[data])
    inverse = tb._powers(len(prefix))[1]
    bits = np.uint64(len(data).bit_length())
    low, width = (np.uint64(1) << bits) - np.uint64(1), length - ANCHOR + 1
    place = np.empty(len(data) - length + 1, np.int64)
    for a in range(0, len(place), STEP):                    # some positions at a time stay in the cache
        b = min(a + STEP, len(place))
        h = _anchor_hash(prefix, inverse, slice(a, b + width - 1))
        least = pk.sliding_min((h & ~low) | np.arange(a, b + width - 1, dtype=np.uint64), width)
        place[a:b] = least & low
    size = np.diff(off)
    n = np.maximum(size - length + 1, 0)                    # strings of each document
    new = pk.first_of_runs(place)
    new[off[:-1][off[:-1] < len(place)]] = True
    new &= np.repeat(np.tile([True, False], len(n)), np.column_stack([n, size - n]).ravel())[:len(place)]
    lo = np.flatnonzero(new)
    if not len(lo):
        return none
    doc, spot = tb.owner(off, lo), place[lo]
    hi = np.minimum(np.append(lo[1:], len(place)) - 1, off[1:][doc] - length)
    context = tb.mix(tb.range_hash(prefix, lo, hi + length) + (spot - lo).astype(np.uint64))
    beside = _sides(prefix, spot, lo, hi, length) if sides else ()
    return doc, spot, lo, hi, _anchor_hash(prefix, inverse, spot), context, *beside


_PACKED = "bucket int, docs binary, at binary, settled binary, anchor binary, context binary, sides binary"


def _pack(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    def rows(held):
        """One row a bucket of the anchors of some slices."""
        first = np.cumsum([0] + [len(x[0]) for x in held])
        ids, marks, at, h, c, left, right = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3, 4, 5, 6, 7))
        doc = np.concatenate([x[2] + n for x, n in zip(held, first)])
        own = ids[doc]
        order = np.lexsort((own, c, h))
        own = own[order]
        smallest = own[_heads(pk.first_of_runs(h[order], c[order]))]
        later = np.zeros(len(at), bool)
        later[order] = own > smallest
        out = []
        for b, e in pk.by_bucket((h >> np.uint64(32)) % np.uint64(buckets), buckets):
            x = e[~later[e]]
            out.append((b, *pk.entry_table(ids, marks, doc[e], at[e]), np.packbits(later[e]).tobytes(),
                        (h[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), _low(c[x], 6),
                        _low(left[x] | right[x].astype(np.uint64) << np.uint64(12), 3)))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 6))],
                                          ["bucket", "docs", "at", "settled", "anchor", "context", "sides"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in tb.slices(batch):
                data, off = tb.text_bytes(part.column("text"))
                doc, at, _, _, h, c, left, right = anchors(data, off, length, sides=True)
                if not len(at):
                    continue
                held.append((*_slice_rows(part), doc, at - off[doc], h, c, left, right))
                n += len(at)
                if n >= min(HELD, ROW * buckets):
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    return docs.mapInArrow(run, _PACKED)


def _heads(new: np.ndarray) -> np.ndarray:
    """For every entry the index of its run's first entry."""
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _low(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of every number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unlow(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _met(key, doc):
    """True for entries whose key (any order) entries of more than one document have."""
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(pk.first_of_runs(key[order]))
    out = np.zeros(len(key), bool)
    if len(key):
        low, high = (f.reduceat(doc[order], head) for f in (np.minimum, np.maximum))
        out[order] = np.repeat(low < high, np.diff(np.append(head, len(key))))
    return out


_JUDGED = "part int, docs binary, at binary, kind binary"


def _judge(packed: DataFrame, buckets: int, heavy: int) -> DataFrame:
    """Anchors whose strings go (kind 0) or whose context is open (1, or 3 where more than ``heavy``
    of the anchor's are), packed by a hash of the document's id."""
    def meet(key: Key, batches: Batches) -> Batches:
        A, C, L, R, D, M, P, gone = [], [], [], [], [], [], [], []
        for batch in batches:
            for docs, at, settled, a, c, s in zip(*(batch.column(n).to_pylist() for n in (
                    "docs", "at", "settled", "anchor", "context", "sides"))):
                entries = pk.read_entries(docs, at)
                later = np.unpackbits(np.frombuffer(settled, np.uint8), count=len(entries[0])).astype(bool)
                for out, v in zip((D, M, P), entries):
                    out.append(v[~later])
                gone.append([v[later] for v in entries])
                A.append(np.frombuffer(a, np.uint32))
                C.append(_unlow(c, 6))
                sides = _unlow(s, 3)
                L.append((sides & np.uint64(4095)).astype(np.int16))
                R.append((sides >> np.uint64(12)).astype(np.int16))
        A, C, L, R, D, M, P = map(np.concatenate, (A, C, L, R, D, M, P))
        order = np.lexsort((D, C, A))
        A, C, L, R, D, M, P = (x[order] for x in (A, C, L, R, D, M, P))
        new_a = pk.first_of_runs(A)
        new_c = pk.first_of_runs(A, C)
        goes = D > D[_heads(new_c)]
        run = np.cumsum(new_a) - 1
        low, high = (f.reduceat(D, np.flatnonzero(new_a)) if len(D) else D for f in (np.minimum, np.maximum))
        contexts = np.bincount(run[new_c], minlength=len(low)) if len(D) else D
        maybe = ~goes & ((contexts > 1) & (low < high))[run]
        open_ = np.zeros(len(D), bool)
        for side in (L, R):
            x = np.flatnonzero(maybe & (side > 0))
            open_[x[_met(run[x] * 4096 + side[x], D[x])]] = True
        out = goes | open_
        many = (np.bincount(run, weights=open_, minlength=len(low)) > heavy)[run]
        kind = 2 * (open_ & many) + open_
        D, M, P, kind = (np.concatenate([x[out], *g]) for x, g in zip(
            (D, M, P, kind), (*zip(*gone), [np.zeros(len(g[0]), kind.dtype) for g in gone])))
        order = np.lexsort((P, M, D))
        D, M, P, kind = D[order], M[order], P[order], kind[order].astype(np.uint8)
        head = pk.first_of_runs(D, M)
        ids, marks, doc = D[head], M[head], np.cumsum(head) - 1
        rows = [(b, *pk.entry_table(ids, marks, doc[e], P[e]), kind[e].tobytes())
                for b, e in pk.by_bucket(tb.mix(D.view(np.uint64)) % np.uint64(buckets), buckets)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                                             ["part", "docs", "at", "kind"])

    return packed.groupBy("bucket").applyInArrow(meet, _JUDGED)


def _by_document(judged: DataFrame) -> DataFrame:
    """(doc_id, mark, settled, open, heavy): positions of anchors by their kind."""
    def meet(key: Key, batches: Batches) -> Batches:
        found = [(*pk.read_entries(docs, at), np.frombuffer(kind, np.uint8)) for batch in batches
                 for docs, at, kind in zip(*(batch.column(n).to_pylist() for n in ("docs", "at", "kind")))]
        D, M, P, K = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((P, M, D))
        D, M, P, K = (x[order] for x in (D, M, P, K))
        head = pk.first_of_runs(D, M)
        doc, n = np.cumsum(head) - 1, int(head.sum())
        lists = []
        for kind in (0, 1, 3):
            x = np.flatnonzero(K == kind)
            ends = np.append(0, np.cumsum(np.bincount(doc[x], minlength=n)))
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(P[x], pa.int32())))
        table = pa.RecordBatch.from_arrays([pa.array(D[head]), pa.array(M[head]), *lists],
                                           ["doc_id", "mark", "settled", "open", "heavy"])
        for i in range(0, n, tb.BATCH_ROWS):
            yield table.slice(i, tb.BATCH_ROWS)

    return judged.groupBy("part").applyInArrow(meet, "doc_id long, mark int, settled array<int>, open array<int>, heavy array<int>")


def _texts(docs: DataFrame, wanted) -> DataFrame:
    """(doc_id, mark, n_bytes, text) of the rows whose id passes the filter, texts compressed."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(pk.passes(wanted, batch.column("cell"))))
            text = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pc.binary_length(text).cast(pa.int64()), pk.zipped(text)],
                ["doc_id", "mark", "n_bytes", "text"])

    cells = docs.select("doc_id", "mark", "text", pk.filter_cell(F.col("doc_id")).alias("cell"))
    return cells.mapInArrow(run, "doc_id long, mark int, n_bytes long, text binary")


_CONTEXT = "bucket int, anchor long, doc_id long, mark int, lo int, reach int, bytes binary"


def _heavy_strings(data, off, ids, lo, hi, spot, h, length):
    """The strings of contexts of heavy anchors: (start, context, dealing hash, settled), settled
    where an equal string stands in a document of the slice with a smaller id."""
    n = hi - lo + 1
    ctx = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n) + lo[ctx]
    prefix = tb.prefix_hash(tb._letters(_SEED)[data])
    key = tb.mix(tb.mix(h[ctx] + (spot[ctx] - start).astype(np.uint64)) ^ tb.range_hash(prefix, start, start + length))
    own = ids[tb.owner(off, start)]
    order = np.lexsort((own, key))
    head = order[_heads(pk.first_of_runs(key[order]))] if len(order) else order
    later = np.flatnonzero(own[order] > own[head])
    settled = np.zeros(len(start), bool)
    if len(later):
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        for i in range(0, len(later), 100_000):
            x = later[i:i + 100_000]
            settled[order[x]] = (view[start[order[x]]] == view[start[head[x]]]).all(axis=1)
    return start, ctx, key, settled


def _open_contexts(spots: DataFrame, length: int, buckets: int) -> DataFrame:
    """One row for every open context, or for every string of a heavy anchor's open contexts, whose
    dealing hash then stands for the anchor, so that it is sorted with its equals only; without
    bytes, ``reach + 1`` settled strings from ``lo`` on. ``spots``: doc_id, mark, n_bytes, text
    (compressed), open and heavy (anchor positions)."""
    def run(batches):
        for batch in batches:
            for part in pk.unzipped(batch):
                data, off = tb.text_bytes(part.column("text"))
                doc, at, lo, hi, h, _ = anchors(data, off, length)
                ids, marks = _slice_rows(part)
                raw = data.tobytes()

                def chosen(name):
                    size = part.column(name).value_lengths().to_numpy().astype(np.int64)
                    return np.flatnonzero(np.isin(at, np.repeat(off[:-1], size) + part.column(name).flatten().to_numpy()))

                def rows(deal, anchor, begin, reach, pieces):
                    d = tb.owner(off, begin)
                    return pa.RecordBatch.from_arrays(
                        [pa.array((deal % np.uint64(buckets)).astype(np.int32)), pa.array(anchor.view(np.int64)),
                         pa.array(ids[d]), pa.array(marks[d]), pa.array((begin - off[d]).astype(np.int32)),
                         pa.array(reach.astype(np.int32)), pa.array(pieces, pa.binary())],
                        ["bucket", "anchor", "doc_id", "mark", "lo", "reach", "bytes"])

                x = chosen("open")
                yield rows(h[x] >> np.uint64(32), h[x], lo[x], at[x] - lo[x],
                           [raw[a:b + length] for a, b in zip(lo[x], hi[x])])
                x = chosen("heavy")
                if not len(x):
                    continue
                start, ctx, key, settled = _heavy_strings(data, off, ids, lo[x], hi[x], at[x], h[x], length)
                e = np.flatnonzero(~settled)
                for i in range(0, len(e), 50_000):
                    y = e[i:i + 50_000]
                    yield rows(key[y], key[y], start[y], at[x][ctx[y]] - start[y], [raw[a:a + length] for a in start[y]])
                y = np.flatnonzero(settled)
                head = np.flatnonzero(pk.first_of_runs(ctx[y], start[y] - np.arange(len(y))))
                size = np.diff(np.append(head, len(y)))
                y = y[head]
                yield rows(key[y], h[x][ctx[y]], start[y], size - 1, [b""] * len(y))

    return spots.mapInArrow(run, _CONTEXT)


class Suffixes:
    """Suffixes of one byte string, compared on their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = tb.prefix_hash(tb._letters(_SEED)[data])
        self.powers, self.inverse = tb._powers(len(self.prefix))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` have in common, up to ``length``, by binary
        search on the hashes of their prefixes."""
        pa_, pb, ratio = self.prefix[a], self.prefix[b], self.inverse[a] * self.powers[b]
        out = np.full(len(a), self.length)
        open_ = np.flatnonzero((self.prefix[a + self.length] - pa_) * ratio != self.prefix[b + self.length] - pb)
        a, b, pa_, pb, ratio = (x[open_] for x in (a, b, pa_, pb, ratio))
        n, step = np.zeros(len(a), np.int64), 1 << (self.length - 1).bit_length() >> 1
        while step:
            more = np.minimum(n + step, self.length - 1)
            n = np.where((self.prefix[a + more] - pa_) * ratio == self.prefix[b + more] - pb, more, n)
            step >>= 1
        out[open_] = n
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair."""
        n = self.common(a, b)
        here = np.minimum(n, self.length - 1)
        x, y = self.data[a + here].astype(np.int16), self.data[b + here].astype(np.int16)
        return np.where(n == self.length, 0, np.sign(x - y))

    def sorted(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``at`` with every bucket (``first`` holds the buckets' begins and the end) put into
        suffix order by quicksort, equal suffixes in their order; all open parts of all buckets are
        split together. A part falls into the suffixes before, equal to and after one of its own, and
        only those before and after it stay open."""
        at = at.copy()
        size = np.diff(first)
        begin, size = first[:-1][size > 1], size[size > 1]
        turn = 0
        while len(size):
            part = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(part)) + np.repeat(begin - np.cumsum(size) + size, size)
            turn += 1
            pivot = at[begin + (tb.mix(begin.astype(np.uint64) + np.uint64(turn)) % size.astype(np.uint64)).astype(np.int64)]
            here = at[place]
            side = 3 * part + 1 + self.compare(here, pivot[part])
            at[place] = here[np.argsort(side, kind="stable")]
            count = np.bincount(side, minlength=3 * len(size)).reshape(-1, 3)
            begin = np.column_stack([begin, begin + size - count[:, 2]]).ravel()
            size = count[:, ::2].ravel()
            begin, size = begin[size > 1], size[size > 1]
        return at

    def equal_neighbours(self, at: np.ndarray) -> np.ndarray:
        """True where an item agrees with the one before on ``length`` bytes."""
        out = np.zeros(len(at), bool)
        out[1:] = self.common(at[1:], at[:-1]) == self.length
        return out

    def verified(self, at: np.ndarray, same: np.ndarray) -> bool:
        """Compares the bytes behind every agreement of hashes."""
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        hit = np.flatnonzero(same)
        return all((view[at[hit[i:i + 100_000]]] == view[at[hit[i:i + 100_000] - 1]]).all()
                   for i in range(0, len(hit), 100_000))


def _removed(anchor, doc, reach, blob, begin, size, length):
    """(context, start) of the strings that an equal one in a smaller document removes."""
    n = size - length + 1
    ctx = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
    bucket = np.unique(anchor, return_inverse=True)[1][ctx] * length + (reach[ctx] - start)
    order = np.argsort(bucket, kind="stable")
    ctx, start, bucket = ctx[order], start[order], bucket[order]
    first = np.append(np.flatnonzero(pk.first_of_runs(bucket)), len(bucket))
    low, high = (f.reduceat(doc[ctx], first[:-1]) if len(ctx) else ctx for f in (np.minimum, np.maximum))
    keep = np.repeat(low < high, np.diff(first))            # other buckets belong to one document
    ctx, start, bucket = ctx[keep], start[keep], bucket[keep]
    if not len(ctx):
        return ctx, start
    first = np.append(np.flatnonzero(pk.first_of_runs(bucket)), len(bucket))
    s = Suffixes(blob, length)
    at = begin[ctx] + start
    item = np.full(len(blob), -1)
    item[at] = np.arange(len(at))
    ranked = s.sorted(at, first)
    same = s.equal_neighbours(ranked)
    same[first[:-1]] = False
    if not s.verified(ranked, same):                          # a hash collided: order by the bytes
        raw = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(blob, length)[at]).view(f"V{length}").ravel()
        code = np.unique(raw, return_inverse=True)[1]
        ranked = at[np.lexsort((code, np.repeat(np.arange(len(first) - 1), np.diff(first))))]
        same = np.zeros(len(at), bool)
        same[1:] = code[item[ranked[1:]]] == code[item[ranked[:-1]]]
        same[first[:-1]] = False
    here = item[ranked]
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc[ctx[here]], head)
    gone = here[doc[ctx[here]] > np.repeat(least, np.diff(np.append(head, len(here))))]
    return ctx[gone], start[gone]


def _sort_open(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, lo, hi): runs of removed strings, first and last start."""
    def meet(key: Key, batches: Batches) -> Batches:
        table = pa.Table.from_batches(list(batches)).sort_by("anchor").combine_chunks()     # equals stand near
        column = lambda n: table.column(n).to_numpy()
        blob, ends = tb.text_bytes(table.column("bytes").chunk(0))
        doc, mark, lo, reach = column("doc_id"), column("mark"), column("lo"), column("reach")
        given = np.flatnonzero(np.diff(ends))                   # the others are settled
        ctx, start = _removed(column("anchor")[given], doc[given], reach[given], blob, ends[:-1][given],
                              np.diff(ends)[given], length)
        ctx = given[ctx]
        order = np.lexsort((start, ctx))
        ctx, start = ctx[order], start[order]
        head = np.flatnonzero(pk.first_of_runs(ctx, start - np.arange(len(start))))
        last = np.append(head[1:], len(start)) - 1 if len(head) else head
        done = np.flatnonzero(np.diff(ends) == 0)
        row = np.append(ctx[head], done)
        low = np.append(lo[ctx[head]] + start[head], lo[done])
        high = np.append(lo[ctx[head]] + start[last], lo[done] + reach[done])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(mark[row]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
            ["doc_id", "mark", "lo", "hi"])

    return contexts.groupBy("bucket").applyInArrow(meet, "doc_id long, mark int, lo int, hi int")


def _spots(docs: DataFrame, length: int, buckets: int, heavy: int) -> DataFrame:
    """(doc_id, mark, settled, open, heavy): positions of anchors all of whose strings go, of open
    ones and of open ones of heavy anchors."""
    return cut_released(_by_document(_judge(_pack(docs, length, buckets), buckets, heavy)))


def _sent(docs: DataFrame, spots: DataFrame, length: int, buckets: int) -> DataFrame:
    """What the second pass sends."""
    left = spots.where((F.size("open") > 0) | (F.size("heavy") > 0)).select("doc_id", "mark", "open", "heavy")
    texts = _texts(docs, pk.id_filter(left.select("doc_id"))).join(left, ["doc_id", "mark"])
    return _open_contexts(texts, length, buckets)


def find_repeats(docs: DataFrame, length: int = LENGTH, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, mark, settled, runs) of documents with strings that also start in a document with
    a smaller id: anchors all of whose strings go, and runs of starts that the sort found."""
    docs = docs.where(F.col("doc_id").isNotNull())
    buckets = pk.n_buckets(docs)
    split = _spots(docs, length, buckets, heavy)
    runs = _sort_open(_sent(docs, split, length, buckets), length)
    runs = runs.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    settled = split.where(F.size("settled") > 0).select("doc_id", "mark", "settled")
    return settled.join(runs, ["doc_id", "mark"], "full")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs(doc_id long, text)``: n_bytes, n_removed, n_spans (maximal removed
    runs) and kept_sha256 of the remaining bytes; ``with_text`` adds them as ``kept``.

    Removed is each byte of the UTF-8 text covered by a string of ``length`` bytes that also starts
    in a document with a smaller doc_id. Null text is empty. Rows without an id neither lose bytes
    nor count for others; rows that share an id are one document; other columns are ignored; an
    empty table gives an empty result."""
    marked = pk.with_mark(docs)
    found = cut_released(find_repeats(marked, length, heavy))
    wanted = pk.id_filter(found.select("doc_id"))
    base = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def first_pass(batches):
        """Digests of documents that lose nothing; the text stays for the others only."""
        for batch in batches:
            maybe = pk.passes(wanted, batch.column("cell"))
            sha = [None if m else hashlib.sha256(t).hexdigest()
                   for m, t in zip(maybe, batch.column("text").cast(pa.binary()).to_pylist())]
            text = pc.if_else(pa.array(maybe | with_text), batch.column("text"), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pc.binary_length(batch.column("text")).cast(pa.int64()),
                 pa.array(sha, pa.string()), pk.zipped(text)], ["doc_id", "mark", "n_bytes", "kept_sha256", "text"])

    def second_pass(batches):
        for batch in batches:
            for part in pk.unzipped(batch):
                data, off = tb.text_bytes(part.column("text"))
                settled = part.column("settled")
                edge = np.zeros(len(data) + 1, np.int64)
                count = pc.fill_null(settled.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                if count.any():
                    _, at, lo, hi, _, _ = anchors(data, off, length)
                    x = np.isin(at, np.repeat(off[:-1], count) + settled.flatten().to_numpy())
                    np.add.at(edge, lo[x], 1)
                    np.add.at(edge, hi[x] + length, -1)
                for begin, runs in zip(off[:-1], part.column("runs").to_pylist()):
                    for r in runs or ():
                        edge[begin + r["lo"]] += 1
                        edge[begin + r["hi"] + length] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                rows = []
                for i, (d, n, sha) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "kept_sha256")))):
                    a, b = off[i], off[i + 1]
                    g = gone[a:b]
                    kept = data[a:b][~g].tobytes() if sha is None or with_text else b""
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    rows.append((d, n, int(g.sum()), spans, sha or hashlib.sha256(kept).hexdigest(), kept)[:len(names)])
                if rows:
                    kinds = (*[pa.int64()] * 4, pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

    cells = marked.withColumn("cell", F.coalesce(pk.filter_cell(F.col("doc_id")), F.lit(0)).cast("long"))
    done = cells.mapInArrow(first_pass, "doc_id long, mark int, n_bytes long, kept_sha256 string, text binary")
    return done.join(found, ["doc_id", "mark"], "left").mapInArrow(second_pass, base + ", kept binary" * with_text)
