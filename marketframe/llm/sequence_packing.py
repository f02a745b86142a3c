"""Hierarchical packing of documents into token contexts of several lengths.

A document is its BPE ids and an end id. Documents of a group (about ``GROUP_TOKENS`` tokens, packed
by one task) are routed and packed as follows:

1. Whole windows of the longest context are cut off long documents. What is left of a document is
   routed to the tier of the shortest context that holds it.
2. Tiers are packed from long to short. A window starts with the longest document of its tier; since
   it fills more than half of it, the gap is filled from shorter tiers: the longest document that
   fits, again and again, and when none fits, a piece cut off the shortest one that is longer.
3. The last window of a group, if it is not full, is dealt out over contexts of the powers of two
   that make it up. So every context is full and nothing is padded.
4. Contexts are dealt out over training steps of about ``step_tokens`` tokens: those of one length in
   turn, each length starting where the one before ended, so that steps agree in tokens and in the
   mix of lengths up to one context of each length.

Texts stay in the task that reads them; only pieces are written. Tokens are counted and cut, never
dropped, and no piece of a document lies in two contexts.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from marketframe.llm.bpe import LONG_TEXT, codec, default_vocabulary, long_runs
from marketframe.llm.textbytes import small_batches
from marketframe.session import cut_lineage

TIERS = (2048, 1024, 512, 256)
END_ID = 1
GROUP_TOKENS = 1 << 22
STEP_TOKENS = 1 << 18
#: Sequence ids are (partition, group of the partition, sequence of the group) in one long.
_GROUP_BITS, _SEQUENCE_BITS = 18, 24


class Pool:
    """Pieces by length; the non-empty lengths are the bits of one number."""

    def __init__(self, top: int):
        self.lists = [[] for _ in range(top + 1)]
        self.mask = 0

    def add(self, length: int, piece) -> None:
        self.lists[length].append(piece)
        self.mask |= 1 << length

    def take(self, length: int):
        found = self.lists[length]
        piece = found.pop()
        if not found:
            self.mask &= ~(1 << length)
        return piece

    def longest(self, limit: int) -> int:
        """Greatest length up to ``limit``, 0 if there is none."""
        return max(0, (self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1)

    def shortest_over(self, limit: int) -> int:
        """Least length over ``limit``, 0 if there is none."""
        rest = self.mask >> (limit + 1)
        return limit + 1 + (rest & -rest).bit_length() - 1 if rest else 0


def tail_contexts(pieces: list[tuple[int, int, int]]):
    """Pieces (document, start, length) of a window that is not full, dealt out over contexts of the
    powers of two of its size, the longest first: lists of pieces."""
    size = sum(p[2] for p in pieces)
    rest = list(reversed(pieces))
    for power in (1 << b for b in reversed(range(size.bit_length())) if size >> b & 1):
        out, room = [], power
        while room:
            doc, start, length = rest.pop()
            part = min(room, length)
            out.append((doc, start, part))
            if part < length:
                rest.append((doc, start + part, length - part))
            room -= part
        yield out


def pack_group(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Contexts of a group of documents of the given sizes, each a list of (document, start, length)."""
    tiers = sorted(tiers, reverse=True)
    top = tiers[0]
    pool, out = Pool(top), []
    for doc, n in enumerate(sizes):
        whole = n // top * top
        out += [[(doc, s, top)] for s in range(0, whole, top)]
        if n > whole:
            pool.add(n - whole, (doc, whole))
    while pool.mask:
        length = pool.longest(top)
        context = next(t for t in reversed(tiers) if t >= length)
        window, gap = [(*pool.take(length), length)], context - length
        while gap and pool.mask:
            length = pool.longest(gap)
            if length:
                window.append((*pool.take(length), length))
            else:                                   # all that is left is longer than the gap
                length = pool.shortest_over(gap)
                doc, start = pool.take(length)
                pool.add(length - gap, (doc, start + gap))
                window.append((doc, start, gap))
                length = gap
            gap -= length
        out += [window] if not gap else list(tail_contexts(window))
    return out


_PIECES = ("start long, length long, ids_crc32 long, doc_tokens long, grp long, local long, offset long, "
           "context long, nth long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID,
                   tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
                   group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32 (of the piece's ids as
    little-endian uint32), doc_tokens (with the end id), sequence_id, offset in the sequence,
    context (the sequence's length) and step; ``with_ids`` adds the ids.

    ``tiers`` are powers of two. Null text is the empty text: its end id alone is packed. Every input
    row is a document, repeated rows, rows that share an id and rows without an id (null doc_id)
    too. Other columns are ignored, whatever their names; an empty table gives an empty result.
    Sequence ids are unique, not dense."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_PIECES}" + (", ids array<long>" if with_ids else "")
    target = to_arrow_schema(_parse_datatype_string(schema))
    source = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        c = codec(path)
        partition, done = TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0

        def flush():
            contexts = pack_group([len(x) for x in ids], tiers)
            rows = [(d, s, n, k) for k, window in enumerate(contexts) for d, s, n in window]
            doc, start, length, local = np.array(rows, np.int64).T
            size = np.array([sum(p[2] for p in w) for w in contexts], np.int64)
            nth = np.zeros(len(size), np.int64)     # number among the group's contexts of its length
            for value in np.unique(size):
                nth[size == value] = np.arange((size == value).sum())
            first = np.searchsorted(local, local)
            before = np.cumsum(length) - length
            parts = [ids[d][s:s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            columns = [pa.array([names[d] for d in doc.tolist()], target.field("doc_id").type)]
            columns += [pa.array(v, pa.int64()) for v in (
                start, length, [zlib.crc32(p.tobytes()) for p in parts], [len(ids[d]) for d in doc.tolist()],
                np.full(len(doc), (partition << _GROUP_BITS) + done), local, before - before[first], size[local],
                nth[local])]
            if with_ids:
                columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, schema=target)

        for batch in batches:
            for name, text, long_run in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                            long_runs(batch.column("text")).tolist()):
                text = text.as_py()
                found = c.encode(text, long_run) if len(text) <= LONG_TEXT else c.encode_pieces(text).ids
                names.append(name)
                ids.append(np.append(found, np.array([end_id], "<u4")).astype("<u4"))
                held += len(ids[-1])
                if held >= group_tokens:
                    yield flush()
                    done += 1
                    names, ids, held = [], [], 0
        if ids:
            yield flush()

    pieces = cut_lineage(source.mapInArrow(pack, schema))
    # one row a group and length: how many contexts of the length the groups before have
    per = pieces.where("offset = 0").groupBy("grp", "context").agg(F.count("*").alias("n"))
    before = per.select("grp", "context", (F.sum("n").over(
        Window.partitionBy("context").orderBy("grp")) - F.col("n")).alias("before"))
    steps, turn = 1, {}
    lengths = sorted(per.groupBy("context").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r.context)
    steps = max(1, -(-sum(r.context * r.n for r in lengths) // step_tokens))
    done = 0
    for r in lengths:                               # a power of two each: a few dozen at most
        turn[r.context] = done
        done += r.n
    shift = F.coalesce(*(F.when(F.col("context") == c, F.lit(t)) for c, t in turn.items()), F.lit(0))
    out = pieces.join(before, ["grp", "context"]).withColumn(
        "step", (F.col("before") + F.col("nth") + shift) % steps)
    sequence = F.shiftleft("grp", _SEQUENCE_BITS) + F.col("local")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset",
                      "context", "step", *(["ids"] if with_ids else []))
