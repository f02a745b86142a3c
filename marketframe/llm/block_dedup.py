"""Removal of repeated word passages by fixed-block anchors.

Documents are cut into non-overlapping reference blocks of ``window / 2`` words; any window of
``window`` words holds a whole one. The blocks' hashes are the index, and every rolling window of
a block's length probes it:

1. Probes and index entries meet in hash buckets (packed rows, about five bytes a probe). A hash
   is live when a block of one document is met by a probe of another. The probes of a bucket are
   dealt out over ``SALTS`` tasks, each of which gets the bucket's index entries, so that a block
   that very many documents hold does not meet in one task.
2. Hits are extended: every window around a live probe is compared with the windows around the
   other hits by an 80-bit hash. Windows are dealt out by the least hash of their short word runs,
   so neighbours travel together; where more than ``HEAVY`` windows have the same least hash (by
   the documents of one id in ``COUNTED``, which only decides the place), by their own hash, which
   equal windows share. Copies inside one slice of documents are settled before the shuffle. A window goes when its words also start in a document with a smaller id.
3. Runs of removed windows are united to maximal repeats and cut out of the texts.

Texts are shuffled only for documents with a live probe or a removed window.
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
from marketframe.llm.packing import Batches, Key
from marketframe.session import cut_lineage

WINDOW = 50            # words of a repeat
SALTS = 2              # tasks that share the probes of one bucket
RUN = 8                # words whose least hash deals out a window
HEAVY = 1 << 16        # windows with one least hash that meet in one group (some 100 bytes each)
COUNTED = 8            # one id in so many counts towards that


def _words(part, seeds=(1,)):
    data, off = tb.text_bytes(part.column("text"))
    starts, ends, first = tb.word_bounds(data, off)
    return [tb.word_hashes(data, starts, ends, s) for s in seeds], first


def _slice_rows(part):
    """Ids and marks of a slice."""
    return part.column("doc_id").to_numpy(), part.column("mark").to_numpy()


_PROBES = "bucket int, salt int, docs binary, full boolean, hash binary, at binary"


def _probe(docs: DataFrame, window: int, buckets: int, salts: int) -> DataFrame:
    block = window // 2

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch):
                (words,), first = _words(part)
                at = tb.window_starts(first, block)
                doc = tb.owner(first, at)
                at = at[np.diff(first)[doc] >= window]
                if not len(at):
                    continue
                doc = tb.owner(first, at)
                h = tb.window_hashes(words, at, block)
                index = (at - first[doc]) % block == 0
                ids, marks = _slice_rows(part)
                table = pk.doc_table(ids, marks, first)
                mine = int(ids[0]) % salts
                rows = []
                for b, e in pk.by_bucket((h >> np.uint64(32)) % np.uint64(buckets), buckets):
                    for salt in range(salts):
                        x = e if salt == mine else e[index[e]]
                        if len(x):
                            rows.append((b, salt, table, salt == mine, (h[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                                         pk.gaps(at[x])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.bool_(),
                                                                 pa.binary(), pa.binary()))],
                    ["bucket", "salt", "docs", "full", "hash", "at"])

    return docs.mapInArrow(run, _PROBES)


def _live(probes: DataFrame, window: int) -> DataFrame:
    """(doc_id, mark, pos) of the probes and blocks with a live hash."""
    block = window // 2

    def meet(key: Key, batches: Batches) -> Batches:
        H, D, M, P, X = [], [], [], [], []
        for batch in batches:
            for docs, full, h, at in zip(*(batch.column(n).to_pylist() for n in ("docs", "full", "hash", "at"))):
                ids, marks, first = pk.read_doc_table(docs)
                at = pk.ungaps(at)
                doc = tb.owner(first, at)
                H.append(np.frombuffer(h, np.uint32))
                D.append(ids[doc])
                M.append(marks[doc])
                P.append((at - first[doc]).astype(np.int32))
                X.append(np.full(len(at), full))
        H, D, M, P, X = map(np.concatenate, (H, D, M, P, X))
        index = np.unique(H[P % block == 0])
        if len(index):
            place = np.minimum(np.searchsorted(index, H), len(index) - 1)
            hit = np.flatnonzero(index[place] == H)
            place = place[hit]
            low, high = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min)
            np.minimum.at(low, place, D[hit])
            np.maximum.at(high, place, D[hit])
            out = hit[(low < high)[place]]
            yield pa.RecordBatch.from_arrays([pa.array(D[out]), pa.array(M[out]), pa.array(P[out])],
                                             ["doc_id", "mark", "pos"])

    return probes.groupBy("bucket", "salt").applyInArrow(meet, "doc_id long, mark int, pos int")


def _texts(docs: DataFrame, wanted) -> DataFrame:
    """The rows of ``docs`` whose id passes the filter."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(pk.passes(wanted, batch.column("cell")))).drop_columns(["cell"])

    cells = docs.select("doc_id", "mark", "text", pk.filter_cell(F.col("doc_id")).alias("cell"))
    return cells.mapInArrow(run, "doc_id long, mark int, text string")


_WINDOWS = "bucket int, docs binary, hash binary, more binary, at binary, settled binary"


def _around(part, first, n: int, window: int) -> np.ndarray:
    """Starts of the windows that hold a live probe, among ``n`` words."""
    live = part.column("live")
    size = live.value_lengths().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(part.num_rows), size)
    at = first[doc] + live.flatten().to_numpy()
    begin = np.maximum(at - window // 2, first[doc])
    stop = np.minimum(at, first[doc + 1] - window) + 1
    ok = begin < stop
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin[ok], 1)
    np.add.at(edge, stop[ok], -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _least(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The least hash of the short runs of every window."""
    short = tb.window_hashes(words, np.arange(len(words) - RUN + 1), RUN)
    return pk.sliding_min(short, window - RUN + 1)[at]


def _heavy(hits: DataFrame, window: int, heavy: int):
    """Least hashes, sorted, that more than ``heavy`` windows share by the count of one document in
    ``COUNTED``; at most one in ``heavy`` windows' number."""
    def run(batches):
        for batch in batches:
            for part in tb.slices(batch):
                (words,), first = _words(part)
                at = _around(part, first, len(words), window)
                if len(at):
                    least, n = np.unique(_least(words, at, window), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(n)], ["least", "n"])

    rows = hits.mapInArrow(run, "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    found = [r.least for r in rows.where(F.col("n") * COUNTED > heavy).select("least").collect()]
    return hits.sparkSession.sparkContext.broadcast(np.sort(np.array(found, np.int64).view(np.uint64)))


def _extend(hits: DataFrame, window: int, buckets: int, many) -> DataFrame:
    """Packed hashes of every window that holds a live probe; ``hits``: doc_id, mark, text, live;
    ``many``: the heavy least hashes."""
    def run(batches):
        for batch in batches:
            for part in tb.slices(batch):
                (words, other), first = _words(part, (1, 7))
                at = _around(part, first, len(words), window)
                if not len(at):
                    continue
                h = tb.window_hashes(words, at, window)
                g = tb.window_hashes(other, at, window).astype(np.uint16)
                least = _least(words, at, window)
                ids, marks = _slice_rows(part)
                order = np.lexsort((ids[tb.owner(first, at)], g, h))
                own = ids[tb.owner(first, at)][order]
                new = pk.first_of_runs(h[order], g[order])
                smallest = own[np.flatnonzero(new)][np.cumsum(new) - 1]
                later = np.zeros(len(at), bool)
                later[order] = own > smallest
                table = pk.doc_table(ids, marks, first)
                rows = []
                deal = tb.mix(least)
                # settled windows meet nothing: a slice's neighbours stay together
                spread = np.where(later, tb.mix(deal ^ ids[:1].astype(np.int64).view(np.uint64)), tb.mix(h))
                deal = np.where(np.isin(least, many.value), spread, deal)
                for b, e in pk.by_bucket(deal % np.uint64(buckets), buckets):
                    x, s = e[~later[e]], e[later[e]]
                    rows.append((b, table, h[x].tobytes(), g[x].tobytes(), pk.gaps(at[x]), pk.gaps(at[s])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))],
                    ["bucket", "docs", "hash", "more", "at", "settled"])

    return hits.mapInArrow(run, _WINDOWS)


def _repeats(windows: DataFrame) -> DataFrame:
    """(doc_id, mark, lo, hi): runs of removed windows, first and last start."""
    def meet(key: Key, batches: Batches) -> Batches:
        H, G, D, M, P, gone = [], [], [], [], [], []

        def place(docs, at):
            ids, marks, first = docs
            doc = tb.owner(first, at)
            return ids[doc], marks[doc], at - first[doc]

        for batch in batches:
            for docs, h, g, at, s in zip(*(batch.column(n).to_pylist() for n in ("docs", "hash", "more", "at", "settled"))):
                docs = pk.read_doc_table(docs)
                for out, v in zip((D, M, P), place(docs, pk.ungaps(at))):
                    out.append(v)
                H.append(np.frombuffer(h, np.uint64))
                G.append(np.frombuffer(g, np.uint16))
                gone.append(place(docs, pk.ungaps(s)))
        H, G, D, M, P = map(np.concatenate, (H, G, D, M, P))
        order = np.lexsort((D, G, H))
        new = pk.first_of_runs(H[order], G[order])
        least = D[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        out = order[D[order] > least]
        D, M, P = (np.concatenate([a[out], *(x[i] for x in gone)]) for i, a in enumerate((D, M, P)))
        order = np.lexsort((P, M, D))
        D, M, P = D[order], M[order], P[order]
        head = np.flatnonzero(pk.first_of_runs(D, M, P - np.arange(len(P))))
        last = np.append(head[1:], len(P)) - 1
        if len(head):
            last = np.maximum(last, head)
            yield pa.RecordBatch.from_arrays(
                [pa.array(D[head]), pa.array(M[head].astype(np.int32)), pa.array(P[head].astype(np.int32)),
                 pa.array(P[last].astype(np.int32))], ["doc_id", "mark", "lo", "hi"])

    return windows.groupBy("bucket").applyInArrow(meet, "doc_id long, mark int, lo int, hi int")


def _sent(docs: DataFrame, window: int, salts: int, buckets: int, heavy: int) -> DataFrame:
    """What the second pass sends."""
    live = _live(_probe(docs, window, buckets, salts), window)
    spots = cut_lineage(live.groupBy("doc_id", "mark").agg(F.collect_list("pos").alias("live")))
    texts = _texts(docs, pk.id_filter(spots.select("doc_id")))
    some = lambda t: t.where(F.pmod(F.xxhash64("doc_id"), F.lit(COUNTED)) == 0)
    many = _heavy(_texts(some(docs), pk.id_filter(some(spots).select("doc_id"))).join(some(spots), ["doc_id", "mark"]),
                  window, heavy)
    # the rows of a slice decide which copies settle in it: never by the side that is ready first
    return _extend(texts.join(spots.hint("merge"), ["doc_id", "mark"]), window, buckets, many)


def find_repeats(docs: DataFrame, window: int = WINDOW, salts: int = SALTS, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, mark, lo, hi): word windows, by first start and last start, whose words also start
    in a document with a smaller id. ``docs``: the rows of ``packing.with_mark``."""
    docs = docs.where(F.col("doc_id").isNotNull())
    return _repeats(_sent(docs, window, salts, pk.n_buckets(docs), heavy))


def remove_repeats(docs: DataFrame, window: int = WINDOW, salts: int = SALTS, with_text: bool = False,
                   heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs(doc_id long, text)``: n_words, n_removed, kept_sha256 of the kept
    words joined by one blank, and with ``with_text`` the kept text.

    Removed is each word covered by a window of ``window`` words whose word sequence also starts in
    a document with a smaller doc_id. Words are unchanged runs of ``[^\\x20\\x09-\\x0D]``; null text
    has none. Rows without an id neither lose words nor count for others; rows that share an id are
    one document, so repeated rows lose nothing to each other; other columns are ignored; an empty
    table gives an empty result."""
    marked = pk.with_mark(docs)
    runs = cut_lineage(find_repeats(marked, window, salts, heavy).groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("lo", "hi")).alias("runs")))
    wanted = pk.id_filter(runs.select("doc_id"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def finish(raw, runs):
        words = raw.split()                       # bytes.split: exactly the six blanks of the contract
        n = len(words)
        if runs:
            edge = np.zeros(n + 1, np.int64)
            for r in runs:
                edge[r["lo"]] += 1
                edge[r["hi"] + window] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
        kept = b" ".join(words)
        return n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()

    def first_pass(batches):
        """Digests of documents that lose nothing; the text stays for the others only."""
        for batch in batches:
            maybe = pk.passes(wanted, batch.column("cell"))
            rows = [(None, None, None, None) if m else finish(t, None)
                    for m, t in zip(maybe, batch.column("text").cast(pa.binary()).to_pylist())]
            n, gone, sha, _ = zip(*rows) if rows else ((),) * 4
            text = pc.if_else(pa.array(maybe | with_text), batch.column("text"), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(sha, pa.string()), text], ["doc_id", "mark", "n_words", "n_removed", "kept_sha256", "text"])

    def second_pass(batches):
        for batch in batches:
            names = schema_names
            rows = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for d, n, gone, sha, t, r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "n_removed", "kept_sha256")),
                                             texts, batch.column("runs").to_pylist()):
                if sha is None or with_text:
                    n, gone, sha, kept = finish(t, r)
                rows.append((d, n, gone, sha, kept) if with_text else (d, n, gone, sha))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    schema_names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    cells = marked.withColumn("cell", F.coalesce(pk.filter_cell(F.col("doc_id")), F.lit(0)).cast("long"))
    done = cells.mapInArrow(first_pass, "doc_id long, mark int, n_words long, n_removed long, kept_sha256 string, text string")
    return done.join(runs, ["doc_id", "mark"], "left").mapInArrow(second_pass, schema)
