"""N-gram Jaccard join: grouped prefix join of documents.

A document's set holds its distinct word shingles as 64-bit keys. Keys follow one global order,
rare shingles first: document frequencies are counted over all documents into ``2 ** SKETCH_BITS``
cells (a table of fixed size), and a key's leading bits are replaced by the rank of its cell.
Two sets with Jaccard similarity of t percent or more share a key among their first
``n - ceil(t n / 100) + 1`` keys, their prefixes; one of the keys they share is early (see
``_early``) in the smaller set, so keys that are early in no set, and pairs late in the smaller,
need no look.

1. Documents with equal sets are one class; classes with the same prefix and size are one group,
   and only groups are posted under their prefix keys. Keys posted once are dropped.
2. Within a key and size band every group meets the band's smallest group (its hub), never each
   other; group pairs are expanded to members, filtered and verified. Most near copies are linked
   now.
3. For keys that still hold several components, members outside the key's largest component meet
   the key's other components' members (and members of one group meet in the same way), so no link
   between components is missed.

Pairs pass an exact filter before verification: parity bitmaps (wide ones for large sets) bound
the symmetric difference from below. Only sets of documents in a remaining pair are built again from
the texts and shuffled. Components follow by star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm import textbytes as tb
from marketframe.llm.components import components
from marketframe.llm.packing import Batches, Key, filter_cell, fresh, id_filter, passes, planes, unplanes
from marketframe.session import cut_lineage

WORDS = 3              # words of a shingle
PERCENT = 90           # least similarity
SKETCH_BITS = 21       # cells of the frequency table
SIGN_WORDS = 8         # 64-bit words of a parity bitmap
WIDE_FROM = 1000       # sets of this size and more have a wide bitmap as well
WIDE_WORDS = 64

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_SHIFT = np.uint64(64 - SKETCH_BITS)
_LOW = np.uint64((1 << (64 - SKETCH_BITS)) - 1)


def _hashes(texts, words: int):
    """(shingle hashes, first shingle of every document) of one slice; repeats included."""
    data, off = tb.text_bytes(texts)
    data = _ASCII_LOWER[data]
    starts, ends, first = tb.word_bounds(data, off)
    w = tb.word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    short = np.repeat(n < words, count)
    out = np.zeros(len(begin), np.uint64)
    out[~short] = tb.window_hashes(w, begin[~short], words)
    out[short] = tb.part_hashes(w, begin[short], np.repeat(first[1:], count)[short])
    return out, at


def _sets(texts, words: int, rank=None):
    """Sorted distinct keys of every document."""
    h, at = _hashes(texts, words)
    if rank is not None:
        h = (rank[(h >> _SHIFT).astype(np.int64)].astype(np.uint64) << _SHIFT) | (h & _LOW)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def _frequency_rank(docs: DataFrame, words: int) -> np.ndarray:
    """Rank of each cell by the number of documents' shingles in it; ``2 ** SKETCH_BITS`` numbers
    whatever the table's size."""
    chunk = 1 << 14

    def count(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in tb.slices(batch, limit=tb.SMALL_SLICE):
                for s in _sets(part.column("text"), words):
                    np.add.at(cells, (s >> _SHIFT).astype(np.int64), 1)
        rows = cells.reshape(-1, chunk)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()),
                                          pa.array([planes(r) for r in rows], pa.binary())], ["part", "cells"])

    def add(key: Key, batches: Batches) -> Batches:
        total = np.zeros(chunk, np.int64)
        for batch in batches:
            for x in batch.column("cells").to_pylist():
                total += unplanes(x)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()),
                                          pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "cells"])

    rows = (docs.select("text").mapInArrow(count, "part int, cells binary")
            .groupBy("part").applyInArrow(add, "part int, cells binary").collect())
    cells = np.zeros(1 << SKETCH_BITS, np.float32)             # only the order counts
    for r in rows:
        cells[r.part * chunk:(r.part + 1) * chunk] = np.frombuffer(r.cells, np.float32)
    del rows
    rank = np.empty(len(cells), np.uint32)
    rank[np.argsort(cells, kind="stable")] = np.arange(len(cells), dtype=np.uint32)
    return rank


def _parity(keys: np.ndarray, words: int) -> np.ndarray:
    """Bit i tells whether an odd number of keys falls on it; keys that two sets share cancel."""
    bits = np.bincount((keys & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits(bits.astype(np.uint8) & 1).view(np.int64)


def _features(docs: DataFrame, rank, words: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, head, prefix, sign, wide) of every document."""
    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, limit=tb.SMALL_SLICE):
                sets = _sets(part.column("text"), words, rank.value)
                n = np.array([len(s) for s in sets], np.int64)
                keep = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                marks = [_parity(s, SIGN_WORDS) for s in sets]
                wide = [_parity(s, WIDE_WORDS) if len(s) >= WIDE_FROM else np.zeros(0, np.int64) for s in sets]
                total = [(tb.mix(s).sum(dtype=np.uint64), tb.mix(s ^ np.uint64(tb.BASE)).sum(dtype=np.uint64),
                          tb.mix(s[:k]).sum(dtype=np.uint64)) for s, k in zip(sets, keep)]
                h = np.array(total, np.uint64).reshape(-1, 3).view(np.int64)
                lists = lambda parts, size: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()),
                    pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), *(pa.array(h[:, i]) for i in range(3)),
                     lists([s[:k] for s, k in zip(sets, keep)], keep),
                     lists(marks, [len(m) for m in marks]), lists(wide, [len(m) for m in wide])],
                    ["doc_id", "n", "h1", "h2", "head", "prefix", "sign", "wide"])
    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, head long, prefix array<long>, "
                            "sign array<long>, wide array<long>")


def _sizes(percent: int):
    return 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")


def _early(n, percent: int):
    """Keys of a set among which it meets every similar set that is not smaller."""
    return n - F.ceil(2 * percent * n / F.lit(100 + percent)) + 1


def _near(percent: int, wide: bool):
    """Exact filter on the parity bitmaps of a pair."""
    apart = sum((F.bit_count(F.col("a_sign")[i].bitwiseXOR(F.col("b_sign")[i])) for i in range(1, SIGN_WORDS)),
                F.bit_count(F.col("a_sign")[0].bitwiseXOR(F.col("b_sign")[0])))
    total = F.col("a_n") + F.col("b_n")
    if not wide:
        return (100 + percent) * apart <= (100 - percent) * total
    far_apart = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                            F.lit(0), lambda total, x: total + x)
    both_wide = (F.size("a_wide") > 0) & (F.size("b_wide") > 0)
    least = F.when(both_wide, far_apart).otherwise(apart)
    return (100 + percent) * least <= (100 - percent) * total


def _verified(pairs: DataFrame, docs: DataFrame, rank, words: int, percent: int) -> DataFrame:
    """The links (a, b) among ``pairs(a, b)`` by the full sets, which are built again from the
    texts of the documents in a pair only."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = id_filter(ids)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, batch.column("cell"))))
            for part in tb.slices(batch, limit=tb.SMALL_SLICE):
                sets = _sets(part.column("text"), words, rank.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["id", "keys"])

    sets = docs.where(F.col("doc_id").isNotNull()).select("doc_id", filter_cell(F.col("doc_id")).alias("cell"), "text")
    sets = sets.mapInArrow(run, "id long, keys array<long>")
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("keys").alias("a_keys")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("keys").alias("b_keys")), "b")
    same = F.size(F.array_intersect("a_keys", "b_keys"))
    return two.where((100 + percent) * same >= percent * (F.size("a_keys") + F.size("b_keys"))).select("a", "b").distinct()


def ngram_jaccard(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id long, text)``.

    ``n_shingles`` is the size of the document's set: distinct shingles of ``words`` words (ASCII
    letters in lower case), or the whole word sequence as one shingle if it is shorter.
    ``component_id`` is the smallest doc_id reachable over links of ``percent`` or more. Texts
    that are null, empty or without a word have an empty set and link with nothing. Repeated rows
    stay repeated (rows that share an id are one document; their texts should agree); rows
    without an id get themselves (null) as component; other columns are ignored; an empty table
    gives an empty result. Set equality is judged by two 64-bit sums and the size."""
    docs = tb.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(_frequency_rank(docs, words))
    feats = cut_lineage(_features(docs, rank, words, percent))
    key = ["h1", "h2", "n"]
    solid = feats.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = solid.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    # a set of 1 to 8 shingles has no partner but its equals at 90 percent: n * 100 < percent * (n + 1)
    joinable = solid.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    rows = joinable.join(reps.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    classes = cut_lineage(rows.select(F.col("doc_id").alias("id"), "n", "head", "prefix", "sign", "wide"))
    groups = classes.groupBy("head", "n").agg(F.min("id").alias("gid"), F.count("*").alias("members"))
    heads = classes.join(groups.select(F.col("gid").alias("id")), "id", "left_semi")
    posts = heads.select(F.posexplode("prefix").alias("at", "key"), F.col("id").alias("gid"), "n")
    posts = posts.select("key", "gid", "n", (F.col("at") < _early(F.col("n"), percent)).alias("early"))
    shared = posts.groupBy("key").agg(F.count("*").alias("c"), F.max("early").alias("e"))
    shared = shared.where((F.col("c") > 1) & F.col("e")).select("key")
    # members of one group of several classes meet under a key of their own
    crowd = groups.where(F.col("members") > 1).select(F.xxhash64("gid", F.lit("group")).alias("key"), "gid", "n",
                                                    F.lit(True).alias("early"))
    live = cut_lineage(posts.join(shared, "key").unionByName(crowd))
    member = classes.join(groups.select("head", "n", "gid"), ["head", "n"]).select("gid", "id")
    signs = classes.select("id", "n", "sign", "wide")

    def with_signs(pairs):
        for side in "ab":
            s = signs.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "sign", "wide")))
            pairs = pairs.join(s, side)
        return pairs.where(_sizes(percent) & _near(percent, True)).select("a", "b")

    # hubs: the smallest group of every key and size band
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    banded = live.withColumn("band", band)
    hubs = banded.groupBy("key", "band").agg(F.min("gid").alias("hub"))
    to_hub = (banded.join(hubs, ["key", "band"]).select("gid", "hub").distinct()
              .join(member, "gid").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    pairs = cut_lineage(with_signs(to_hub.where(F.col("a") != F.col("b")).distinct()))
    links = cut_lineage(_verified(pairs, docs, rank, words, percent))
    comp = components(links)

    # keys that still hold several components
    labelled = (live.join(member, "gid").join(comp.withColumnRenamed("node", "id"), "id", "left")
                .select("key", "id", "n", "early", F.coalesce("component", "id").alias("comp")))
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_keys = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max_by("comp", F.struct("c", "comp")).alias("major"))
    open_keys = open_keys.where(F.col("k") > 1).select("key", "major")
    opened = cut_lineage(labelled.join(open_keys, "key"))
    signed = opened.join(signs.select("id", "sign"), "id")
    columns = ("comp", "n", "early", "sign")
    left = signed.where(F.col("comp") != F.col("major")).select(
        "key", F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    right = signed.select("key", F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns), (F.col("comp") == F.col("major")).alias("b_major"))
    meet = left.join(right, (left["key"] == right["key"]) & (F.col("a_comp") != F.col("b_comp"))
                     & (F.col("b_major") | (F.col("a") < F.col("b"))) & _sizes(percent)
                     & F.when(F.col("a_n") > F.col("b_n"), F.col("b_early")).when(
                         F.col("a_n") < F.col("b_n"), F.col("a_early")).otherwise(F.col("a_early") | F.col("b_early"))
                     & _near(percent, False))
    rest = cut_lineage(with_signs(
        meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    more = _verified(rest, docs, rank, words, percent)
    comp = components(links.unionByName(more)).withColumnRenamed("node", "rep")
    final = reps.join(comp, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    return (feats.select("doc_id", *key).join(final, key, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; repeated rows count as
    copies, and of rows that share an id one stays. Columns stay; rows without an id, and texts
    without a word, link with nothing and are kept. Only rows that may go are shuffled."""
    found = cut_lineage(ngram_jaccard(docs, words, percent).where(F.col("doc_id").isNotNull()))
    goes = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("doc_id")
    maybe = id_filter(goes.unionByName(again))
    cell = fresh(docs, "cell")
    cells = docs.withColumn(cell, F.coalesce(filter_cell(F.col("doc_id")), F.lit(-1)).cast("long"))

    def rows(inside):
        def run(batches):
            for batch in batches:
                at = batch.column(cell)
                hit = passes(maybe, pc.max_element_wise(at, 0)) & (at.to_numpy() >= 0)
                yield batch.filter(pa.array(hit == inside)).drop_columns([cell])
        return cells.mapInArrow(run, docs.schema)

    some = rows(True).join(goes, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return rows(False).unionByName(some.select([F.col(f"`{c}`") for c in docs.columns]))
