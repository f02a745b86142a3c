"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are sorted by id and cut into document-range blocks; a block keeps its forward index (the
quantised vectors) and the smallest and largest value of every component. For a query, the sum
over its components of ``max(q * smallest, q * largest)`` bounds every score in the block. Blocks
are taken in the order of falling bounds and scored until the bound falls below the k-th score so
far; blocks whose bound equals it are still scored, since a tie goes to the smaller id.

Blocks are gathered into groups, queries into query groups, and one task scores one pair of them,
so memory is bounded by ``GROUP_ROWS`` and ``QUERY_ROWS`` at any table size. This is the stated
query set against all rows, in blocks; each pair of groups returns k rows a query at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.session import cut_lineage

BLOCK_ROWS = 256
GROUP_ROWS = 16384
QUERY_ROWS = 1024
SCALE = 64
_NONE = -np.iinfo(np.int64).max          # below any score; its negative is a number, too


def _quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, q array<bigint>) of the rows that take part."""
    return (vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("q")))


def _pack(batches):
    """Rows sorted by id -> blocks of ``BLOCK_ROWS`` vectors of one dimension."""
    import pyarrow as pa
    from pyspark import TaskContext
    group = TaskContext.get().partitionId()
    ids, rows, width = [], [], None

    def block():
        m = np.array(rows, np.int64).reshape(len(rows), width)
        return pa.RecordBatch.from_pydict({
            "grp": pa.array([group], pa.int32()), "dim": pa.array([width], pa.int32()),
            "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
            "forward": pa.array([m.tobytes()], pa.binary())})

    for batch in batches:
        for i, q in zip(batch.column("vec_id").to_pylist(), batch.column("q").to_pylist()):
            if rows and (len(q) != width or len(rows) == BLOCK_ROWS):
                yield block()
                ids, rows = [], []
            width = len(q)
            ids.append(i)
            rows.append(q)
    if rows:
        yield block()


_BLOCK = "grp int, dim int, ids binary, forward binary"


def _best(scores, ids, k):
    """Indices of the k best per row: high scores first, then small ids."""
    if scores.shape[1] > 4 * k:           # keep whatever ties with the k-th score
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        kth = scores.min(axis=1)
    out_s = np.full((len(scores), k), _NONE)
    out_i = np.full((len(scores), k), -1, np.int64)
    r, c = np.nonzero(scores >= kth[:, None])
    s, i = scores[r, c], (ids[r, c] if ids.ndim == 2 else ids[c])
    order = np.lexsort((i, -s, r))
    r, s, i = r[order], s[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < k
    out_s[r[keep], place[keep]] = s[keep]
    out_i[r[keep], place[keep]] = i[keep]
    return out_s, out_i




def _search(qids, q, blocks, k):
    """(scores, ids, found) of the k best per query; ``blocks``: list of (ids, matrix)."""
    low = np.array([m.min(axis=0) for _, m in blocks])
    high = np.array([m.max(axis=0) for _, m in blocks])
    reach = float(np.abs(q).max(initial=0)) * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * q.shape[1]
    kind = np.float64 if reach < 2.0 ** 52 else np.int64   # float products are exact up to there
    dot = lambda a, b: (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    bound = dot(np.maximum(q, 0), high) + dot(np.minimum(q, 0), low)
    if kind is np.int64:                                    # sums may wrap: no pruning
        bound[:] = np.iinfo(np.int64).max
    order = np.argsort(-bound, axis=1, kind="stable")
    top_s = np.full((len(q), k), _NONE)
    top_i = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for turn in range(len(blocks)):
        mine = order[live, turn]
        live = live[bound[live, mine] >= top_s[live, k - 1]]
        if not len(live):
            break
        mine = order[live, turn]
        for b in np.unique(mine):
            rows = live[mine == b]
            ids, m = blocks[b]
            s = dot(q[rows], m)
            own = qids[rows][:, None] == ids[None, :]
            s[own] = _NONE
            hit = np.flatnonzero((s >= top_s[rows, k - 1][:, None]).any(axis=1))
            if not len(hit):
                continue
            rows, s = rows[hit], s[hit]
            all_s = np.concatenate([top_s[rows], s], axis=1)
            all_i = np.concatenate([top_i[rows], np.broadcast_to(ids, s.shape)], axis=1)
            top_s[rows], top_i[rows] = _best(all_s, all_i, k)
    return top_s, top_i


def _unpack(table):
    return [(np.frombuffer(i, np.int64), np.frombuffer(f, np.int64).reshape(len(i) // 8, d))
            for i, f, d in zip(table.column("ids").to_pylist(), table.column("forward").to_pylist(),
                               table.column("dim").to_pylist())]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
               vec_col: str = "embedding", group_rows: int = GROUP_ROWS,
               query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product with each row of
    ``queries`` (all rows, if there are fewer): query_id, rank (from 1), vec_id, score.

    Components are quantised to ``floor(64 * x)``; scores are long. Vectors that are null or hold a
    null or non-finite component, and rows without an id, take no part. A query is never its own
    candidate, which holds for every row with its id; repeated candidate rows count each, a query
    row that is repeated whole is asked once. Only vectors of the same length are compared. Empty
    tables give an empty result."""
    base = _quantised(vectors, id_col, vec_col)
    asked = _quantised(queries, id_col, vec_col).dropDuplicates()

    def packed(rows, per_group):
        n = rows.count()
        parts = max(1, -(-n // per_group))
        blocks = rows.repartitionByRange(parts, "vec_id", F.xxhash64("q")).sortWithinPartitions("vec_id")
        return cut_lineage(blocks.mapInArrow(_pack, _BLOCK))

    data, query = packed(base, group_rows), packed(asked, query_rows)
    last_d, last_q = (t.agg(F.max("grp")).head()[0] for t in (data, query))
    left = query.withColumnRenamed("grp", "qgrp").withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(last_d or 0))))
    right = data.withColumn("qgrp", F.explode(F.sequence(F.lit(0), F.lit(last_q or 0))))

    def score(q_table, d_table):
        import pyarrow as pa
        out = {"query_id": [], "mark": [], "vec_id": [], "score": []}
        blocks = _unpack(d_table)
        for qids, q in _unpack(q_table):
            same = [b for b in blocks if b[1].shape[1] == q.shape[1]]
            if not same:
                continue
            s, i = _search(qids, q, same, k)
            r, c = np.nonzero(s > _NONE)
            mark = np.array([_mark(x) for x in q], np.int64)
            for name, values in (("query_id", qids[r]), ("mark", mark[r]), ("vec_id", i[r, c]), ("score", s[r, c])):
                out[name].append(values)
        return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
                         for n, v in out.items()})

    found = left.groupBy("grp", "qgrp").cogroup(right.groupBy("grp", "qgrp")).applyInArrow(
        score, "query_id long, mark long, vec_id long, score long")
    w = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _mark(x) -> int:
    """Tells apart query rows that share an id but not the vector."""
    import hashlib
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)
