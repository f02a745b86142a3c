"""Hard-negative mining with rotated one-bit codes.

Rows are dealt to the nearest of a few centroids (fitted on a bounded sample; they decide the cost,
never the result). A row ``x = c + r`` keeps the sign bits of the rotated residual ``r``, its length,
``<r, c>`` and the alignment ``a`` of the residual's direction ``o`` with its code vector ``b`` (signs
over the root of the dimension). With ``s = q - c`` for an anchor ``q``:

    <x, q> = <c, q> + <r, c> + |r| <o, s>
    <o, s> = a <b, s> + e,   |e| <= sqrt(1 - a^2) * sqrt(|s|^2 - <b, s>^2)     (Cauchy-Schwarz)

``<b, s>`` comes from popcounts of the code against the bit planes of the quantised ``s``, whose
rounding is bounded the same way. So every score has a certain interval. A first pass over the codes
finds, per anchor, the k-th best lower end among rows that surely qualify, over all rows; the second
pass sends vectors only to the pairs of groups that still hold an interval reaching it, and scores
the surviving rows with integers. Positives are found first, then the negatives of all positives of
an anchor at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.session import cut_lineage

SCALE = 256
BLOCK_ROWS = 1024          # rows of one centroid that are looked at together
GROUP_ROWS = 16384         # rows of a task's share of the table
ANCHOR_ROWS = 512          # anchors of a task's share of the anchors
CENTROIDS = 64
SAMPLE_ROWS = 8192         # rows that centroids are fitted on, at most
SAMPLE_NUMBERS = 1 << 22   # and their components, at most
PLANES = 6                 # bits of a quantised component of an anchor
_FAR = 1 << 62             # limits of a window without limits
_EXACT = 2.0 ** 50         # products below are exact as doubles


def quantised(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): rows that take part, components as ``floor(scale * x)``."""
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
            .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q")))


# ------------------------------------------------------------------ codes
@lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    if not width:
        return np.zeros((0, 0))
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def fit_centroids(rows: DataFrame, count: int = CENTROIDS) -> dict[int, np.ndarray]:
    """Centroids per vector length, fitted by a few k-means rounds on a bounded sample."""
    width = rows.agg(F.max(F.size("q"))).head()[0] or 1
    n = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(width, 1)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("q").collect()
    out = {}
    for width in {len(r.q) for r in sample}:
        x = [r.q for r in sample if len(r.q) == width]
        x = np.array(x, np.float64).reshape(len(x), width)
        c = x[np.arange(min(count, len(x))) * len(x) // min(count, len(x))]
        for _ in range(6):
            near = _nearest(x, c)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            size = np.bincount(near, minlength=len(c))
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        out[width] = np.rint(c)
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, width = bits.shape
    wide = np.zeros((n, -(-max(width, 1) // 64) * 64), bool)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(x: np.ndarray, c: np.ndarray):
    """(code words, numbers): numbers are |r|, <r, c> and the alignment of every row."""
    r = x - c
    turned = r @ rotation(x.shape[1]).T
    length = np.linalg.norm(r, axis=1)
    root = np.sqrt(max(x.shape[1], 1))
    align = np.where(length > 0, np.abs(turned).sum(axis=1) / (np.maximum(length, 1e-300) * root), 1.0)
    return words(turned > 0), np.stack([length, r @ c, np.minimum(align, 1.0)])


class Asked:
    """Anchors of one group, ready for any block."""

    def __init__(self, q: np.ndarray):
        self.q = q
        self.wide = q.astype(np.float64)
        self.turned = self.wide @ rotation(q.shape[1]).T
        self.length = np.linalg.norm(self.wide, axis=1)

    def intervals(self, code: np.ndarray, numbers: np.ndarray, c: np.ndarray):
        """(low, high): certain bounds of the scores, anchors by rows."""
        width = self.q.shape[1]
        length, along, align = numbers
        if not width:
            zero = np.zeros((len(self.q), len(code)))
            return zero, zero
        s = self.turned - rotation(width) @ c
        root = np.sqrt(width)
        least, span = s.min(axis=1), np.ptp(s, axis=1)
        unit = np.maximum(span, 1e-12) / (2 ** PLANES - 1)
        u = np.clip(np.rint((s - least[:, None]) / unit[:, None]), 0, 2 ** PLANES - 1).astype(np.int64)
        gap = np.abs(s - least[:, None] - unit[:, None] * u)
        off = np.minimum(np.linalg.norm(gap, axis=1), gap.sum(axis=1) / root)
        total = np.zeros((len(s), len(code)), np.int64)
        for p in range(PLANES):
            plane = words((u >> p & 1).astype(bool))
            for k in range(code.shape[1]):
                total += np.bitwise_count(plane[:, k][:, None] & code[:, k][None, :]).astype(np.int64) << p
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        part = least[:, None] * ones + unit[:, None] * total          # sum of s where the code is 1
        b = (2 * part - (least * width + unit * u.sum(axis=1))[:, None]) / root
        size = np.linalg.norm(s, axis=1)
        free = np.sqrt(np.maximum(size[:, None] ** 2 - np.maximum(np.abs(b) - off[:, None], 0) ** 2, 0))
        middle = (self.wide @ c)[:, None] + along + length * align * b
        reach = length * (align * off[:, None] + np.sqrt(np.maximum(1 - align ** 2, 0)) * free)
        norm = np.linalg.norm(c)
        pad = 1e-9 * (self.length * norm)[:, None] + 1e-9 * length * (size[:, None] + norm) + 1e-6
        return middle - reach - pad, middle + reach + pad

    def scores(self, row: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer inner products of anchor ``row[i]`` and vector ``at[i]``."""
        out = np.zeros(len(row), np.int64)
        step = max(1, (1 << 21) // max(self.q.shape[1], 1))
        for i in range(0, len(row), step):
            out[i:i + step] = np.einsum("ij,ij->i", self.q[row[i:i + step]], vectors[at[i:i + step]])
        return out


# ------------------------------------------------------------------ tables
_BLOCKS = ("grp int, dim int, centroid int, ids binary, labels binary, code binary, numbers binary, vectors binary")


def _blocks(rows: DataFrame, centroids: dict[int, np.ndarray], group_rows: int) -> DataFrame:
    """Packed rows of one centroid each; ``grp`` is a share of about ``group_rows`` rows."""
    def place(batches):
        import pyarrow as pa
        for batch in batches:
            cell = _cells(batch.column("q").to_pylist(), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())],
                                             [*batch.schema.names, "cell"])

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        group = TaskContext.get().partitionId()
        held, kind = [], None

        def block():
            width, cell = kind
            x = np.array([r[2] for r in held], np.int64).reshape(len(held), width)
            c = centroids[width][cell] if cell >= 0 else np.zeros(width)
            code, numbers = encode(x.astype(np.float64), c)
            small = np.int16 if np.abs(x).max(initial=0) < 2 ** 15 else np.int64
            raw = [np.array([r[k] for r in held], np.int64).tobytes() for k in (0, 1)]
            raw += [code.tobytes(), numbers.tobytes(), np.dtype(small).str.encode() + x.astype(small).tobytes()]
            return pa.RecordBatch.from_pydict(
                {n: pa.array([v], pa.int32()) for n, v in (("grp", group), ("dim", width), ("centroid", cell))}
                | {n: pa.array([v], pa.binary()) for n, v in zip(("ids", "labels", "code", "numbers", "vectors"), raw)})

        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in ("vec_id", "label", "q", "cell"))):
                mine = (len(r[2]), r[3])
                if held and (mine != kind or len(held) == BLOCK_ROWS):
                    yield block()
                    held = []
                kind = mine
                held.append(r)
        if held:
            yield block()

    n = rows.count()
    placed = rows.mapInArrow(place, "vec_id long, label long, q array<long>, cell int")
    parts = max(1, -(-n // group_rows))
    dealt = placed.repartitionByRange(parts, F.size("q"), "cell", "vec_id", F.xxhash64("q", "label"))
    return cut_lineage(dealt.sortWithinPartitions(F.size("q"), "cell", "vec_id").mapInArrow(pack, _BLOCKS))


def _cells(q: list, centroids: dict[int, np.ndarray]) -> np.ndarray:
    """Nearest centroid of every row, -1 for a length that the sample does not have."""
    width, out = np.array([len(v) for v in q], np.int64), np.full(len(q), -1)
    for d in np.unique(width):
        if d in centroids:
            at = np.flatnonzero(width == d)
            out[at] = _nearest(np.array([q[i] for i in at], np.float64).reshape(len(at), d), centroids[d])
    return out


def _anchors(rows: DataFrame, anchor_rows: int) -> DataFrame:
    """(agrp, vec_id, mark, label, q): one row an anchor, in groups of about ``anchor_rows``."""
    rows = rows.dropDuplicates().withColumn("mark", F.xxhash64("label", "q"))
    groups = max(1, -(-rows.count() // anchor_rows))
    return cut_lineage(rows.withColumn("agrp", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(groups)).cast("int")))


# ------------------------------------------------------------------ one search
class _Group:
    """Anchors and blocks of one pair of groups; ``each`` yields what both passes need."""

    def __init__(self, asked, blocks, centroids, same: bool):
        self.asked, self.table, self.centroids, self.same = asked, blocks, centroids, same
        self.n_asked = asked.num_rows

    def each(self):
        a = self.asked
        q = a.column("q").to_pylist()
        width = np.array([len(v) for v in q])
        ids, mark = (a.column(n).to_numpy() for n in ("vec_id", "mark"))
        label = a.column("label").to_numpy()
        limit = {n: a.column(n).to_pylist() for n in ("low", "high", "least") if n in a.column_names}
        windows = max([0, *map(len, limit["low"])])
        def wide(name, fill, kind):
            out = np.full((len(q), windows), fill, kind)
            for i, v in enumerate(limit[name]):
                out[i, :len(v)] = v
            return out
        low, high = wide("low", 1, np.int64), wide("high", 0, np.int64)       # padding admits nothing
        least = wide("least", -np.inf, np.float64) if "least" in limit else None
        names = [n for n in ("dim", "centroid", "ids", "labels", "code", "numbers", "vectors") if n in self.table.column_names]
        blocks = [dict(zip(names, r)) for r in zip(*(self.table.column(n).to_pylist() for n in names))]
        for d in np.unique(width):
            mine = np.flatnonzero(width == d)
            group = Asked(np.array([q[i] for i in mine], np.int64).reshape(len(mine), d))
            at = (ids[mine], mark[mine], low[mine], high[mine], least[mine] if least is not None else None)
            for b in blocks:
                if b["dim"] != d:
                    continue
                rows, tags = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
                c = self.centroids[d][b["centroid"]] if b["centroid"] >= 0 else np.zeros(d)
                code = np.frombuffer(b["code"], np.uint64).reshape(len(rows), -1)
                lo, hi = group.intervals(code, np.frombuffer(b["numbers"]).reshape(3, -1), c)
                if not (np.abs(lo).max(initial=0) < _EXACT and np.abs(hi).max(initial=0) < _EXACT):
                    lo[:], hi[:] = -np.inf, np.inf
                fit = ((label[mine][:, None] == tags) if self.same else (label[mine][:, None] != tags)) \
                    & (ids[mine][:, None] != rows)
                yield group, mine, at, b, rows, lo, hi, fit


def _top(keys: list[np.ndarray], value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k greatest values of every key, small ties first."""
    order = np.lexsort((tie, -value, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _search(asked: DataFrame, blocks: DataFrame, centroids: dict, same: bool, k: int) -> DataFrame:
    """(vec_id, mark, j, other, score): the k best rows in each of an anchor's windows ``j``: rows of the
    same label, or of another, with ``low <= 100 * score <= high``."""
    import pyarrow as pa
    numbers = [t.agg(F.max(c)).head()[0] or 0 for t, c in ((asked, "agrp"), (blocks, "grp"))]
    every = lambda n, last: F.explode(F.sequence(F.lit(0), F.lit(int(last)))).alias(n)

    def bounds(left, right):
        """Lower ends that surely qualify (the k best a window) and the highest upper end there may be."""
        out, group = [], right.column("grp")[0].as_py() if right.num_rows else 0
        for _, mine, (ids, mark, low, high, _), _, _, lo, hi, fit in _Group(left, right, centroids, same).each():
            for j in range(low.shape[1]):
                sure = fit & (100 * lo >= low[:, j, None]) & (100 * hi <= high[:, j, None])
                some = fit & (100 * hi >= low[:, j, None]) & (100 * lo <= high[:, j, None])
                high_end = np.where(some, hi, -np.inf).max(axis=1, initial=-np.inf)
                ends = np.where(sure, lo, -np.inf)
                if ends.shape[1] > k:
                    ends = np.partition(ends, ends.shape[1] - k, axis=1)[:, -k:]
                r, c = np.nonzero(ends > -np.inf)
                up = np.flatnonzero(some.any(axis=1))
                out.append((np.concatenate([mine[r], mine[up]]), np.full(len(r) + len(up), j),
                            np.concatenate([ends[r, c], np.full(len(up), np.nan)]),
                            np.concatenate([np.full(len(r), np.nan), high_end[up]])))
        row, j, end, up = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 4
        is_end = ~np.isnan(end)
        best = np.flatnonzero(is_end)[_top([row[is_end], j[is_end]], end[is_end], j[is_end], k)]
        most = np.flatnonzero(~is_end)[_top([row[~is_end], j[~is_end]], up[~is_end], j[~is_end], 1)]
        use = np.concatenate([best, most])
        return pa.table({"vec_id": left.column("vec_id").take(pa.array(row[use])),
                         "mark": left.column("mark").take(pa.array(row[use])), "j": pa.array(j[use], pa.int32()),
                         "agrp": left.column("agrp").take(pa.array(row[use])),
                         "grp": pa.array(np.full(len(use), group), pa.int32()),
                         "end": pa.array(end[use], pa.float64(), from_pandas=True),
                         "up": pa.array(up[use], pa.float64(), from_pandas=True)})

    codes = blocks.drop("vectors")
    seen = cut_lineage(asked.select("*", every("grp", numbers[1])).groupBy("grp", "agrp").cogroup(
        codes.select("*", every("agrp", numbers[0])).groupBy("grp", "agrp")).applyInArrow(
        bounds, "vec_id long, mark long, j int, agrp int, grp int, end double, up double"))
    key = ["vec_id", "mark", "j"]
    w = Window.partitionBy(*key).orderBy(F.desc("end"))
    kth = (seen.where("end is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
           .groupBy(*key).agg(F.max("n").alias("n"), F.min("end").alias("kth"))
           .select(*key, F.when(F.col("n") == k, F.col("kth")).alias("kth")))
    live = seen.where("up is not null").join(kth, key, "left").where(
        F.col("kth").isNull() | (F.col("up") >= F.col("kth"))).select("grp", "agrp").distinct()
    least = kth.where("kth is not null").groupBy("vec_id", "mark").agg(
        F.map_from_entries(F.collect_list(F.struct("j", "kth"))).alias("kth"))
    ready = asked.join(least, ["vec_id", "mark"], "left").withColumn("least", F.transform(
        F.sequence(F.lit(0), F.size("low") - 1), lambda j: F.coalesce(F.try_element_at("kth", j), F.lit(float("-inf")))))

    def score(left, right):
        found = [[np.zeros(0, np.int64)] * 4]
        for group, mine, (ids, mark, low, high, least), b, rows, lo, hi, fit in _Group(left, right, centroids, same).each():
            open_ = [fit & (100 * hi >= low[:, j, None]) & (100 * lo <= high[:, j, None]) & (hi >= least[:, j, None])
                     for j in range(low.shape[1])]
            r, c = np.nonzero(np.any(open_, axis=0)) if open_ else (np.zeros(0, int),) * 2
            if not len(r):
                continue
            kind, raw = b["vectors"][:3].decode(), b["vectors"][3:]
            v = np.frombuffer(raw, kind).reshape(len(rows), -1).astype(np.int64)
            s = group.scores(r, v, c)
            for j, some in enumerate(open_):
                ok = some[r, c] & (100 * s >= low[r, j]) & (100 * s <= high[r, j])
                best = np.flatnonzero(ok)
                best = best[_top([r[best]], s[best], rows[c[best]], k)]
                found.append([mine[r[best]], np.full(len(best), j), rows[c[best]], s[best]])
        row, j, other, s = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        use = _top([row, j], s, other, k)
        return pa.table({"vec_id": left.column("vec_id").take(pa.array(row[use])),
                         "mark": left.column("mark").take(pa.array(row[use])), "j": pa.array(j[use], pa.int32()),
                         "other": pa.array(other[use], pa.int64()), "score": pa.array(s[use], pa.int64())})

    scored = ready.drop("kth").join(live, "agrp").groupBy("grp", "agrp").cogroup(
        blocks.join(live, "grp").groupBy("grp", "agrp")).applyInArrow(
        score, "vec_id long, mark long, j int, other long, score long")
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "other")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                   group_rows: int = GROUP_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Hard negatives of the rows for which the condition ``anchors`` (over ``vec_id``) holds:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the best rows of its label; a positive's negatives are the best rows of
    other labels whose score is ``low`` to ``high`` percent of the positive's. Scores are integer inner
    products of ``floor(256 * x)``; ties go to the smaller id. Rows with a null id, label or vector, or
    with a null or non-finite component, take no part. Rows with an anchor's id are never its
    partners. Repeated rows count each as partners; an anchor row that is repeated whole is asked
    once, rows that share an anchor's id but differ are asked each. Only vectors of the same length are
    compared. Scores wrap beyond 64 bits. Other columns are ignored; empty tables give an empty result."""
    base = cut_lineage(quantised(rows, id_col, label_col, vec_col))
    centroids = fit_centroids(base)
    blocks = _blocks(base, centroids, group_rows)
    asked = _anchors(base.where(anchors), anchor_rows)
    free = lambda v: F.array(F.lit(v).cast("long"))
    best = cut_lineage(_search(asked.withColumn("low", free(-_FAR)).withColumn("high", free(_FAR)), blocks, centroids,
                               True, positives).select("vec_id", "mark", "rank", "other", "score"))
    found = best.groupBy("vec_id", "mark").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))
    again = asked.join(found, ["vec_id", "mark"]).withColumn("low", F.transform("p", lambda p: p.score * low)).withColumn(
        "high", F.transform("p", lambda p: p.score * high))
    hard = _search(cut_lineage(again.drop("p")), blocks, centroids, False, negatives)
    pos = best.select("vec_id", "mark", (F.col("rank") - 1).cast("int").alias("j"), F.col("other").alias("positive_id"),
                      F.col("score").alias("positive_score"))
    return hard.join(pos, ["vec_id", "mark", "j"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
