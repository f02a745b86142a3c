"""Ranked lexical search with per-term geometric blocking.

The documents' integer term impacts are kept as a forward index in shards of bounded size. In a
shard, the posting list of a term is cut into blocks of similar documents: every document has a
short random projection of its impacts, some of the list's documents are pivots, and each document
joins the pivot that it is most alike. A block keeps a summary, the coordinatewise maximum of its
documents' impacts. A query takes its terms in the order of falling list maxima. A document that is
first met in the list of term ``i`` holds none of the terms before, so the sum of the block's
summary over the terms from ``i`` on bounds its score: the block is skipped exactly when that bound
is below the k-th best score, and its documents are scored through the forward index otherwise.
Lists are left out in the same way by the sum of their maxima. Nothing is approximate.

The k-th best score is global: a first round scores the likeliest documents of every shard, and the
k-th best of all shards is the threshold that the second round starts from.

Items are asked in groups of about ``PAIRS`` (item, term) pairs; the group's terms, a table of
bounded size, go to the workers, and every document is indexed under them. Term matching compares
the terms themselves.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm import textbytes as tb
from marketframe.session import cut_lineage

#: Fixed values of the ranking.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PAIRS = 200_000          # (item, term) pairs of a group of items
SHARD_ENTRIES = 1 << 20  # (document, term) entries of a shard, about
BLOCK_DOCS = 32          # documents of a block on average
PROJECTION = 16          # numbers of a document's projection

_INDEX = ("n_docs long, n_terms long, entries long, ids binary, sizes binary, counts binary, terms binary, "
          "repeats binary")


def _byte_table() -> np.ndarray:
    """Lower-cases A-Z and turns whatever ends a term into a blank."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for lo, hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        t[lo:hi + 1] = 0x20
    return t


_FOLD = _byte_table()


def document_terms(column):
    """(terms as an Arrow array, first): the terms of a text column; document ``i`` has the terms
    ``first[i]`` to ``first[i + 1]``."""
    import pyarrow as pa
    data, off = tb.text_bytes(column)
    data = _FOLD[data]
    starts, ends, first = tb.word_bounds(data, off)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()),
                                            pa.py_buffer(data[data != 0x20].tobytes())), first


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, mark, term) without repeats."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return (items.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("item_id"), F.xxhash64(text).alias("mark"),
                    F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), 0))).alias("term"))
            .distinct())


def _index(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """Forward index: one row a slice of documents, with the totals over all of its documents."""
    source = tb.small_batches(docs).where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        words = pa.array(vocabulary, pa.large_string())
        for batch in batches:
            for part in tb.slices(batch):
                terms, first = document_terms(part.column("text"))
                size = np.diff(first)
                place = pc.index_in(terms, value_set=words)
                known = np.asarray(place.is_valid())
                doc = np.repeat(np.arange(len(size)), size)[known]
                number = place.drop_null().to_numpy().astype(np.int64)
                key, times = np.unique(doc * len(vocabulary) + number, return_counts=True)
                doc, number = key // len(vocabulary), key % len(vocabulary)
                have, counts = np.unique(doc, return_counts=True)
                ids = part.column("doc_id").to_numpy()[have]
                raw = [a.astype(k).tobytes() for a, k in ((ids, "<i8"), (size[have], "<i8"), (counts, "<i4"),
                                                          (number, "<i4"), (times, "<i4"))]
                yield pa.RecordBatch.from_pydict(
                    {"n_docs": pa.array([int((size > 0).sum())], pa.int64()),
                     "n_terms": pa.array([int(size.sum())], pa.int64()),
                     "entries": pa.array([len(key)], pa.int64())}
                    | {n: pa.array([r], pa.binary()) for n, r in zip(("ids", "sizes", "counts", "terms", "repeats"), raw)})

    return source.mapInArrow(pack, _INDEX)


def _document_counts(index: DataFrame, n: int) -> np.ndarray:
    """Documents holding each term; a partition sends one row a term it has."""
    def count(batches):
        import pyarrow as pa
        total = np.zeros(n, np.int64)
        for batch in batches:
            for raw in batch.column("terms").to_pylist():
                total += np.bincount(np.frombuffer(raw, "<i4"), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "df": pa.array(total[at], pa.int64())})

    out = np.zeros(n, np.int64)
    for r in index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(
            F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Shard:
    """Forward index, posting lists and blocks of one shard's documents."""

    def __init__(self, table, weights: np.ndarray, n_docs: int, n_terms: int, queries: list[np.ndarray]):
        def joined(name, kind):
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(r, kind) for r in table.column(name).to_pylist())])
        self.ids, size, counts = joined("ids", "<i8"), joined("sizes", "<i8"), joined("counts", "<i4")
        self.term, tf = joined("terms", "<i4").astype(np.int64), joined("repeats", "<i4").astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        m = 50 + (50 * size * n_docs) // max(n_terms, 1)
        self.impact = weights[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(self.term, kind="stable")
        self.posted = doc[order]
        self.begin = np.searchsorted(self.term[order], np.arange(len(weights) + 1))
        self.top = np.zeros(len(weights), np.int64)
        filled = np.flatnonzero(np.diff(self.begin))
        if len(filled):
            self.top[filled] = np.maximum.reduceat(self.impact[order], self.begin[filled])
        # a query's terms in the order of falling list maxima, without those the shard does not hold
        self.queries = []
        for q in queries:
            q = q[self.top[q] > 0]
            self.queries.append(q[np.lexsort((q, -self.top[q]))])
        self.asked_by: dict[int, list[np.ndarray]] = {}
        for q in self.queries:
            for i, t in enumerate(q.tolist()):
                self.asked_by.setdefault(t, []).append(q[i:])
        self.wanted = np.zeros(len(weights), bool)
        self.column = np.full(len(weights), -1, np.int64)
        self.cache: dict[int, tuple] = {}
        self.vectors = None
        self.scored = 0

    def docs_of(self, term: int) -> np.ndarray:
        return self.posted[self.begin[term]:self.begin[term + 1]]

    def entries(self, docs: np.ndarray):
        """(entry numbers of the documents, one after another; where each document's begin)."""
        size = self.at[docs + 1] - self.at[docs]
        cut = np.concatenate([[0], np.cumsum(size)])
        return np.repeat(self.at[docs] - cut[:-1], size) + np.arange(cut[-1]), cut

    def score(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whole scores through the forward index; every document holds a term of the query."""
        if not len(docs):
            return np.zeros(0, np.int64)
        self.scored += len(docs)
        entry, cut = self.entries(docs)
        self.wanted[query] = True
        values = np.where(self.wanted[self.term[entry]], self.impact[entry], 0)
        self.wanted[query] = False
        return np.add.reduceat(values, cut[:-1])

    def projection(self) -> np.ndarray:
        if self.vectors is None:
            rng = np.random.default_rng(1)
            out = np.zeros((len(self.ids), PROJECTION), np.float32)
            if len(self.term):
                for k in range(PROJECTION):
                    sign = rng.choice(np.array([-1, 1], np.float32), len(self.top))
                    out[:, k] = np.add.reduceat(self.impact * sign[self.term], self.at[:-1])
            self.vectors = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return self.vectors

    def blocks(self, term: int):
        """(documents by block, where blocks begin, summaries, column of a term): geometric blocks of
        the term's list, summarised over the terms that some query holds from this one on."""
        if term in self.cache:
            return self.cache[term]
        docs = self.docs_of(term)
        n = -(-len(docs) // BLOCK_DOCS)
        if n > 1:
            v = self.projection()[docs]
            alike = np.argmax(v @ v[np.arange(n) * len(docs) // n].T, axis=1)
            docs, alike = docs[o := np.argsort(alike, kind="stable")], alike[o]
            begin = np.flatnonzero(np.diff(alike, prepend=-1))
        else:
            begin = np.zeros(1, np.int64)
        coords = np.unique(np.concatenate(self.asked_by[term]))
        self.column[coords] = np.arange(len(coords))
        entry, cut = self.entries(docs)
        block = np.repeat(np.arange(len(begin)), np.diff(np.append(cut[begin], cut[-1])))
        col = self.column[self.term[entry]]
        use = col >= 0
        summary = np.zeros(len(begin) * len(coords), np.int64)
        np.maximum.at(summary, block[use] * len(coords) + col[use], self.impact[entry[use]])
        self.column[coords] = -1
        self.cache[term] = out = (docs, np.append(begin, len(docs)), summary.reshape(len(begin), -1), coords)
        return out

    def likely(self, number: int, k: int) -> np.ndarray:
        """Scores of documents from the query's strongest lists, k at most: a first threshold."""
        query = self.queries[number]
        some, met = [], 0
        for t in query.tolist():
            docs = self.docs_of(t)
            some.append(docs[:8 * k])
            met += len(some[-1])
            if met >= 4 * k:
                break
        docs = np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)
        return -np.sort(-self.score(docs, query))[:k]

    def search(self, number: int, k: int, least: int):
        """(documents, scores) of the k best with a score of ``least`` or more, small ids first among ties."""
        query = self.queries[number]
        rest = np.cumsum(self.top[query][::-1])[::-1]
        seen = np.zeros(len(self.ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, t in enumerate(query.tolist()):
            if rest[i] < least:
                break
            members, begin, summary, coords = self.blocks(t)
            bound = summary[:, np.searchsorted(coords, query[i:])].sum(axis=1)
            live = np.flatnonzero(bound >= least)
            if not len(live):
                continue
            size = begin[live + 1] - begin[live]
            cut = np.cumsum(size) - size
            new = members[np.repeat(begin[live] - cut, size) + np.arange(size.sum())]
            new = new[~seen[new]]
            seen[new] = True
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.score(new, query)])
            best = np.lexsort((self.ids[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                least = max(least, int(scores[-1]))
        keep = scores >= least
        return docs[keep], scores[keep]


def _search_group(index: DataFrame, asked: list[tuple[int, int, np.ndarray]], weights: np.ndarray, n_docs: int,
                  n_terms: int, k: int, shards: int) -> DataFrame:
    queries = [q for _, _, q in asked]
    placed = index.where("entries > 0").withColumn("shard", F.pmod(F.xxhash64("ids", "terms"), F.lit(shards)))
    placed = placed.repartition(shards, "shard")             # a stated number: small tables are work enough a row

    def first_round(table):
        import pyarrow as pa
        shard = Shard(table, weights, n_docs, n_terms, queries)
        found = [shard.likely(i, k) for i in range(len(queries))]
        return pa.table({"item": pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64()),
                         "score": pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())})

    best = placed.groupBy("shard").applyInArrow(first_round, "item long, score long").where("score > 0")
    w = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("rank") == k)
    least = np.ones(len(queries), np.int64)
    for r in kth.select("item", "score").collect():          # one number an item of the group
        least[r.item] = r.score

    def second_round(table):
        import pyarrow as pa
        shard = Shard(table, weights, n_docs, n_terms, queries)
        out = {"item_id": [], "mark": [], "doc_id": [], "score": []}
        for i, (item, mark, _) in enumerate(asked):
            docs, scores = shard.search(i, k, int(least[i]))
            for name, values in (("item_id", np.full(len(docs), item)), ("mark", np.full(len(docs), mark)),
                                 ("doc_id", shard.ids[docs]), ("score", scores)):
                out[name].append(values)
        return pa.table({n: pa.array(np.concatenate(v), pa.int64()) for n, v in out.items()})

    return placed.groupBy("shard").applyInArrow(second_round, "item_id long, mark long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", pairs: int = PAIRS,
                  shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank (from 1), doc_id, score.

    Only scores above 0 count; ties go to the smaller ``doc_id``. Null, empty and termless texts are no
    documents and ask nothing. Rows without an id take no part. Rows of ``docs`` that share an id
    count each. Item rows that are repeated whole are asked once; items that share an id but not the
    text are each asked and ranked on their own. Other columns are ignored, whatever their names;
    empty tables give an empty result."""
    asked = cut_lineage(item_terms(items, item_col, item_text))
    n_pairs = asked.count()
    groups = max(1, -(-n_pairs // pairs))
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("item_id", "mark"), F.lit(groups)))
    found = docs.sparkSession.createDataFrame([], "item_id long, mark long, doc_id long, score long")
    for g in range(groups):
        rows = asked.where(F.col("grp") == g).groupBy("item_id", "mark").agg(
            F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item_id", "mark").collect()
        vocabulary = sorted({t for r in rows for t in r.terms})
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        index = cut_lineage(_index(docs, id_col, text_col, vocabulary))
        total = index.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_terms", "entries"))).head()
        weights = term_weights(total.n_docs, _document_counts(index, len(vocabulary)))
        queries = [(r.item_id, r.mark, np.array([number[t] for t in r.terms], np.int64)) for r in rows]
        shards = max(1, -(-total.entries // shard_entries))
        found = found.unionByName(_search_group(index, queries, weights, total.n_docs, total.n_terms, k, shards))
    w = Window.partitionBy("item_id", "mark").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
