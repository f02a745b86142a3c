"""Mixing sources to target weights with a min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by membership pattern (the
sorted set of its sources); a flow routes every pattern's words to the quotas of its sources. The
arcs out of a pattern repeat its words: the first use costs 1, the second 2, and so on, so a
cheaper repetition elsewhere is always used first (convex repetition costs). The flow is solved
over patterns and sources only, by connected component; their number is checked against
``MAX_PATTERNS``, and no document reaches the driver.

Documents are then selected per pattern by a seeded order (MD5 of the id and the seed): saturated
uses take all documents, the last use takes the prefix of that order whose size comes nearest to
the flow. The end of the prefix is found with two aggregations (sums per hash bucket, then the
documents of one bucket), so applying the mix is a map over the documents.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
MAX_REPEATS = 2
BUDGET = 1.5
SEED = "mix-1"
#: Bound on membership patterns and sources (rows of the flow's graph); more raise an error.
MAX_PATTERNS = 500_000


def n_words(text="text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def weights_by_order(sources: list, cycle=CYCLE) -> dict:
    """Weights in repeating order over the sources sorted by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, budget: float, max_repeats: int) -> dict:
    """Shares ``budget`` by weight; a source stops at ``max_repeats`` times its size and what is
    left over is shared again among the others. Sources fill in the order of cap per weight."""
    left, weight, out = budget, sum(weights[s] for s in sizes), {}
    todo = sorted(sizes, key=lambda s: (max_repeats * sizes[s] / weights[s]))
    for k, s in enumerate(todo):
        level = left / weight
        cap = max_repeats * sizes[s]
        if cap > weights[s] * level:
            return out | {r: float(weights[r] * level) for r in todo[k:]}
        out[s] = float(cap)
        left, weight = left - cap, weight - weights[s]
    return out


def min_cost_flow(patterns: dict, quotas: dict, max_repeats: int) -> dict:
    """Flow of every use of every pattern: ``{pattern: [flow of use 1, of use 2, ...]}``.

    Successive shortest paths from patterns to sources; path costs rise, so the cheap uses fill
    first and a later path may reroute earlier words to another source of their pattern."""
    names = [("p", p) for p in patterns] + [("s", s) for s in quotas]
    node = {n: i + 2 for i, n in enumerate(names)}
    arcs, out = [], [[] for _ in range(len(names) + 2)]

    def add(a, b, cap, cost):
        out[a].append(len(arcs))
        arcs.append([b, cap, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0.0, -cost])
        return len(arcs) - 2

    uses = {p: [add(0, node["p", p], float(size), r + 1) for r in range(max_repeats)]
            for p, size in patterns.items() if size}
    for p, size in patterns.items():
        for s in p if size else ():
            add(node["p", p], node["s", s], float("inf"), 0)
    for s, quota in quotas.items():
        add(node["s", s], 1, float(quota), 0)
    while True:
        cost, via, queue, queued = [float("inf")] * len(out), [None] * len(out), deque([0]), {0}
        cost[0] = 0
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                b, cap, c = arcs[e]
                if cap > 1e-9 and cost[a] + c < cost[b]:
                    cost[b], via[b] = cost[a] + c, e
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if via[1] is None:
            return {p: [arcs[e ^ 1][1] for e in uses.get(p, [])] for p in patterns}
        path, at = [], 1
        while at:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        step = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= step
            arcs[e ^ 1][1] += step


def solve_flow(patterns: dict, quotas: dict, max_repeats: int) -> dict:
    """The flow of :func:`min_cost_flow`, solved per connected component of patterns and sources. A
    source that shares no document with another needs no search: its uses fill up one by one."""
    parent = {s: s for s in quotas}

    def find(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for p in patterns:
        for s in p[1:]:
            parent[find(s)] = find(p[0])
    parts: dict = {}
    for p in patterns:
        parts.setdefault(find(p[0]) if p else None, []).append(p)
    out = {}
    for mine in parts.values():
        if len(mine) == 1 and len(mine[0]) == 1:
            size, quota = float(patterns[mine[0]]), float(quotas[mine[0][0]])
            out[mine[0]] = [min(size, max(0.0, quota - r * size)) for r in range(max_repeats)] if size else []
        else:
            members = {s for p in mine for s in p}
            out |= min_cost_flow({p: patterns[p] for p in mine}, {s: quotas[s] for s in members}, max_repeats)
    return out


class Mix:
    """A solved mix: ``report`` (rows per source), ``taken(docs)`` and ``apply(docs)``."""

    def __init__(self, spark, plan, sizes, target):
        self.spark, self.plan, self.sizes, self.target = spark, plan, sizes, target

    def decide(self, docs: DataFrame, id_col: str, sources: Column) -> DataFrame:
        """(r, uses): every row of ``docs`` as a struct and how often the mix takes it whole; a
        broadcast lookup of the checked number of patterns, no shuffle."""
        rows = [(k, *v) for k, v in self.plan.items()]
        plan = self.spark.createDataFrame(rows, "pattern string, whole int, key string, last string")
        key, ident = _order(id_col)
        out = docs.select(F.struct("*").alias("r"), _pattern(sources).alias("pattern"), key.alias("k"), ident.alias("i"))
        more = F.struct("k", "i") <= F.struct(F.col("key").alias("k"), F.col("last").alias("i"))
        return out.join(F.broadcast(plan), "pattern", "left").select("r", (
            F.coalesce("whole", F.lit(0)) + F.coalesce(more, F.lit(False)).cast("int")).alias("uses"))


def _pattern(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def _order(id_col: str):
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.md5(F.concat(ident, F.lit(":" + SEED)).cast("binary")), ident


def solve_mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text",
              weigh=weights_by_order, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> Mix:
    """Targets, flow and selection thresholds for ``docs``. Reads the texts once."""
    key, ident = _order(id_col)
    slim = cut_lineage(docs.select(
        key.alias("key"), ident.alias("ident"), n_words(text_col).alias("size"),
        F.array_sort(F.array_distinct(sources)).alias("members"), _pattern(sources).alias("pattern")))
    spark = docs.sparkSession
    groups = slim.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size"))
    rows = groups.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group the sources first")
    patterns = {tuple(r.members): r.size for r in rows}
    name = {tuple(r.members): r.pattern for r in rows}
    sizes: dict = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    target = targets(sizes, weigh(list(sizes)), budget * sum(patterns.values()), max_repeats)
    flow = solve_flow(patterns, target, max_repeats)
    need, plan = [], {}
    for p, size in patterns.items():
        full = sum(f >= size for f in flow[p])
        rest = flow[p][full] if full < len(flow[p]) else 0.0
        plan[name[p]] = (full, None, None)
        if rest > 0:
            need.append((name[p], rest))
    for r in _thresholds(spark, slim, need):
        plan[r.pattern] = (plan[r.pattern][0], r.key, r.ident)
    return Mix(spark, plan, sizes, target)


def _thresholds(spark, slim: DataFrame, need: list):
    """Per pattern the last document of the prefix whose size comes nearest to ``rest``: one that
    stands with half its words or more inside. Equal keys (repeated rows) go together."""
    if not need:
        return []
    want = F.broadcast(spark.createDataFrame(need, "pattern string, rest double"))
    bucketed = slim.withColumn("bucket", F.substring("key", 1, 3))
    sums = bucketed.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"))
    along = Window.partitionBy("pattern").orderBy("bucket")             # 4,096 rows a pattern at most
    ends = (sums.withColumn("upto", F.sum("size").over(along)).join(want, "pattern")
            .withColumn("before", F.col("upto") - F.col("size")))
    # the bucket in which the prefix ends: the last that begins before `rest`
    cut = ends.where(F.col("before") < F.col("rest")).groupBy("pattern").agg(
        F.max_by(F.struct("bucket", "before", "rest"), "bucket").alias("c")).select("pattern", "c.*")
    inside = bucketed.join(F.broadcast(cut), ["pattern", "bucket"])
    ties = inside.groupBy("pattern", "before", "rest", "key", "ident").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("pattern").orderBy("key", "ident")
    upto = F.col("before") + F.sum("size").over(order)
    taken = ties.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
    best = taken.groupBy("pattern").agg(F.max(F.struct("key", "ident")).alias("m"))
    # nothing of the bucket fits: the prefix ends with the bucket before
    return (cut.join(best, "pattern", "left").select(
        "pattern", F.coalesce("m.key", "bucket").alias("key"), F.coalesce("m.ident", F.lit("")).alias("ident"))
        .collect())                                                     # a row a pattern


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: its size in words, its source's size and target, and the words
    the mix takes from it (0, once or twice its size). A null source is a source of its own, last
    in order; null and empty texts have size 0 and are taken with 0 words; repeated rows are taken
    alike; an empty table gives an empty result."""
    sources = F.array(F.col(source_col))
    mix = solve_mix(docs, sources, id_col, text_col, **options)
    rows = [(s, size, float(mix.target[s])) for s, size in mix.sizes.items()]
    known = F.broadcast(docs.sparkSession.createDataFrame(rows, "name string, source_size long, target double"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    out = mix.decide(slim, "doc_id", F.array("source")).select("r.*", "uses")
    return (out.join(known, F.col("source").eqNullSafe(F.col("name")), "left")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("uses")).alias("taken")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns unchanged. Documents
    without a word are dropped."""
    sources = F.array(F.col(source_col))
    mix = solve_mix(docs, sources, id_col, text_col, **options)
    out = mix.decide(docs.where(n_words(text_col) > 0), id_col, sources).where(F.col("uses") > 0)
    return out.select("r", F.explode(F.sequence(F.lit(1), "uses"))).select("r.*")
