"""Document quality from a linear-chain conditional random field over lines.

Every ``\\n``-split line with a word is labelled good or bad. A line's features are bins of simple
shares (punctuation, symbols, capitals, digits, separators, repeated words, word length, words in
the line, closing mark, an earlier equal line) of the line itself and of the lines before and
after it; the chain adds a weight for every pair of neighbouring labels. Training lines carry
their document's label. Forward-backward gives each line's marginal probability of being good;
their mean, weighted by the lines' lengths, is the document's score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.llm import textbytes as tb
from marketframe.llm.labelled import FIT_BYTES, FIT_ROWS, held_out, labelled_sample
from marketframe.llm.packing import fresh

STEPS = 150
RIDGE = 1e-3
SMALL_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = b"#*$%&|<>"
CLOSING = b".!?:;\"')"


def _member(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_IS = {"marks": _member(SMALL_MARKS), "symbols": _member(SYMBOLS), "bang": _member(b"!"),
       "upper": _member(bytes(range(65, 91))), "lower": _member(bytes(range(97, 123))),
       "digit": _member(bytes(range(48, 58))), "pipe": _member(b"|")}
_CLOSING = _member(CLOSING)
#: Upper bounds of the bins of each share or figure; one bin more than bounds.
BINS = {"marks": (.01, .03, .06, .1, .15, .25), "symbols": (.002, .01, .03, .08), "bang": (.01, .05, .15),
        "upper": (.01, .05, .1, .3, .6), "digit": (.01, .05, .2), "pipe": (.005, .03),
        "repeat": (.05, .15, .3, .5, .8), "adjacent": (.02, .1, .3), "length": (3.5, 5., 7., 10., 15.),
        "words": (1.5, 3.5, 8.5, 20.5, 60.5, 200.5), "single": (.1, .3), "closed": (.5,), "again": (.5,)}
_WIDTH = sum(len(b) + 1 for b in BINS.values())
N_FEATURES = 1 + 3 * (_WIDTH + 1)          # bias; this, previous and next line (or none)


def lines_of(texts):
    """(feature indices, line lengths, first line of every document) of one slice. Only lines
    with a word are kept; a document without a word has none."""
    import pyarrow.compute as pc
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    line_first = split.offsets.to_numpy().astype(np.int64)
    data, off = tb.text_bytes(split.flatten())
    starts, ends, first = tb.word_bounds(data, off)
    n_words = np.diff(first)
    live = n_words > 0
    line_doc = np.repeat(np.arange(len(line_first) - 1), np.diff(line_first))
    within = lambda mask, at: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    size = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[first]).astype(float)
    some = np.maximum(size, 1)
    figure = {k: within(m[data], off) / some for k, m in _IS.items() if k != "lower"}
    words = tb.word_hashes(data, starts, ends)
    owner = tb.owner(first, np.arange(len(words)))
    many = np.maximum(n_words, 1)
    order = np.argsort(tb.mix(words + tb.mix(owner.astype(np.uint64))), kind="stable")
    same = np.zeros(len(words), bool)
    same[order[1:]] = (words[order][1:] == words[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    figure["repeat"] = within(same, first) / many
    beside = np.zeros(len(words), bool)
    beside[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    figure["adjacent"] = within(beside, first) / many
    figure["length"] = size / many
    figure["words"] = n_words.astype(float)
    figure["single"] = within(ends - starts == 1, first) / many
    closed = np.zeros(len(n_words))
    closed[live] = _CLOSING[data[ends[first[1:][live] - 1] - 1]]
    figure["closed"] = closed
    key = tb.mix(tb.run_hashes(data, off[:-1], off[1:], 2)
                 + tb.mix(line_doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key))
    again[order[1:]] = key[order][1:] == key[order][:-1]
    figure["again"] = again
    doc = line_doc[live]
    base, at = [], 0
    for name, bounds in BINS.items():
        base.append(at + np.searchsorted(bounds, figure[name][live]))
        at += len(bounds) + 1
    own = np.stack(base, axis=1) if len(doc) else np.zeros((0, len(BINS)), np.int64)
    near = []
    for shift, offset in ((1, 1 + _WIDTH + 1), (-1, 1 + 2 * (_WIDTH + 1))):
        moved = np.roll(own, shift, axis=0) + offset
        edge = np.roll(doc, shift) != doc
        if len(doc):
            edge[0 if shift == 1 else -1] = True
        moved[edge] = offset + _WIDTH            # no such line
        near.append(moved)
    cols = np.concatenate([np.zeros((len(doc), 1), np.int64), own + 1, *near], axis=1)
    return cols, size[live], np.searchsorted(doc, np.arange(len(line_first)))


def _logsum(a, axis):
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(scores, chain, first):
    """Log forward and backward tables (lines x 2) and each document's log partition. Step t
    handles line t of all documents that have one, the longest documents first."""
    n = np.diff(first)
    docs = np.argsort(-n, kind="stable")
    docs = docs[n[docs] > 0]
    lengths = n[docs]
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    for t in range(int(lengths[0]) if len(docs) else 0):
        at = first[docs[:np.searchsorted(-lengths, -t, "left")]] + t
        ahead[at] = scores[at] + (_logsum(ahead[at - 1][:, :, None] + chain, 1) if t else 0)
    for t in range(int(lengths[0]) - 2 if len(docs) else -1, -1, -1):
        at = first[docs[:np.searchsorted(-lengths, -(t + 1), "left")]] + t
        back[at] = _logsum(chain + (scores[at + 1] + back[at + 1])[:, None, :], 2)
    total = np.zeros(len(n))
    total[docs] = _logsum(ahead[first[docs] + lengths - 1], 1) if len(docs) else 0
    return ahead, back, total


def marginals(cols, first, model):
    """Probability that a line is good."""
    weight, chain = model
    scores = np.stack([np.zeros(len(cols)), weight[cols].sum(axis=1)], axis=1)
    ahead, back, total = forward_backward(scores, chain, first)
    return np.exp((ahead + back)[:, 1] - np.repeat(total, np.diff(first)))


def gradient(theta, cols, first, line_y, line_weight, inner):
    """Gradient of the weighted negative conditional log likelihood and the ridge; ``inner`` are the lines
    with a next line."""
    n = np.diff(first)
    weight, chain = theta[:-4], theta[-4:].reshape(2, 2)
    scores = np.stack([np.zeros(len(cols)), weight[cols].sum(axis=1)], axis=1)
    ahead, back, total = forward_backward(scores, chain, first)
    whole = np.repeat(total, n)
    good = np.exp((ahead + back)[:, 1] - whole)
    g = np.bincount(cols.ravel(), np.repeat((good - line_y) * line_weight, cols.shape[1]), N_FEATURES)
    pair = np.exp(ahead[inner][:, :, None] + chain + (scores + back)[inner + 1][:, None, :]
                  - whole[inner][:, None, None])
    seen = np.zeros_like(pair)
    seen[np.arange(len(inner)), line_y[inner], line_y[inner + 1]] = 1
    g_chain = ((pair - seen) * line_weight[inner][:, None, None]).sum(axis=0)
    return np.concatenate([g, g_chain.ravel()]) + RIDGE * theta


def fit(cols, first, y):
    """Maximum conditional likelihood with a ridge, by full-batch gradient steps (Adam). Documents
    weigh alike in both classes together."""
    y = np.asarray(y)
    if len(cols) == 0 or len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        weight = np.zeros(N_FEATURES)
        weight[0] = np.log(share / (1 - share))
        return weight, np.zeros((2, 2))
    n = np.diff(first)
    line_y = np.repeat(y, n)
    doc_weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / np.maximum(n, 1)
    line_weight = np.repeat(doc_weight, n)
    inner = np.ones(len(cols), bool)
    inner[first[1:][n > 0] - 1] = False
    inner = np.flatnonzero(inner)                       # lines with a next line
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        grad = gradient(theta, cols, first, line_y, line_weight, inner)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _extract(batches):
    """Labelled rows -> their lines' features as packed int16."""
    import pyarrow as pa
    for batch in batches:
        for part in tb.slices(batch, limit=tb.SMALL_SLICE):
            cols, _, first = lines_of(part.column("text"))
            packed = cols.astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [part.column("y"), pa.array([packed[a:b].tobytes() for a, b in zip(first[:-1], first[1:])],
                                            pa.binary())], ["y", "lines"])


def fit_rows(rows):
    width = 1 + 3 * len(BINS)
    parts = [np.frombuffer(x, np.int16).reshape(-1, width) for _, x in rows]
    cols = np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, width), np.int64)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return fit(cols, first, np.array([y for y, _ in rows], np.int64))


def document_scores(texts, model):
    """Length-weighted mean of the lines' marginals. A document without a word has no good line
    and scores 0."""
    cols, size, first = lines_of(texts)
    good = marginals(cols, first, model) * size
    add = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[first])
    return np.clip(add(good) / np.maximum(add(size), 1e-9), 0, 1)


def _with_scores(docs: DataFrame, labels: DataFrame, label: str, fit_rows_: int, name: str,
                 fit_bytes: int = FIT_BYTES) -> DataFrame:
    sample = labelled_sample(tb.small_batches(docs), labels, label, fit_rows_, fit_bytes).select("y", "text")
    rows = sorted((r.y, bytes(r.lines)) for r in sample.mapInArrow(_extract, "y int, lines binary").collect())
    model = docs.sparkSession.sparkContext.broadcast(fit_rows(rows))

    def score(batches):
        import pyarrow as pa
        for batch in batches:
            for part in tb.slices(batch, limit=tb.SMALL_SLICE):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(document_scores(part.column("text"), model.value))],
                    [*part.schema.names, name])

    return tb.small_batches(docs).mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def line_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS,
                 threshold: float = 0.5, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: good likelier) and
    predicted. Only the text enters a score; null and empty texts and texts without a word score
    0. Repeated rows score alike; without labels every line scores one half; an empty table gives
    an empty result."""
    rows = _with_scores(docs.select("doc_id", "text"), labels, label, fit_rows, "_score", fit_bytes)
    return rows.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"),
                       (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS,
              threshold: float = 0.5, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """The rows of ``docs`` scoring ``threshold`` or more, columns unchanged."""
    name = fresh(docs, "score")
    return _with_scores(docs, labels, label, fit_rows, name, fit_bytes).where(F.col(name) >= threshold).drop(name)
