"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams (of ``ORDERS`` characters in lower case)
of its whole text, hashed into ``2 ** BITS`` buckets. Feature j is scaled by
``r_j = log(p_j / q_j)``, the ratio of its smoothed shares in toxic and other labelled documents;
a logistic regression is fitted on the scaled features. The model is one weight a bucket
(``r_j`` times the fitted weight), bounded by ``BITS`` whatever the table's size, so scoring is a
map over the documents without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm import textbytes as tb
from marketframe.llm.labelled import FIT_BYTES, FIT_ROWS, held_out, labelled_sample, log_odds

ORDERS = (4, 5, 6)
BITS = 20
SMOOTH = 1.0
RIDGE = 1e-3
STEPS = 80
RARE = 1000            # an n-gram counts from one fitted document in so many
CHUNK = 1 << 21
THRESHOLD = 0.7

def _characters(texts):
    """(code points in lower case, first one of every document); ASCII and Latin-1 letters."""
    data, off = tb.text_bytes(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    capital = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    return points + np.uint32(32) * capital, first


def features(texts):
    """(document, bucket) of every distinct n-gram of a slice, sorted by document."""
    points, first = _characters(texts)
    prefix = tb.prefix_hash(tb.mix(points.astype(np.uint64)))
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    last = np.repeat(first[1:], np.diff(first))
    found = []
    for n in ORDERS:
        at = np.flatnonzero(np.arange(len(points)) + n <= last)
        code = tb.range_hash(prefix, at, at + n) >> np.uint64(64 - BITS)
        found.append((doc[at] << np.uint64(BITS)) | code)
    key = np.concatenate(found)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _extract(batches):
    """Labelled rows -> their buckets as packed uint32."""
    import pyarrow as pa
    for batch in batches:
        for part in tb.slices(batch):
            doc, bucket = features(part.column("text"))
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
            packed = bucket.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [part.column("y"), pa.array([packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])],
                                            pa.binary())], ["y", "buckets"])


def fit(rows, prior: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) from ``[(y, packed buckets)]``: naive Bayes ratios, then a logistic
    regression on the scaled presence features by full-batch gradient steps (Adam). The sample
    holds both classes alike; ``prior`` (log odds over all labels) corrects the intercept."""
    size = 1 << BITS
    if not rows or len({y for y, _ in rows}) < 2:          # nothing to tell apart
        return np.zeros(size, np.float32), float(prior)
    y = np.array([r[0] for r in rows], float)
    count = np.array([len(r[1]) // 4 for r in rows])
    col = np.frombuffer(b"".join(r[1] for r in rows), np.uint32).astype(np.int32)
    del rows
    # chunks of whole documents, so that temporary arrays stay small
    ends = np.cumsum(count)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)), [len(y)]]))
    chunks = [(a, b, ends[a] - count[a], ends[b - 1]) for a, b in zip(cuts[:-1], cuts[1:])]
    p, q = (sum(np.bincount(col[i:j], np.repeat(y[a:b] == v, count[a:b]), size) for a, b, i, j in chunks) + SMOOTH
            for v in (1, 0))
    ratio = np.log((p / (y.sum() + 2 * SMOOTH)) / (q / ((1 - y).sum() + 2 * SMOOTH)))
    least = max(2, len(y) // RARE)                          # rarer n-grams have no reliable ratio
    ratio[(p + q) < least + 2 * SMOOTH] = 0.0
    names = np.flatnonzero(ratio)
    place = np.full(size, len(names), np.int32)             # the others share a last, idle feature
    place[names] = np.arange(len(names))
    col = place[col]
    scale = np.append(ratio[names], 0.0)
    w, b = np.zeros(len(scale)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        g, err, scaled = np.zeros_like(w), np.empty(len(y)), w * scale
        for lo, hi, i, j in chunks:
            full = count[lo:hi] > 0
            z = np.zeros(hi - lo)
            if full.any():
                z[full] = np.add.reduceat(scaled[col[i:j]], (ends[lo:hi] - count[lo:hi] - i)[full])
            err[lo:hi] = 1 / (1 + np.exp(-np.clip(z + b, -30, 30))) - y[lo:hi]
            g += np.bincount(col[i:j], np.repeat(err[lo:hi], count[lo:hi]), len(w))
        g = g * scale / len(y) + RIDGE * w
        gb = err.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.02
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
    w, scale = w[:-1], scale[:-1]
    out = np.zeros(size, np.float32)
    out[names] = w * scale
    return out, float(b + prior - np.log(y.mean() / (1 - y.mean())))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS,
             threshold: float = THRESHOLD, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: toxic likelier) and
    predicted. Only the text enters a score; null and empty texts score the intercept. Repeated
    rows score alike; without labels every score is one half; an empty table gives an empty
    result."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(tb.small_batches(docs), labels, label, fit_rows, fit_bytes).select("y", "text")
    prior = log_odds(labels, label)
    rows = [(r.y, bytes(r.buckets)) for r in sample.mapInArrow(_extract, "y int, buckets binary").collect()]
    rows.sort()                                             # the fit does not depend on task order
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, prior))

    def score(batches):
        import pyarrow as pa
        weight, intercept = model.value
        for batch in batches:
            for part in tb.slices(batch):
                doc, bucket = features(part.column("text"))
                z = np.bincount(doc, weight[bucket], minlength=part.num_rows) + intercept
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s)],
                                                 ["doc_id", "held_out", "score"])

    out = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
