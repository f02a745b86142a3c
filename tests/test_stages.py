"""The four end-to-end stages on the sf0.001 driver tables."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from marketframe.plans import stages as ST
from marketframe.sources import fixtures as FX
from marketframe.sources.ingest import dedup_first


def test_stages_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="mf-stages-")
    posts = dedup_first(FX.posts(spark, SF_SMALL), "post_id", FX.POST_ORDER)
    docs = FX.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    n_docs = docs.count()
    # test input: every post gets the text of one document
    raw = (posts.select("ticker", "post_id", "created_at", "likes_count", "retweet_count",
                        (F.col("post_id") % n_docs).alias("doc_id"))
           .join(docs, "doc_id").drop("doc_id"))
    t = ST.text_stage(raw, out)
    assert t["scored"].count() == t["cleaned"].count() > 0
    assert t["hourly"].where(F.col("tweet_count") == 0).count() > 0       # gap-free grid

    bars = FX.bars(spark, SF_SMALL)
    p = ST.price_stage(bars, t["scored"], out)
    ps = p["samples"]
    assert ps.count() > 0 and p["scaler"].count() == 23
    assert ps.where(F.size("X") != 60).count() == 0

    ts = ST.text_sample_stage(t["hourly"], bars, out)["samples"]
    assert ts.where(F.size("X") != 72).count() == 0

    f = ST.fusion_stage(ps, ts, out)
    n_pred = f["predictions"].count()
    assert n_pred > 0
    m = f["metrics"].first()
    assert m.tp + m.fp + m.tn + m.fn == n_pred
    assert os.path.isdir(os.path.join(out, "predictions_csv"))
