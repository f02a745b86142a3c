"""The ten operators against brute force, on shared passages, odd rows and empty tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import (base_spans, byte_repeats, jaccard_components, quality_base, topk, word_repeats, words)
from llm_conftest import with_extra

SCHEMA = "doc_id long, text string"


def rows_of(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_ngram_jaccard(spark, mixed_docs):
    from marketframe.llm.jaccard import ngram_jaccard
    got = ngram_jaccard(with_extra(spark, mixed_docs)).collect()
    assert len(got) == len(mixed_docs)
    want = jaccard_components(mixed_docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_ngram_jaccard_large_near_copy_group(spark):
    """One group of near copies holds most rows; some link only over other members."""
    from marketframe.llm.jaccard import ngram_jaccard
    rng = random.Random(1)
    base = [f"t{i}" for i in range(90)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        docs.append((i, " ".join(w)))
    got = ngram_jaccard(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(docs)


def test_one_per_component_keeps_columns(spark, mixed_docs):
    from marketframe.llm.jaccard import one_per_component
    docs = with_extra(spark, mixed_docs + [(None, "no id")])
    out = one_per_component(docs)
    assert out.columns == docs.columns
    component = jaccard_components(mixed_docs)
    want = sorted(d for d, (_, c) in component.items() if d == c)
    got = out.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 1


def test_block_dedup(spark, mixed_docs):
    from marketframe.llm.block_dedup import remove_repeats
    docs = mixed_docs + [(None, "a b")]
    for salts in (1, 3):
        got = remove_repeats(with_extra(spark, docs), salts=salts).collect()
        assert len(got) == len(docs)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == word_repeats(docs)
    texts = rows_of(remove_repeats(with_extra(spark, docs), with_text=True), "kept_sha256", "text")
    assert all(hashlib.sha256(t.encode()).hexdigest() == sha for sha, t in texts.values())


@pytest.mark.parametrize("size", [40, 60])
def test_block_dedup_deals_out_a_shared_passage(spark, size):
    """One passage stands in every document between neighbours of its own; some documents share more."""
    from marketframe.llm import block_dedup as B
    from marketframe.llm import packing as pk
    rng = random.Random(size)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = draw(size)
    docs = [(i, draw(60) + passage + draw(60)) for i in range(200)]
    docs = [(d, " ".join(w)) for d, w in docs + [(300 + i, docs[i][1][20:120] + draw(30)) for i in range(0, 200, 9)]]
    table = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = B.remove_repeats(table, heavy=40).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == word_repeats(docs)

    def largest(heavy):
        """Windows of the fullest of 40 groups, and all windows."""
        sent = B._sent(pk.with_mark(table), 50, 2, 40, heavy)
        n = [r.n for r in sent.groupBy("bucket").agg((F.sum(F.length("hash")) / 8).alias("n")).collect()]
        return max(n), sum(n)

    before, every = largest(10 ** 9)
    after, all_again = largest(40)
    assert every == all_again and before > every / 6 and after < before / 2


def test_suffix_dedup(spark, mixed_docs):
    from marketframe.llm.suffix_dedup import remove_repeats
    docs = mixed_docs + [(None, "a b"), (900020, "ab" * 100), (900021, "ab" * 90 + "c" * 60)]
    got = remove_repeats(with_extra(spark, docs)).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == byte_repeats(docs)


def _shared_phrase(size):
    """Documents that hold one phrase of ``size`` bytes between neighbours of their own; some share more."""
    rng = random.Random(size)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase = draw(size)
    docs = [(i, draw(60) + phrase + draw(60)) for i in range(150)]
    return docs + [(200 + i, docs[i][1][30:150] + draw(40)) for i in range(0, 150, 5)]


@pytest.mark.parametrize("size", [24, 49, 64])
def test_suffix_dedup_deals_out_a_shared_phrase(spark, size):
    from marketframe.llm import packing as pk
    from marketframe.llm import suffix_dedup as S
    docs = _shared_phrase(size)
    table = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = S.remove_repeats(table, heavy=20).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == byte_repeats(docs)
    if size == 24:                                  # most of its strings have an anchor in the neighbours
        return
    marked = pk.with_mark(table)

    def largest(heavy):
        """Strings of the fullest of 40 groups, and all strings."""
        sent = S._sent(marked, S._spots(marked, 50, 40, heavy), 50, 40).where("length(bytes) > 0")
        n = [r.n for r in sent.groupBy("bucket").agg(F.sum(F.length("bytes") - 49).alias("n")).collect()]
        return max(n), sum(n)

    before, every = largest(10 ** 9)
    after, _ = largest(20)
    assert before > every / 6 and after < before / 3


def _draws(seed, alphabet="abcdefghijklmnop "):
    rng = random.Random(seed)
    return lambda n: "".join(rng.choice(alphabet) for _ in range(n))


def test_suffix_packed_rows_follow_their_anchors(spark):
    """The bytes of the first pass follow the anchors, not documents times buckets."""
    from marketframe.llm import packing as pk
    from marketframe.llm import suffix_dedup as S
    draw = _draws(1)
    docs = spark.createDataFrame([(i, draw(600)) for i in range(400)], SCHEMA).coalesce(1)
    packed = S._pack(pk.with_mark(docs), 50, 1000)
    size = sum(F.length(c) for c, kind in packed.dtypes if kind == "binary")
    n, every = packed.agg(F.sum(F.length("anchor") / 4), F.sum(size)).first()
    assert 400 * 25 < n and every < 60 * n


def test_suffix_sends_few_anchors_that_meet_by_chance(spark):
    """28 bytes that two documents share hold no equal string of 50: what surrounds the anchor differs."""
    from marketframe.llm import packing as pk
    from marketframe.llm import suffix_dedup as S
    draw = _draws(2)
    shared = [draw(28) for _ in range(150)]
    docs = [(i, draw(80) + shared[i // 2] + draw(80)) for i in range(300)]
    docs += [(400 + i, docs[i][1][40:100] + draw(30)) for i in range(0, 60, 2)]
    table = spark.createDataFrame(docs, SCHEMA).repartition(3)
    marked = pk.with_mark(table)
    sent = S._sent(marked, S._spots(marked, 50, 8, 4096), 50, 8).where("doc_id >= 60 and doc_id < 400").count()
    assert sent < 20
    got = S.remove_repeats(table).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == byte_repeats(docs)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getPath(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_suffix_removes_its_shuffle_files(spark):
    """When the last pass begins, the files of the passes before it are gone."""
    import time

    from marketframe.llm import suffix_dedup as S
    draw = _draws(3)
    docs = [(i, draw(2000)) for i in range(400)]
    docs += [(1000 + i, docs[i][1][:700] + draw(1000)) for i in range(200)]
    table = spark.createDataFrame(docs, SCHEMA).repartition(3)
    spark.conf.unset(CLEANUP)
    had = _shuffle_bytes(spark)
    frame = S.remove_repeats(table)
    until = time.time() + 10
    while (left := sum(n for p, n in _shuffle_bytes(spark).items() if p not in had)) > 60_000 and time.time() < until:
        time.sleep(.2)
    assert left <= 60_000 and spark.conf.get(CLEANUP, None) in (None, "false")
    assert frame.where("n_removed > 600").count() == 200


def test_entry_tables_and_zipped_texts():
    import pyarrow as pa
    import pyarrow.compute as pc

    from marketframe.llm import packing as pk
    ids, marks = np.array([5, -7, 5, 2 ** 62, 0]), np.array([1, 2, 3, -4, 5], np.int32)
    doc, at = np.array([0, 0, 2, 3, 3, 3]), np.array([4, 4, 0, 9, 10, 70_000])
    got = pk.read_entries(*pk.entry_table(ids, marks, doc, at))
    assert [x.tolist() for x in got] == [ids[doc].tolist(), marks[doc].tolist(), at.tolist()]
    texts = ["a" * 5, None, "", "é🙂" * 9, "b" * 30, "c"]
    raw = pa.array(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pk.zipped(raw), pc.fill_null(pc.binary_length(raw).cast("int64"), 99)],
                                       ["doc_id", "text", "n_bytes"])
    for part, limit in (([3, 1, 2], 40), ([6], 10 ** 6), ([3, 1, 1, 1], 7)):
        cut = list(pk.unzipped(batch, limit))
        assert [x.num_rows for x in cut] == part
        assert [t for x in cut for t in x.column("text").to_pylist()] == [(t or "").encode() for t in texts]
        assert [d for x in cut for d in x.column("doc_id").to_pylist()] == list(range(6))


def test_suffix_heavy_strings_settle_by_bytes(monkeypatch):
    """A broken hash finds everything equal; only strings with equal bytes are settled in the slice."""
    from marketframe.llm import suffix_dedup as S
    data = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 50, np.uint8)
    off = np.array([0, 50, 100, 150])
    monkeypatch.setattr(S.tb, "range_hash", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    lo = off[:-1]
    start, ctx, _, settled = S._heavy_strings(data, off, np.array([1, 2, 3]), lo, lo, lo + 5, np.full(3, 9, np.uint64), 50)
    assert (start.tolist(), ctx.tolist(), settled.tolist()) == ([0, 50, 100], [0, 1, 2], [False, False, True])


def test_suffix_sort_orders_like_the_bytes():
    from marketframe.llm.suffix_dedup import Suffixes
    rng = np.random.default_rng(2)
    data = np.frombuffer(bytes(rng.choice([97, 98], 4000)) + b"ab" * 300, np.uint8)
    at = rng.permutation(len(data) - 50)
    cuts = np.array([0, 1, 3, 700, 701, len(at)])
    s = Suffixes(data, 50)
    got = s.sorted(at, cuts)
    raw = data.tobytes()
    for a, b in zip(cuts[:-1], cuts[1:]):
        assert [raw[p:p + 50] for p in got[a:b]] == sorted(raw[p:p + 50] for p in at[a:b])
    same = s.equal_neighbours(got)
    assert s.verified(got, same)
    assert [raw[a:a + 50] == raw[b:b + 50] for a, b in zip(got[1:], got[:-1])] == same[1:].tolist()


def test_suffix_sort_compares_each_suffix_a_few_times(monkeypatch):
    """A large bucket, a third of it copies: some n log n comparisons, not n log² n."""
    from marketframe.llm import suffix_dedup as S
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    data = np.concatenate([data, data[:3000]])
    at = rng.permutation(len(data) - 49)
    pairs, compare = [], S.Suffixes.compare
    monkeypatch.setattr(S.Suffixes, "compare", lambda self, a, b: pairs.append(len(a)) or compare(self, a, b))
    out = S.Suffixes(data, 50).sorted(at, np.array([0, len(at)]))
    raw = data.tobytes()
    assert [raw[i:i + 50] for i in out] == sorted(raw[i:i + 50] for i in at)
    assert sum(pairs) < 30 * len(at)


def test_suffix_sort_falls_back_to_bytes_on_a_collision(monkeypatch):
    """A broken hash finds everything equal; verification notices and the bytes decide."""
    from marketframe.llm import suffix_dedup as S
    monkeypatch.setattr(S.Suffixes, "common", lambda self, a, b: np.full(len(a), self.length))
    blob = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 50, np.uint8)
    ctx, start = S._removed(np.array([5, 5, 5]), np.array([1, 2, 3]), np.array([4, 4, 4]), blob,
                            np.array([0, 50, 100]), np.array([50, 50, 50]), 50)
    assert (ctx.tolist(), start.tolist()) == ([2], [0])


def test_secret_base_spans(spark, mixed_docs):
    from marketframe.llm import secrets as S
    rng = random.Random(5)
    draw = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    hexa = S.DIGITS + "abcdef"
    docs = list(mixed_docs)
    for i in range(150):
        parts = [rng.choice(["password", "token", "=", ":", " ", "'", '"', "Api_Key", "AKIA", "é🙂", "\n",
                             draw(hexa, rng.choice([5, 31, 32, 40])), draw(S.UPPER + S.DIGITS, 12),
                             draw(S.DIGITS + S.LOWER + S.UPPER, 28), "secret: abc secret: abcdefgh"])
                 for _ in range(rng.randint(0, 25))]
        docs.append((50_000 + i, "".join(parts)))
    docs.append((60_000, "password=12345678 " * 700))
    got = S.secret_scan(with_extra(spark, docs)).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        spans = base_spans(text[r.doc_id] or "")
        joined = ",".join(f"{S.KINDS[k]}:{a}:{e}" for a, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert not any("PythonUDF" in x or "ArrowEvalPython" in x for x in
                   S.secret_scan(with_extra(spark, docs))._jdf.queryExecution().toString().split("\n"))


def test_randomness_battery_tells_random_strings_from_names(spark):
    from marketframe.llm import secrets as S
    rng = random.Random(11)
    alphabet = S.DIGITS + S.LOWER + S.UPPER
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(60)]
    names = [f"the-quick-brown-fox-number-{i}-jumps-over-the-lazy-dog" for i in range(60)]
    docs = [(i, f"see {t} there") for i, t in enumerate(keys + names)]
    got = rows_of(S.secret_scan(spark.createDataFrame(docs, SCHEMA)), "spans")
    assert sum("random" in got[i][0] for i in range(60)) >= 57
    assert not any(got[i][0] for i in range(60, 120))


def test_redaction_masks_values_only(spark):
    from marketframe.llm.secrets import redact_secrets
    docs = with_extra(spark, [(1, "a token = 'abcdefgh1' b"), (2, "plain text."), (3, None)])
    out = redact_secrets(docs)
    assert out.columns == docs.columns
    assert rows_of(out, "text") == {1: ("a token = '[SECRET]' b",), 2: ("plain text.",), 3: (None,)}


def test_quality_rules_base(spark, mixed_docs):
    from marketframe.llm.quality_rules import quality_rules
    docs = mixed_docs + [(70_000, "same line here.\nsame line here.\n\nother | menu | bar"), (70_001, "# * $ % & | < >")]
    got = quality_rules(with_extra(spark, docs)).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == quality_base(text[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_rules_lines(spark):
    from marketframe.llm.quality_rules import quality_rules
    good = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(8))
    bad = good + "\n" + "\n".join(f"Home | About{i} | Contact | Login | Help{i} | News and more and more words" for i in range(9))
    some = good + "\nHome | About | Contact\n" + good.split("\n")[0] + "\nThis site uses cookies."
    got = rows_of(quality_rules(spark.createDataFrame([(1, good), (2, bad), (3, some)], SCHEMA), with_text=True),
                  "kept", "clean_text")
    assert got[1] == (True, good) and not got[2][0]
    assert got[3] == (True, good)


def test_topk(spark):
    from marketframe.llm.topk import exact_topk
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(60)]                     # ties
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (320, [float("nan")] * 8), (340, [float("inf")] * 8),
             (360, [0.1] * 5), (361, [0.2] * 5), (None, [0.5] * 8), (380, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk(df, df.where("vec_id % 20 = 0"), k=7, group_rows=40, query_rows=5)
    want = topk([r for r in rows if r[0] is not None], lambda i: i % 20 == 0, 7)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = df.where("vec_id < 5 or vec_id = 20")
    assert exact_topk(few, few.where("vec_id = 20"), k=7).count() == 5


def test_bpe_round_trip(spark, mixed_docs):
    from tokenizers import Tokenizer

    from marketframe.llm.bpe import bpe_round_trip, default_vocabulary
    rng = random.Random(9)
    alphabet = ["a", "the", " ", "  ", "\n", "'s", "'", "é", "漢", "1", "!!", "<|endoftext|>", "<|", "endoftext", "|>", "\x1c"]
    docs = mixed_docs + [(80_000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    docs += [(81_000 + i, u * 400) for i, u in enumerate(["x", "ab", "'", "  ", "漢字", "!?", "ñ1"])]
    tok = Tokenizer.from_file(default_vocabulary())
    for long_text, leaf in ((32768, 8192), (40, 16)):
        got = bpe_round_trip(with_extra(spark, docs), with_ids=True, long_text=long_text, leaf=leaf).collect()
        assert len(got) == len(docs)
        text = dict(docs)
        for r in got:
            ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids
            assert list(r.ids) == ids and r.n_tokens == len(ids)
            assert r.decoded == tok.decode(ids, skip_special_tokens=False)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_mixing_flow_and_selection(spark):
    from pyspark.sql import functions as F

    from marketframe.llm.mixing import min_cost_flow, mix_documents, mix_report, targets
    t = targets({"a": 100, "b": 10, "c": 50}, {"a": 1, "b": 5, "c": 2}, 240, 2)
    assert t["b"] == 20 and abs(sum(t.values()) - 240) < 1e-9 and all(t[s] <= 2 * n for s, n in (("a", 100), ("c", 50)))
    # both sources want 30; the overlap of 20 serves b first, as a has words of its own
    flow = min_cost_flow({("a",): 30, ("a", "b"): 20, ("b",): 10}, {"a": 30, "b": 30}, 2)
    assert flow == {("a",): [30, 0], ("a", "b"): [20, 0], ("b",): [10, 0]}
    rng = random.Random(3)
    docs = [(i, "w " * rng.randint(0, 40)) for i in range(600)] + [(10_000, None), (10_001, "")]
    df = with_extra(spark, docs)
    rows = mix_report(df).collect()
    assert len(rows) == len(docs) and sorted(rows) == sorted(mix_report(df).collect())
    source = {r.doc_id: r.source for r in df.collect()}
    for s in set(source.values()):
        mine = [r for r in rows if source[r.doc_id] == s]
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
    mixed = mix_documents(df)
    assert mixed.columns == df.columns
    taken = {r.doc_id: r.taken for r in rows}
    size = {r.doc_id: r.size for r in rows}
    count = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert count == {d: t // size[d] for d, t in taken.items() if t}


def _labelled(spark, sf="/root/testdata/sf0.1"):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_classifier_held_out(spark):
    from marketframe.llm.line_crf import keep_good, line_quality
    docs, labels = _labelled(spark)
    rows = line_quality(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 500
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    extra = with_extra(spark, [(1, None), (2, ""), (3, "A plain line of words."), (3, "A plain line of words.")])
    kept = keep_good(extra, labels.limit(0))
    assert kept.columns == extra.columns
    scored = line_quality(extra, labels.limit(0)).collect()
    assert sorted((r.doc_id, r.score) for r in scored) == [(1, 0.0), (2, 0.0), (3, 0.5), (3, 0.5)]


def test_toxicity_held_out(spark):
    from marketframe.llm.toxicity import toxicity
    docs, labels = _labelled(spark)
    rows = toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert np.mean(np.array([r.predicted for r in rows])[y == 0]) < 0.01
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].mean() - (y == 1).sum() / 2 + .5) / (y == 0).sum()
    assert auc > 0.85
    odd = toxicity(with_extra(spark, [(1, None), (2, ""), (3, "x"), (3, "x")]), labels.limit(0)).collect()
    assert sorted((r.doc_id, r.score) for r in odd) == [(1, .5), (2, .5), (3, .5), (3, .5)]


def test_components(spark):
    from marketframe.llm.components import components
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 150: 100}


@pytest.mark.parametrize("name", ["jaccard", "block", "suffix", "secrets", "rules", "bpe", "mix", "mixed", "crf",
                                  "toxicity", "redact", "one"])
def test_empty_tables(spark, name):
    from marketframe.llm import bpe, block_dedup, jaccard, line_crf, mixing, quality_rules, secrets, suffix_dedup, toxicity
    docs = with_extra(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    run = {"jaccard": jaccard.ngram_jaccard, "block": block_dedup.remove_repeats, "suffix": suffix_dedup.remove_repeats,
           "secrets": secrets.secret_scan, "rules": quality_rules.quality_rules, "bpe": bpe.bpe_round_trip,
           "mix": mixing.mix_report, "mixed": mixing.mix_documents, "one": jaccard.one_per_component,
           "redact": secrets.redact_secrets, "crf": lambda d: line_crf.line_quality(d, labels),
           "toxicity": lambda d: toxicity.toxicity(d, labels)}[name]
    assert run(docs).count() == 0


def test_topk_empty(spark):
    from marketframe.llm.topk import exact_topk
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk(df, df).count() == 0


def test_words_helper_agrees():
    import pyarrow as pa

    from marketframe.llm import textbytes as tb
    texts = ["a  b", None, "", " \n", "é x\x0b\x0cy", "end"]
    data, off = tb.text_bytes(pa.array(texts))
    starts, ends, first = tb.word_bounds(data, off)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [words(t) for t in texts]
