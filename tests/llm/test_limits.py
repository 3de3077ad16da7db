import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, forest, secrets


@pytest.mark.parametrize("n", [1, 2, 3, 5, 15, 20, 30, 100])
def test_neighbours_of_small_tables_are_all_found_by_default(spark, n):
    r = np.random.default_rng(n)
    v = r.normal(size=(n, 16)) if n % 2 else np.repeat(r.normal(size=(-(-n // 5), 16)), 5, axis=0)[:n] + 0.01 * r.normal(size=(n, 16))
    df = spark.createDataFrame([(i, [float(x) for x in row], "x") for i, row in enumerate(v)], "vec_id long, embedding array<double>, score string")
    got = {(x.query_id, x.rank): x.vec_id for x in forest.neighbours(df, F.lit(True)).collect()}
    s = v @ v.T
    want = {(q, k + 1): i for q in range(n) for k, i in enumerate(sorted((j for j in range(n) if j != q), key=lambda j: (-s[q, j], j))[:20])}
    assert got == want


def hot(text, cls):
    out, w = [], cls.window
    for i in range(len(text) - w + 1):
        if math.log2(w) - sum(n * math.log2(n) for n in collections.Counter(text[i:i + w]).values()) / w >= cls.threshold:
            if out and out[-1][1] >= i:
                out[-1][1] = i + w
            else:
                out.append([i, i + w])
    return [tuple(x) for x in out]


def test_entropy_spans_of_long_candidates_equal_every_window_anew(spark):
    r, cls = random.Random(2), secrets.CLASSES[1]
    texts = ["".join(r.choice(cls.alphabet) if (i // k) % 2 else r.choice("xy1") for i in range(n)) for n, k in ((24, 30), (25, 9), (279, 40), (280, 40), (281, 40), (600, 25), (40_000, 300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for x in secrets.secret_spans(df).collect():
        assert [(s.start, s.end) for s in x.added if s.kind == cls.kind] == hot(texts[x.doc_id], cls)


def test_workers_keep_one_kind_of_state():
    a = common.held("first", "x", lambda: [1])
    assert common.held("first", "x", list) is a and common.held("first", "y", list) == []
    assert common.held("second", "x", list) == [] and common.held("first", "x", list) == []


def test_stages_keep_columns_that_clash_with_their_own(spark):
    docs = spark.createDataFrame([(i, f"the and of that is in to w{i} " * 9, "en", "s", 1, f"k{i}", "kept", 7, 8, 9, "sha", "row") for i in range(4)],
                                 "doc_id long, text string, lang string, source string, n_chars long, row_key string, kept string, n_removed long, n_bytes long, n_spans long, kept_sha256 string, row string")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates, corpus_pipeline.remove_repeats, corpus_pipeline.mask_secrets):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        for x in out.collect():
            assert (x.row_key, x.kept, x.n_removed, x.kept_sha256, x.row) == (f"k{x.doc_id}", "kept", 7, "sha", "row")


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_many_stretches_at_once_equal_one_by_one():
    import public_tokenizers

    from tidemark.llm import sentencepieces as sp
    units = sp.Units(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    texts = [" " + "".join(r.choice("abcé漢😀\n\tthe ing0192,.") for _ in range(r.randint(0, 40))) for _ in range(400)] + [" " + "ab" * 900, " ", " é"]
    r.shuffle(texts)
    data = [t.encode() for t in texts]
    b, cuts = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, counts = units._encode_new(b, cuts[:-1], cuts[1:], np.ones(len(data), bool))
    want = [units.model.solve(t.replace(" ", sp.MARK)) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_the_driver_holds_count_tables_compressed(spark):
    import pickle

    from tidemark.llm import sketch
    h = np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([h, h[:500]]).view(np.int64)], "x long").repartition(3)
    levels = sketch.count_levels(df, lambda batch: iter([batch.column(0).to_numpy().view(np.uint64)]), 24)
    assert len(pickle.dumps(levels)) < 1 << 18  # 4 MB unpacked
    assert (sketch.level_of(levels, h[:500]) > 0).all() and (sketch.level_of(levels, h[500:]) > 0).mean() < 0.01
