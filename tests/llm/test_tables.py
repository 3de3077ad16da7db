import base64
import hashlib
import io

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import forest, warc

PAGES = [(1, "http://a/é x\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "ünï"), (None, "u", "<p>one</p>"),
         (6, "u", "z" * 200_000), (1, "again", "<p>one</p>")]


def test_archives_give_the_pages_back(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    files = warc.write_archives(pages)
    rows = warc.read_archives(files, payload=True).collect()
    assert len(rows) == len(PAGES) and files.agg(F.sum("records")).first()[0] == len(PAGES)
    first = {"<p>one</p>": 1, "": 3}
    for r in rows:
        html = next(h or "" for i, _, h in PAGES if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        revisit = r.page_id != first.get(html, r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if revisit else ("response", None))
        assert r.payload == (b"" if revisit else html.encode())
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages, revisit_from=5)).collect()
    assert {r.page_id: r.record_type for r in rows if r.page_id in (2, 4)} == {2: "revisit", 4: "response"}


@pytest.mark.parametrize("damage", ["length", "version", "payload", "trailer", "header"])
def test_damaged_records_are_refused(damage):
    data = warc.record(1, "u", warc.base32_sha1(b"body"), b"body", "response", None)
    assert warc.parse(data)["payload"] == b"body"
    bad = {"length": data.replace(b"Content-Length: 4", b"Content-Length: 5"), "version": b"X" + data[1:], "payload": data.replace(b"body", b"bodY"),
           "trailer": data[:-1], "header": data.replace(b"WARC-Date", b"WARC-Dat")}[damage]
    with pytest.raises(ValueError):
        warc.parse(bad)


def test_frames_use_the_dictionary_in_front():
    dictionary = b"some common words of all records " * 40
    context = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    body = [b"common words " * 3, b"", b"x" * 3_000_000]
    raw = warc.struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary)) + dictionary + b"".join(context.compress(x) for x in body)
    assert list(warc.frames(io.BytesIO(raw), 1000)) == body
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[:-2])))
    assert list(warc.frames(io.BytesIO(b""))) == []


def brute(ids, vectors, query, k):
    scores = vectors @ query
    return np.lexsort((ids, -scores))[:k]


def test_neighbours_of_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.standard_normal((30, 6)) * rng.uniform(0.2, 3, (30, 1)), np.tile(np.ones(6), (25, 1))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(100, None, 0), (120, [0.0] * 6, 0), (140, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0),
            (160, [float("nan")] * 6, 0), (180, [float("inf")] + [1.0] * 5, 0), (200, [1.0] * 5, 0), (None, [1.0] * 6, 0), (20, x[20].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    found = forest.neighbours(table, F.col("vec_id") % 20 == 0, k=20, share=1e9, shard_rows=20).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, wide = np.arange(len(x)), x.astype(np.float64)
    assert set(got) == {0, 20, 40}
    for q, near in got.items():
        others = ids != q
        expected = ids[others][brute(ids[others], wide[others], wide[q], 20)]
        assert [v for v, _ in near] == expected.tolist() and np.allclose([s for _, s in near], wide[expected] @ wide[q], rtol=1e-12)
    few = forest.neighbours(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert [r.rank for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert forest.neighbours(table.where("false"), F.lit(True)).count() == 0


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hits = total = 0
    got = {}
    for r in forest.neighbours(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in ids[ids % 20 == 0]:
        others = ids != q
        near = ids[others][brute(ids[others], x[others], x[ids == q][0], 20)]
        hits, total = hits + len(set(near) & got[q]), total + 20
    assert hits / total >= 0.9


def test_longest_prefixes_come_first():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8))
    f = forest.Forest(x, float(np.linalg.norm(x, axis=1).max()))
    for share, least in ((0.001, 1), (0.2, 5), (1e9, 500)):
        for (at, scores), q in zip(f.search(x[:5], 1, share), x[:5], strict=True):
            assert len(at) >= 1 and np.allclose(scores, x[at] @ q)
