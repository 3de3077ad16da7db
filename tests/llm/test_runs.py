import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import queries, runs


def brute(w):
    """Runs by their definition: every period, every maximal stretch, smallest period only."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                seg = w[i:j + q]
                if not any(seg[d:] == seg[:-d] for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def words(r):
    k, w = r.choice([1, 2, 3, 5]), []
    for _ in range(r.randint(0, 6)):
        if r.random() < 0.6:
            w += ([r.randrange(k) for _ in range(r.randint(1, 9))] * r.randint(1, 9))[:r.randint(1, 60)]
        else:
            w += [r.randrange(k) for _ in range(r.randint(0, 12))]
    return (w[:r.randint(1, 40)] * r.randint(2, 6)) if r.random() < 0.4 else w


def test_catchers_equal_the_definition_however_words_are_appended():
    r = random.Random(3)
    for _ in range(400):
        w = words(r)
        whole, step, i = runs.Catchers(), runs.Catchers(), 0
        whole.append(np.array(w, np.int64))
        while i < len(w):
            n = r.choice([1, 1, 2, 7, 20])
            step.append(np.array(w[i:i + n], np.int64))
            i += n
        expected = [(s, s + n, p) for s, n, p in brute(w)]
        assert [tuple(x) for x in whole.found(6, 4).tolist()] == expected == [tuple(x) for x in step.found(6, 4).tolist()]


def test_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    for w in (b, [bin(i).count("1") & 1 for i in range(3000)]):
        c = runs.Catchers()
        c.append(np.array(w, np.int64))
        assert [tuple(x) for x in c.found(6, 4).tolist()] == [(s, s + n, p) for s, n, p in brute(w)] == []


def expected(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute(w)
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    kept = [x for k, x in enumerate(w) if not any(s + p <= k < s + n for s, n, p in found)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(kept)))


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    docs = [(i, r.choice([" ", "\n", "\t ", "\r\n"]).join(f"w{x}é" for x in words(r)) + r.choice(["", " "]), 1, "r", "c") for i in range(200)]
    docs += [(1000, None, 1, "", ""), (1001, "", 1, "", ""), (1002, " \n ", 1, "", ""), (1003, "a " * 30_000, 1, "", ""), (7, docs[7][1], 1, "", ""), (1004, "x y " * 9, 1, "", "")]
    spark.createDataFrame(docs, "doc_id long, text string, n_words int, runs string, words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, *expected(i, t)) for i, t, *_ in docs), key=repr)


def test_null_ids_empty_tables_and_the_least_exponent(spark):
    docs = spark.createDataFrame([(None, "a b " * 5, "x"), (None, None, "x")], "doc_id long, text string, collapsed string")
    got = sorted(((x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in runs.periodic_runs(docs, ["doc_id", "collapsed"]).collect()), reverse=True)
    assert got == [(10, [(0, 10, 2)], "a b"), (0, [], "")]
    assert runs.periodic_runs(docs.limit(0), ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, ["doc_id"], least_exponent=3)
