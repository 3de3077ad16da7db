import itertools
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import audit

SCHEMA = "doc_id long, text string, source string, row long, part string, good int, filter string, prefix int"


def brute(rows, labels):
    """Every order walked document by document."""
    docs = []
    for k, (i, t, s, *_) in enumerate(rows):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": any((u or "") == t and j is not None and (i is None or j < i) for j, u, *_ in rows)}
        known = [x for x in labels if x[0] == i and i is not None]
        docs.append((s or "", {f for f, bad in fails.items() if bad}, any(q == 1 for _, q, _ in known), any(x == 1 for _, _, x in known)))
    out, shapley = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = [len(left), len(removed), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs if d[0] == part),
                                          sum(d[2] for d in removed), sum(d[3] for d in removed)]
                gone += removed
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "p", 1, "f", 2) for r in rows], SCHEMA).repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ids, failing = audit.failing_ids(docs, audit.text_conditions("text"), repeats="E")
    ids = audit.labelled(ids, told, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit.audit(audit.prefixes(ids, failing, "ABCDE", ("good", "toxic")), "ABCDE", ("good", "toxic")), failing


def test_all_orders_equal_a_walk_over_the_documents(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice([str(k), f"W{k}", "#", "a"]) if r.random() < x else str(k) for k in range(n)) for n in (0, 20, 199, 200, 260) for x in (0, 0.02, 0.9)]
    rows = [(r.randint(0, 30), r.choice([*texts, None, ""]), r.choice(["x", "y", None, ""])) for _ in range(60)]
    rows += [(None, texts[3], "x"), (None, texts[3], "x"), (None, "only null ids have this", "y"), (None, "only null ids have this", "y"), (4, texts[7], "x"), (4, texts[7], "x"),
             (99, "one only " + "long " * 300_000, "z")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 30, 2)] + [(4, 1, 0), (None, 1, 1)]
    out, failing = run(spark, rows, labels)
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in out.collect()}
    assert got == brute(rows, labels)
    assert "filter=" in failing.inputFiles()[0]  # one id table a filter


def test_empty_table(spark):
    assert run(spark, [], [])[0].collect() == []
