import random

from pyspark.sql import functions as F

from tidemark.llm import langid


def test_every_label_is_learned(spark):
    r = random.Random(2)
    rows = []
    for k in range(70):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)]
        rows += [(1000 * k + i, " ".join(r.choices(words, k=30)), f"l{k:02}") for i in range(12 if k < 66 else 4)]
    rows += [(90_000, "one text again and again", "l00")] * 3000 + [(80_000 + i, "12 34", "digits") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn(docs, F.lit(True))
    assert model.languages == [f"l{k:02}" for k in range(70)]
    told = langid.predict(docs.where("doc_id < 80000"), model, ["lang"]).collect()
    assert sum(x.lang == x.lang_pred for x in told) > 0.98 * len(told)
