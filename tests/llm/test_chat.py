import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n_turns long"
PARTS = ["[INST] ", " [/INST]", "[SYS] ", " [/SYS]", "[ANS] ", "</s>", "<s>", "[ROLE] ", " [/ROLE]", "[SEP] ", "\\", "[", "<", "[\\INST] ", "<\\/s>", "<\\\\s>", " [/INST", "NST]",
         "ok", " ", "\n", "é漢😀", "$1", ""]
ROLES = ["user", "assistant", "system", "tool", "", None, "[SEP] ", "us[INST] er", "a\nb", "</s>", "[\\ROLE] "]


def conversations(n):
    r = random.Random(11)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 7)):
            text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 9)))
            rows.append((c, t, r.choice(ROLES[:3] * 2 + ROLES), None if r.random() < 0.05 else text, "x", 5))
    rows += [(500, 1, "user", "b", "", 1), (500, 1, "user", "a", "", 1), (500, 1, "assistant", "z", "", 1), (500, None, "user", "first", "", 1), (500, 1, "user", "b", "", 1),
             (None, 0, "user", "no id", "", 1), (501, 0, "user", None, "", 1), (502, 0, "assistant", "[ANS] </s>" * 3000, "", 1)]
    return rows


def expected(rows):
    out = {}
    for c, t, role, text, *_ in rows:
        out.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def test_any_turns_come_back_from_the_formatted_text(spark):
    rows = conversations(120)
    made = chat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: r for r in chat.digests(chat.read(made)).collect()}
    for c, turns in expected(rows).items():
        g = got[c]
        assert [tuple(t) for t in g.turns] == turns and g.n_turns == len(turns)
        source = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert g.turns_sha256 == g.source_sha256 == hashlib.sha256(source.encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert len(g.loss) == sum(a == "assistant" for a, _ in turns)
        assert all(g.formatted[s.start - 6:s.start] == "[ANS] " and g.formatted[s.end:s.end + 4] == "</s>" for s in g.loss)
    assert len(got) == len(expected(rows))


def test_only_texts_that_conflict_are_escaped(spark):
    rows = spark.createDataFrame([("user", "plain"), ("user", "a </s> b"), ("assistant", "a </s> b"), ("user", " [/INST]"), ("user", "[\\INST]"), ("user", "[\\x]")], "role string, text string")
    tries = {(r.role, r.text): r.tries for r in chat.rendered(rows).collect()}
    assert tries == {("user", "plain"): 0, ("user", "a </s> b"): 0, ("assistant", "a </s> b"): 1, ("user", " [/INST]"): 1, ("user", "[\\INST]"): 1, ("user", "[\\x]"): 0}


def test_main_path_has_no_python_and_empty_tables_have_no_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = chat.digests(chat.read(chat.formatted(empty)))
    assert out.collect() == [] and "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()


def test_a_broken_grammar_is_an_error(spark):
    import pytest
    bad = spark.createDataFrame([("<s>[INST] a [/INST] stray [ANS] b</s>",)], "formatted string")
    with pytest.raises(Exception, match="grammar"):
        chat.read(bad).select(F.size("turns")).collect()
