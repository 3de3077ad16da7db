"""Registered queries of the operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audit, chat, forest, jaccard, langid, packing, rules, runs, sentencepieces, suffix, tokenfile, warc
from tidemark.llm import secrets as secret_scan
from tidemark.llm.common import written

#: The public tokenizer files of the token and piece queries, and the longest sequence of the packing query.
TOKENIZER, PIECES, SEQUENCE = "word_bpe_49k.json", "piece_bpe_32k.model", 2048

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return wrap


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _found(name: str, pattern: str, groups: str, keep: str, kind: str, rank: int) -> str:
    """SQL: a list of structs of the matches of ``pattern`` in ``t``; ``groups`` is the value's group."""
    return f"""{name}_0 AS (SELECT doc_id, t, regexp_extract_all(t, '(?s)(.*?)({pattern})', 0) AS p,
 regexp_extract_all(t, '(?s)(.*?)({pattern})', 2) AS m, regexp_extract_all(t, '(?s)(.*?)({pattern})', {groups}) AS v FROM d),
{name} AS (SELECT * FROM (SELECT doc_id, m[i] AS m, v[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) - length(m[i]) AS s,
 list_sum(list_transform(p[1:i], lambda x: length(x))) AS e, '{kind}' AS kind, {rank} AS rank
 FROM {name}_0, unnest(range(1, len(m) + 1)) AS u(i)) WHERE {keep})"""


def _hot(name: str, source: str, cls: secret_scan.CharClass) -> str:
    """SQL: windows of high entropy by computing the entropy of every window anew, merged where they meet."""
    allowed = " AND ".join(f"NOT contains(lower(m), '{a}')" for a in secret_scan.ALLOWED)
    return f"""{name}_w AS (SELECT doc_id, s AS c, s + i AS s, s + i + {cls.window} AS e FROM {source}, unnest(range(0, length(m) - {cls.window} + 1)) AS u(i)
 WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND {allowed} AND NOT regexp_matches(m, '{secret_scan.UUID}')
 AND list_aggregate(string_split(substr(m, i + 1, {cls.window}), ''), 'entropy') >= {cls.threshold}),
{name}_g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, c ORDER BY s) AS g FROM (SELECT *,
 CASE WHEN s > lag(e) OVER (PARTITION BY doc_id, c ORDER BY s) THEN 1 ELSE 0 END AS n FROM {name}_w)),
{name}_h AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM {name}_g GROUP BY doc_id, c, g)"""


_ASSIGN, _ACCESS, _HEX = (r.pattern.replace("'", "''") for r in secret_scan.BASE)
_CLASSES = secret_scan.CLASSES
SECRETS_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("a", _ASSIGN, "3", "length(v) >= 8", "assign", 0)},
{_found("k", _ACCESS, "2", "length(v) >= 16", "access", 1)},
{_found("x", _HEX, "2", "length(v) >= 32", "hex", 2)},
{_found("c1", f"{_CLASSES[0].pattern}{{{_CLASSES[0].window},}}", "2", "true", _CLASSES[0].kind, 3)},
{_found("c2", f"{_CLASSES[1].pattern}{{{_CLASSES[1].window},}}", "2", "true", _CLASSES[1].kind, 4)},
{_hot("h1", "c1", _CLASSES[0])}, {_hot("h2", "c2", _CLASSES[1])},
base AS (SELECT doc_id, s, e, rank, kind FROM a UNION ALL SELECT doc_id, s, e, rank, kind FROM k UNION ALL SELECT doc_id, s, e, rank, kind FROM x),
more AS (SELECT doc_id, s, e, 3 AS rank, '{_CLASSES[0].kind}' AS kind FROM h1_h UNION ALL SELECT doc_id, s, e, 4, '{_CLASSES[1].kind}' FROM h2_h),
al AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = more.doc_id AND b.s < more.e AND more.s < b.e)),
j AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS b,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS w, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1,
 count(*) FILTER (rank = 2) AS n2 FROM al GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
 coalesce(w, '') AS spans FROM d LEFT JOIN j USING (doc_id)"""


@query(SECRETS_SQL)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: base rules, and entropy spans added to them."""
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in secret_scan.BASE], F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: its number of ids, their CRC-32, and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path(PIECES)
    original = docs.select("doc_id", F.sha2(F.translate(F.coalesce("text", F.lit("")), "\u2581", " "), 256).alias("sha256"), "text")
    encoded = sentencepieces.encode(original, path)
    decoded = sentencepieces.decode(encoded.withColumn("n_pieces", F.size("ids").cast("long"))
                                    .withColumn("ids_crc32", F.crc32(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary")))
                                    .drop("text"), path)
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.length("text").cast("long").alias("n_chars"),
                          (F.sha2("text", 256) == F.col("sha256")).alias("same_text"))


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every text and the verdict of the cascade."""
    return rules.quality(table(spark, sf_dir, "documents"))


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5)
    model = langid.learn(docs, F.coalesce(F.col("fold") != 0, F.lit(False)))
    docs = docs.withColumn("held_out", F.coalesce(F.col("fold") == 0, F.lit(False)))
    return langid.predict(docs, model, ["doc_id", "held_out"])


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
bits AS (SELECT page_id, h, first, '0x' || sha1(h) AS x FROM f)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
  ((CAST('0x' || substr(sha1(h) || '0', 1 + CAST(floor(i * 5 / 4) AS INT), 2) AS INT) >> (3 - (i * 5) % 4)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM bits"""


@query(WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archives."""
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are similar by 0.75 or more."""
    return jaccard.components(table(spark, sf_dir, "documents"))


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces packed into sequences of at most 2048 tokens."""
    pieces = packing.cut(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE, 0)
    return packing.pack(pieces, SEQUENCE)


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token-id files and read back from them."""
    return tokenfile.read_token_files(tokenfile.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), 2))


@query()
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text covered by a 400-byte string that also starts elsewhere, removed."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


# The planted conversation of the formatting query.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
_PLANTED_SQL = ", ".join(f"({c}, {n}, '{role}', '{text}')" for c, n, role, text in PLANTED)
_CONTROL_SQL = "(<|\\[)(\\\\*)(/?s>|/?(?:INST|SYS|ROLE)\\]|(?:ANS|SEP)\\])"
CHAT_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT * FROM (VALUES {_PLANTED_SQL})),
e AS (SELECT *, role NOT IN ('user', 'system', 'assistant') AS other, regexp_replace(text, '{_CONTROL_SQL}', '\\1\\\\\\2\\3', 'g') AS escaped FROM c),
n AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 10 ELSE 21 + length(role) END AS marks,
 CASE WHEN contains(text, CASE role WHEN 'user' THEN ' [/INST]' WHEN 'system' THEN ' [/SYS]' WHEN 'assistant' THEN '</s>' ELSE ' [/ROLE]' END)
 OR regexp_matches(text, '(<|\\[)\\\\+(/?s>|/?(?:INST|SYS|ROLE)\\]|(?:ANS|SEP)\\])') THEN escaped ELSE text END AS shown FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(3 + sum(marks + length(shown)) AS BIGINT) AS formatted_chars, true AS identical FROM n GROUP BY conv_id"""


@query(CHAT_SQL)
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and written, read back by the grammar; ``identical``: the turns are those of the source."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    chats = written(chat.formatted(rows.unionByName(planted)).drop("loss"), "chats")
    return chat.digests(chat.read(chats)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256",
        F.length("formatted").cast("long").alias("formatted_chars"), (F.col("turns_sha256") == F.col("source_sha256")).alias("identical"))


AUDIT_SQL = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws FROM d),
m AS (SELECT w.part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
 + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
 + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
 FROM w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a, f b, f c, f d, f e WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x)
 AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT o, step, (1 << (ascii(substr(o, step, 1)) - 65)) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0)::INT AS before
 FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0) AS removed,
 coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
 coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
 FROM s, g GROUP BY part, o, step, own)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
 unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


@query(AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, repeat and lose in all their orders, by source."""
    rows, failing = audit.failing_ids(table(spark, sf_dir, "documents"), audit.text_conditions("text"), repeats="E")
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    rows = audit.labelled(rows, table(spark, sf_dir, "labels"), flags)
    return audit.audit(audit.prefixes(rows, failing, "ABCDE", tuple(flags)), "ABCDE", tuple(flags))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every text; every tenth text (by a hash of its id) is read with a periodic tail."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(audit.WORD), F.lit(1)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    n = F.size("words")
    docs = docs.select("doc_id", "text", "words", (F.col("g") % F.greatest(n, F.lit(1))).cast("int").alias("a"), "g", n.alias("n"))
    docs = docs.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    tail = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    docs = docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
    found = runs.periodic_runs(docs, ["doc_id"])
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(
        x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
