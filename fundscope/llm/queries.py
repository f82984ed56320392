"""The registered queries ``opN_<name>``: each reads its whole table, runs its operator, and derives
the contract's columns from the operator's output. ``SQL`` has the same result in DuckDB SQL, where
SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundscope.llm import chat, decontaminate, langid, minhash, mixing, pii, prefixes, repeats, sharding, topk, toxicity, warc, whitening
from fundscope.llm.common import scratch_path, table, utf8_bytes

SHARDS = 40


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    out = sharding.assign_shards(sharding.assign_shards(d, ["doc_id"], SHARDS), ["doc_id"], SHARDS + 1,
                                 shard_col="grown_shard")
    narrow = out.select("doc_id", (utf8_bytes(F.col("text")) + 16).alias("size"),
                        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                        F.lit("key").alias("law"), "shard", "grown_shard")
    return sharding.number_slots(narrow, ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"], weights=(1, 2, 3), max_epochs=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    # payloads are decoded for responses only; revisits are read by their headers
    full = warc.read_warc(spark, path).where(F.col("record_type") == "response").select(
        warc.page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = warc.read_warc(spark, path, payload="none").where(F.col("record_type") == "revisit").select(
        warc.page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"))
    return full.unionAll(again)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), rows=fold != 0)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    out = chat.format_chats(c.unionByName(extra))
    out = out.withColumn("t", chat.read_back(F.col("formatted"))) \
             .withColumn("l", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                      F.char_length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)
    return out.withColumn("score", F.col("score").try_cast("long"))  # a sum beyond long: null, in its true rank


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    removed = F.aggregate("repeat_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", utf8_bytes(F.col("text")).alias("n_bytes"), removed.alias("n_removed"),
                      F.size("repeat_spans").cast("long").alias("n_spans"),
                      F.sha2(F.coalesce("kept_bytes", F.lit(b"")), 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, offset=100_000)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))  # a sum beyond long: null


def _held_out() -> Column:
    """The fold of a document: crc32 of its id as text, modulo 5 (0: held out)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, rows=_held_out() != 0)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(_held_out() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"), share_every=20, heads=heads)


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_sharding, op3_decontaminate, op4_mixing, op5_warc, op6_toxicity,
                                    op7_chat_format, op8_topk, op9_personal_data, op10_repeats, op11_whitening, op12_language,
                                    op13_prefix_trie)}


# -- the same results in DuckDB SQL ----------------------------------------------------------------

_WORDS = r"[^\x20\x09-\x0D]+"


def _best_shard(n: int) -> str:
    """Rendezvous hashing over n equal shards: the smallest -ln(u), ties to the smaller id."""
    u = f"((('0x' || substr(md5('rendezvous:' || s || ':' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / {sharding.UNIT})"
    return (f"(SELECT arg_min(s, (-ln(u), s)) FROM (SELECT s, {u} AS u FROM range({n}) r(s)))::INTEGER")


_CRC = """
crc_table AS (
  WITH RECURSIVE step(i, k, c) AS (
    SELECT i, 0, i::BIGINT FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8)
  SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8)"""

def _chat_sql() -> str:
    import re

    hit = "|".join("({})({}*)({})".format(re.escape(c), r"\\", "|".join(re.escape(x[1:]) for x in chat.CONTROL if x[0] == c))
                   for c in "<[")
    esc = lambda c: f"regexp_replace({c}, '{hit}', '" + r"\1\4\\\2\5\3\6" + "', 'g')"
    both = "".join(f"WHEN role = '{r}' THEN {len(a) + len(b)} " for r, (a, b) in chat.MARKS.items())
    other = len(chat.ROLE + chat.ROLE_END + chat.OTHER_END)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
n AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS starts FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(chat.START)} + sum(length({esc('text')})
         + CASE WHEN NOT starts THEN {len(chat.TURN)} {both} ELSE {other} + length({esc('role')}) END))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""


_B32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '')"

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORDS}') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(3, len(w))], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(len(w) - least(3, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id,
       w.doc_id = coalesce(m.c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_ALNUM}') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i + 1:i + least(10, len(w))], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (
  SELECT doc_id, m, i, array_to_string(w[i + 1:i + m], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT x.doc_id, x.m, x.i, p.item_id FROM x JOIN p ON x.m = p.m AND x.s = p.s),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_topk": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10""",
    "op5_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k""",
    "op7_chat_format": _chat_sql(),
    "op2_sharding": f"""
WITH {_CRC.strip()},
d AS (
  SELECT doc_id, coalesce('=' || doc_id, '-') AS k, coalesce(text, '') AS t,
         coalesce(octet_length(encode(text)), 0) + 16 AS size FROM documents),
e AS (
  SELECT doc_id, k, size::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda a, b: xor(a >> 8, tab[(xor(a & 255, b) + 1)::INTEGER])), 4294967295) AS text_crc32
  FROM d, crc_table),
f AS (
  SELECT e.*, (SELECT {_best_shard(SHARDS)}) AS shard, (SELECT {_best_shard(SHARDS + 1)}) AS grown_shard FROM e)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || chr(1) || '=' || text_crc32), 1, 2), doc_id NULLS FIRST, text_crc32) - 1 AS slot
FROM f""",
    "op13_prefix_trie": f"""
WITH {_CRC.strip()},
c AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT k, any_value(len(regexp_extract_all(text, '{_WORDS}'))) AS words FROM c GROUP BY k),
l AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS t FROM c GROUP BY conv_id),
h AS (
  SELECT l.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
              lambda a, b: xor(a >> 8, tab[(xor(a & 255, b) + 1)::INTEGER])), 4294967295) % 4 AS h FROM l, crc_table),
m AS (
  SELECT h.conv_id, list_concat(coalesce(l.t[1:h.h], []), h.t[h.h + 1:]) AS t
  FROM h LEFT JOIN l ON l.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, t[1:d] AS path, len(t) = d AS stops FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM m)),
n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
v AS (
  SELECT n.*, coalesce(kids, 0) AS kids, (n_convs - 1) * coalesce(words, 0) AS saved
  FROM n LEFT JOIN k ON k.path = n.path LEFT JOIN w ON w.k = n.path[d]),
s AS (
  SELECT a, up, count(*) FILTER (kids = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT path[1:a] AS up, a, kids, saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM v)) GROUP BY a, up)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, kids AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s ON s.up = v.path LEFT JOIN n u ON v.d > 0 AND u.path = v.path[1:v.d - 1]""",
    "op4_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('mix' || chr(1) || coalesce('=' || doc_id, '-') || chr(1) || coalesce('=' || md5(text), '-')) AS h,
         coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source IS NULL, source) AS i FROM s),
w AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share FROM r),
l AS (SELECT rest, share FROM w WHERE rest * weight < cap * share ORDER BY i LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN w.rest * weight >= cap * w.share THEN cap::DOUBLE
         ELSE l.rest::DOUBLE * weight::DOUBLE / l.share::DOUBLE END AS target FROM w LEFT JOIN l ON true),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
x AS (SELECT source, h, sum(size)::BIGINT AS size, row_number() OVER (PARTITION BY source ORDER BY h) AS i FROM d GROUP BY source, h),
y AS (  -- rows in order, each taken if it fits into what is left
  SELECT source, 0::BIGINT AS i, target - whole * source_size AS rest, NULL::VARCHAR AS h, false AS taken FROM p
  UNION ALL
  SELECT x.source, x.i, CASE WHEN x.size <= y.rest THEN y.rest - x.size ELSE y.rest END, x.h, x.size > 0 AND x.size <= y.rest
  FROM y JOIN x ON x.source IS NOT DISTINCT FROM y.source AND x.i = y.i + 1),
e AS (SELECT source, min(rest) AS missing FROM y GROUP BY source),
g AS (
  SELECT d.*, source_size, target, whole, missing, coalesce(y.taken, false) AS taken
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
  JOIN y ON d.source IS NOT DISTINCT FROM y.source AND d.h = y.h),
z AS (SELECT x.source, x.size, y.taken, min(x.h) AS h, any_value(missing) AS missing
      FROM x JOIN y ON x.source IS NOT DISTINCT FROM y.source AND x.h = y.h JOIN e ON x.source IS NOT DISTINCT FROM e.source WHERE x.size > 0 GROUP BY ALL),
b AS (
  SELECT source, abs(size - missing) AS off, 0 AS kind, size, 0 AS gone, h, NULL::VARCHAR AS away, missing FROM z WHERE NOT taken
  UNION ALL SELECT u.source, abs(u.size - t.size - u.missing), 1, u.size, t.size, u.h, t.h, u.missing
  FROM z u JOIN z t ON u.source IS NOT DISTINCT FROM t.source AND NOT u.taken AND t.taken AND t.size < u.size),
f AS (SELECT * FROM b WHERE off < missing QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, kind, size, gone) = 1)
SELECT doc_id, g.size, source_size, target,
       (g.size * least(3, whole + CASE WHEN g.h = f.away THEN 0 WHEN g.taken OR g.h = f.h THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g LEFT JOIN f ON g.source IS NOT DISTINCT FROM f.source""",
}
