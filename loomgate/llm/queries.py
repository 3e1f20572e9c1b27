"""Queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomgate.llm import byte_bpe, decontamination, exact_dedup, html_text, langid, language_model, licenses, merkle, minhash, sharding, simhash, spelling, tool_calls
from loomgate.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(read(spark, sf_dir, "pages"))


#: Every user turn is read as a call of this tool, the assistant's next turn as its result.
REPLY = {"reply": {"role": (("STRING",), True), "text": (("STRING",), True), "turn": (("BIGINT",), True)}}


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a call or a result. A user's turn is a call whose identifier is made of conversation and turn, and which uses the
    result of the turn two before it; any other turn but the assistant's is a call with its text as arguments; an assistant's turn
    is the result of the turn before it."""
    turns = read(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    user = F.col("role") == "user"
    calls = turns.where("role IS NULL OR role <> 'assistant'").select(
        F.col("conv_id").alias("conv"), name(F.col("turn")).alias("id"), F.col("turn").alias("seq"), F.when(user, "reply").otherwise(F.col("role")).alias("tool"),
        F.when(user, F.to_json(F.struct("turn", "text", "role"))).otherwise(F.col("text")).alias("arguments"), F.when(user & (F.col("turn") >= 2), name(F.col("turn") - 2)).alias("parent"),
    )
    results = turns.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), name(F.col("turn") - 1).alias("id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return tool_calls.linked(calls, results, REPLY)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.coding_digest(read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted_languages(read(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(read(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(read(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE t AS (SELECT *, 'c' || conv_id || '-' || turn AS id FROM conversations),
calls AS (SELECT conv_id AS conv, id, turn AS seq, role, any_value(text) AS text FROM t WHERE role <> 'assistant' GROUP BY ALL),
answers AS (SELECT conv_id AS conv, turn - 1 AS seq, arg_min(text, text) AS content, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY 1, 2),
linked AS (SELECT c.*, c.role = 'user' AND c.seq >= 2 AS has_parent, p.seq AS parent FROM calls c LEFT JOIN calls p ON p.conv = c.conv AND p.seq = c.seq - 2 AND c.role = 'user'),
walk AS (SELECT conv, seq, 0 AS depth, has_parent AS lost FROM linked WHERE parent IS NULL
  UNION ALL SELECT c.conv, c.seq, w.depth + 1, false FROM walk w JOIN linked c ON c.conv = w.conv AND c.parent = w.seq),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY depth, seq) AS place FROM walk)
SELECT c.conv, c.id AS call_id, c.seq, w.depth, w.place, CASE WHEN c.role <> 'user' THEN 'bad_json' WHEN w.lost THEN 'lost_parent' WHEN a.n IS NULL THEN 'pending' ELSE 'ok' END AS status, coalesce(a.n, 0) AS n_results,
  '{"arguments":' || CASE WHEN c.role = 'user' THEN '{"role":"user","text":' || to_json(c.text) || ',"turn":' || c.seq || '}' ELSE 'null' END || ',"call_id":"' || c.id || '","depth":' || w.depth
  || ',"name":"' || CASE WHEN c.role = 'user' THEN 'reply' ELSE c.role END || '","result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}' AS json
FROM calls c JOIN placed w ON w.conv = c.conv AND w.seq = c.seq LEFT JOIN answers a ON a.conv = c.conv AND a.seq = c.seq
UNION ALL SELECT a.conv, 'c' || a.conv || '-' || a.seq, a.seq + 1, NULL, NULL, 'no_call', a.n,
  '{"arguments":null,"call_id":"c' || a.conv || '-' || a.seq || '","depth":null,"name":null,"result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}'
FROM answers a ANTI JOIN calls c ON c.conv = a.conv AND c.seq = a.seq
"""
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""


#: CRC-32 in SQL: the table of the bytes, and the checksum of a text expression.
CRC_TABLE = """poly AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM poly WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text, where crc is one of the tables read."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)::BIGINT"""


OP10_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
lined AS (SELECT *, (sum(size) OVER (ORDER BY doc_id) - size)::BIGINT AS before, (sum(size) OVER ())::BIGINT AS total, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM d),
cut AS (SELECT *, least(7, (2 * before + size) * 8 // (2 * total))::INT AS shard FROM lined)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM cut
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


#: Levels are lists of digests; where the fanout is 2 a node's sibling stands at its number with the last bit flipped.
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, {crc_sql("doc_id::VARCHAR")} % 7 = 0 AS touched,
  sha256({_field("doc_id::VARCHAR")} || {_field("source")} || {_field("lang")} || {_field("n_chars::VARCHAR")} || {_field("text")}) AS leaf,
  sha256({_field("doc_id::VARCHAR")} || {_field("source")} || {_field("lang")} || {_field("(n_chars + 1)::VARCHAR")} || {_field("text")}) AS other FROM documents, crc),
low AS (SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM d GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM low WHERE len(nodes) > 1),
subs AS (SELECT lang, level AS depth, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS no FROM low WHERE len(nodes) = 1),
high AS (SELECT 0 AS level, list(subroot ORDER BY no) AS nodes FROM subs
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM high WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1),
steps AS (SELECT d.doc_id, low.level AS lvl, (d.idx >> low.level)::BIGINT AS own, low.nodes AS nodes FROM d JOIN low ON low.lang IS NOT DISTINCT FROM d.lang WHERE len(low.nodes) > 1
  UNION ALL SELECT d.doc_id, 1000 + high.level, (subs.no >> high.level)::BIGINT, high.nodes FROM d JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang, high WHERE len(high.nodes) > 1),
paths AS (SELECT doc_id, list({{'side': own % 2, 'hash': coalesce(nodes[xor(own, 1) + 1], '')}} ORDER BY lvl) AS path FROM steps GROUP BY doc_id),
folds AS (SELECT d.doc_id, d.leaf, subs.subroot, coalesce(p.path, []) AS path, CASE WHEN d.touched AND d.other IS NOT NULL THEN d.other ELSE d.leaf END AS start FROM d JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang LEFT JOIN paths p ON p.doc_id = d.doc_id),
done AS (SELECT *, list_reduce(list_prepend({{'side': 0, 'hash': start}}, path), lambda a, s: {{'side': 0, 'hash': sha256(CASE WHEN s.side = 1 THEN s.hash || a.hash ELSE a.hash || s.hash END)}}).hash AS folded_root FROM folds)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda s: s.hash), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done, top
"""

OP12_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s FROM split),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
shared AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS p, any_value(b.n) AS q, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (p + q - common)),
walk AS (SELECT rep, rep AS other FROM classes UNION SELECT w.rep, l.b FROM walk w JOIN links l ON l.a = w.other),
least AS (SELECT rep, min(other) AS low FROM walk GROUP BY rep)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(l.low, d.doc_id) AS component_id, coalesce(l.low, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s AND len(d.s) > 0 LEFT JOIN least l ON l.rep = c.rep
"""
#: Words one edit apart have a common cut: of both at the same place, or of the longer one.
OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
each_run AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM each_run, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS cut FROM places),
near AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
firsts AS (SELECT near.word, min(other) AS form, any_value(top) AS form_n, any_value(n_near) AS n_near FROM near JOIN best ON best.word = near.word AND near.n = best.top GROUP BY near.word),
formed AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.form_n >= 10 * w.n THEN f.form END AS form, CASE WHEN f.form_n >= 10 * w.n THEN f.form_n END AS form_n FROM words w LEFT JOIN firsts f ON f.word = w.word),
walk AS (SELECT word, word AS root, form AS up FROM formed UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.up)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.up IS NULL
"""


def queries() -> dict[str, Query]:
    found = {f.__name__: f for f in (op1_decontamination, op2_html_text, op3_simhash, op4_tool_calls, op5_exact_dedup, op6_byte_bpe, op7_language, op8_licenses, op9_language_model, op10_sharding, op11_merkle, op12_minhash, op13_spelling)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_tool_calls": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op8_licenses": licenses.oracle(), "op10_sharding": OP10_SQL, "op11_merkle": OP11_SQL, "op12_minhash": OP12_SQL, "op13_spelling": OP13_SQL}
