"""The numbered queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.tables import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.pii import drawn_key, pseudonymise

    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), drawn_key(spark), counts="n_replaced")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.quality import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.packing import pack_in_order

    return pack_in_order(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.packing import pack_best_fit

    return pack_best_fit(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.bpe import digest_documents

    return digest_documents(documents(spark, sf_dir))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.embeddings import near_embeddings

    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.substrings import dedup_substrings

    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.fingerprint import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.sharding import assign_shards

    return assign_shards(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.conversations import damaged, repair

    return repair(damaged(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "copies")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.counts import count_tokens

    return count_tokens(documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.resampling import resample

    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_pseudonyms, op2_quality, op3_ordered_packing, op4_best_fit_packing, op5_bpe, op6_multi_index, op7_bucket_pointer_dedup, op8_fingerprints, op9_hyperminhash, op10_hash_tree_sharding, op11_conversation_repair, op12_token_counts, op13_importance_resampling)}
#: the table of CRC-32, and the checksum of a text column
CRC_TABLE = "tb AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def crc_sql(column: str) -> str:
    bytes_of = f"list_transform(range(0, length(hex(encode({column}))) // 2), lambda p: CAST('0x' || substr(hex(encode({column})), 2 * p + 1, 2) AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {bytes_of}, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    # the exact links; the index finds all of them on the small tables
    "op6_multi_index": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
re AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT links.b, re.root FROM re JOIN links ON links.a = re.id),
cp AS (SELECT id, min(root) AS component_id FROM re GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN cp ON cp.id = vec_id
""",
    "op7_bucket_pointer_dedup": """
WITH h AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS gram FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS p FROM h)),
f AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM g JOIN f USING (gram) WHERE least < doc_id),
r AS (SELECT doc_id, p, count(*) FILTER (q IS NULL OR p > q + 50) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, h, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY run) AS later, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS n FROM s JOIN h USING (doc_id)),
o AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN n = 1 THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * b + 1, 2 * (COALESCE(later, length(h) // 2) - b)), '' ORDER BY n) AS kept FROM k GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(kept, h))) AS kept_sha256 FROM h LEFT JOIN o USING (doc_id)
""",
    "op9_hyperminhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
ed AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
re AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT ed.b, re.root FROM re JOIN ed ON ed.a = re.id),
cp AS (SELECT id, min(root) AS component_id FROM re GROUP BY 1)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN cp ON cp.id = doc_id
""",
    # a forward programme that keeps the best edits of each state: nothing yet, system, user, assistant
    "op11_conversation_repair": rf"""
WITH RECURSIVE {CRC_TABLE},
rw AS (SELECT COALESCE(CAST(conv_id AS VARCHAR), ' ') AS k, conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kd AS (SELECT name, {crc_sql("name")} % 20 AS kind FROM (SELECT DISTINCT name FROM rw), tb),
dm AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM rw JOIN kd USING (name)),
od AS (SELECT k, turn, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM dm),
os AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY n) AS seen FROM od),
ft AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
  CASE substr(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS c, substr(role, 1, 1) || substr(lead(role) OVER (PARTITION BY k ORDER BY n), 1, 1) AS pair, lead(role) OVER (PARTITION BY k ORDER BY n) IS NOT NULL AS paired FROM os),
gp AS (SELECT * FROM (VALUES (0, 1, ''), (0, 2, ''), (0, 3, 'user:'), (1, 2, ''), (1, 3, 'user:'), (2, 3, ''), (2, 2, 'assistant:'), (3, 2, ''), (3, 3, 'user:')) v(f, g, said)),
en AS (SELECT * FROM (VALUES (0, 0, ''), (1, 2, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 1, 'assistant:' || chr(10)), (3, 0, '')) v(f, more, tail)),
wy AS (SELECT k, n, f, f AS g, 2 AS price, 'D' AS edit, '' AS line FROM ft, en
 UNION ALL SELECT k, n, f, g, 5 * CAST(said <> '' AS INTEGER) + 5 * CAST(fault = 'truncated' AS INTEGER) + CAST(kept = 0 AS INTEGER), CASE WHEN said <> '' THEN 'I' ELSE '' END || CASE kept WHEN 1 THEN 'K' ELSE 'R' END,
  CASE WHEN said <> '' THEN said || chr(10) ELSE '' END || CASE kept WHEN 1 THEN role ELSE CASE g WHEN 2 THEN 'user' ELSE 'assistant' END END || ':' || text || chr(10)
  FROM ft, gp, (VALUES (0), (1)) v(kept) WHERE fault NOT IN ('blank', 'duplicate') AND CASE kept WHEN 1 THEN c = g ELSE g > 1 AND c <> g END),
dp AS (SELECT k, CAST(0 AS BIGINT) AS n, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT k FROM rw)
 UNION ALL SELECT k, n, state, b.cost, b.audit, b.said FROM (SELECT dp.k, wy.n, wy.g AS state, min_by({{'cost': cost + price, 'audit': audit || edit, 'said': said || line}}, (cost + price, audit || edit)) AS b FROM dp JOIN wy ON wy.k = dp.k AND wy.n = dp.n + 1 AND wy.f = dp.state GROUP BY 1, 2, 3)),
sz AS (SELECT k, count(*) AS size, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (paired AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM ft GROUP BY 1),
ids AS (SELECT DISTINCT k, conv_id FROM rw),
fn AS (SELECT k, min_by({{'cost': cost + 5 * more, 'audit': audit || repeat('I', more), 'said': said || tail}}, (cost + 5 * more, audit || repeat('I', more))) AS b FROM dp JOIN en ON en.f = dp.state LEFT JOIN sz USING (k) WHERE dp.n = COALESCE(size, 0) GROUP BY 1)
SELECT conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit, sha256(substr(b.said, 1, length(b.said) - 1)) AS repaired_sha256 FROM ids JOIN fn USING (k) LEFT JOIN sz USING (k)
""",
    "op13_importance_resampling": rf"""
WITH {CRC_TABLE},
tx AS (SELECT row_number() OVER () AS r, doc_id, text, TRUE AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, FALSE FROM benchmark),
ws AS (SELECT r, doc_id, own, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM tx),
fe AS (SELECT r, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM ws),
bk AS (SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM fe), tb),
ct AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM fe JOIN bk USING (f) GROUP BY 1),
al AS (SELECT COALESCE(sum(s), 0) AS s_all, COALESCE(sum(t), 0) AS t_all FROM ct),
gn AS (SELECT b, floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS g FROM ct, al),
wt AS (SELECT r, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM fe JOIN bk USING (f) JOIN gn USING (b) WHERE own GROUP BY 1),
sc AS (SELECT r, doc_id, len(w) >= 20 AS long, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight, COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM ws LEFT JOIN wt USING (r) WHERE own),
rk AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY long) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= 25 * n // 100 THEN place END AS rank FROM rk
""",
}
