"""Queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import alignment, ann, bpe, conversations, langid, licenses, line_dedup, lm_score, minmax, packing, secrets, simhash, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), most=3, shingle=3)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.round("mean_log_score", 6).alias("mean_log_score"), F.round("log_score", 3).alias("log_score"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"), percent=85, words=5)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))
    return found.select("*", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256")).drop("lines")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_line_dedup, op2_neighbours, op3_packing, op4_secrets, op5_language, op6_near_duplicates, op7_lm_score, op8_bpe, op9_licenses, op10_top_k, op11_min_max, op12_conversations, op13_alignment)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: op10 in SQL: integer products of every query with every other row.
OP10_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dims AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM ok),
q AS (SELECT * FROM dims WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM q JOIN dims c ON q.d = c.d AND q.vec_id <> c.vec_id GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: op7 in SQL: how often other documents hold the word, pair and triple at each place, and the longest that one does.
OP7_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
t AS (SELECT doc_id, unnest(w) AS c, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, c, lag(c, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lag(c, 2) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM t),
x AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, doc_id) AS x1,
    CASE WHEN b IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY b, c, doc_id) END AS x2,
    CASE WHEN a IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY a, b, c, doc_id) END AS x3
  FROM g),
y AS (SELECT *, lag(x1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(x2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM x),
s AS (
  SELECT doc_id, CASE WHEN x3 > 0 THEN ln(x3 / p2) WHEN x2 > 0 THEN ln(0.4) + ln(x2 / p1) ELSE 2 * ln(0.4) + ln(greatest(x1, 1) / (SELECT count(*) FROM t)) END AS score
  FROM y),
r AS (SELECT doc_id, count(*) AS n, sum(score) AS score FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(score, 0), 3) AS log_score, round(score / n, 6) AS mean_log_score FROM d LEFT JOIN r USING (doc_id)
"""


#: Kinds of op4 for its SQL, written apart from the operator's rules: pattern, group, least length of the group.
OP4_KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
)


def _op4_sql() -> str:
    """op4 in SQL: the matches of a kind and the gaps between them are taken once a text; running sums of their lengths are positions."""

    def kind(order: int, name: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""
SELECT doc_id, '{name}' AS kind, {order} AS o, e - n AS s, e FROM (
  SELECT doc_id, length(hit) AS n, own, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(own) AS own, unnest(range(len(hits))) AS i
    FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)) AS own FROM d)))
WHERE own >= {least}"""

    found = " UNION ALL ".join(kind(n, *k) for n, k in enumerate(OP4_KINDS))
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
r AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  coalesce(string_agg({one}, ',' ORDER BY s, o) FILTER (WHERE o < 3), '') AS base, string_agg({one}, ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)
"""


#: op11 in SQL: shared shingles of all pairs that share one, and what links reach.
OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
t AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM d),
g AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM t),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id, doc_id AS low FROM t UNION SELECT e.v, r.low FROM r JOIN e ON r.doc_id = e.u WHERE r.low < e.v),
c AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t JOIN c USING (doc_id)
"""


#: op12 in SQL: damage, faults, and the cheapest edits turn by turn with the lines that they leave.
OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), x)) AS tab),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)) AS bytes
  FROM conversations),
h AS (SELECT k.*, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS kind FROM k, tab),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h JOIN (VALUES (1), (2)) AS n(copy) ON kind <> 0 AND (copy = 1 OR kind = 3)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM r),
p AS (SELECT *, place > min(place) OVER (PARTITION BY conv_id, role, text) AS seen FROM f),
g AS (
  SELECT *, role[1] AS i, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) AS before,
    CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n FROM g GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, n, {'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} AS s0, {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} AS s1,
    {'c': CAST(3 AS BIGINT), 'a': 'I', 't': ['user:']} AS s2, {'c': CAST(6 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, place, n, m0, m1, u, list_sort([m3, {'c': u.c + 3, 'a': u.a || 'I', 't': list_append(u.t, 'assistant:')}])[1]
  FROM (
    SELECT *, list_sort([m2] || list_transform([m0, m1, m3], lambda m: {'c': m.c + 3, 'a': m.a || 'I', 't': list_append(m.t, 'user:')}))[1] AS u
    FROM (
      SELECT w.conv_id, g.place, w.n,
        {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t} AS m0,
        list_sort([{'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + e + CASE WHEN i = 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K', 't': list_append(s0.t, role || ':' || text)}])[1] AS m1,
        list_sort([{'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t}]
          || list_transform([s0, s1, s3], lambda s: {'c': s.c + e + CASE WHEN i = 'u' THEN 0 ELSE 1000000000 END, 'a': s.a || 'K', 't': list_append(s.t, role || ':' || text)})
          || list_transform([s0, s1, s3], lambda s: {'c': s.c + e + 3, 'a': s.a || 'R', 't': list_append(s.t, 'user:' || text)}))[1] AS m2,
        list_sort([{'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t},
          {'c': s2.c + e + CASE WHEN i = 'a' THEN 0 ELSE 1000000000 END, 'a': s2.a || 'K', 't': list_append(s2.t, role || ':' || text)},
          {'c': s2.c + e + 3, 'a': s2.a || 'R', 't': list_append(s2.t, 'assistant:' || text)}])[1] AS m3
      FROM walk w JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 1000000000 END AS e FROM g) g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.place = w.pos + 1))),
ends AS (SELECT conv_id, list_sort([s0, s3])[1] AS best FROM walk WHERE pos = n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": _op4_sql(), "op7_lm_score": OP7_SQL, "op10_top_k": OP10_SQL, "op11_min_max": OP11_SQL, "op12_conversations": OP12_SQL}
