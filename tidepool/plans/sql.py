"""The memory and session tables, and the shared scores, as DuckDB SQL: the other side of every check."""

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

MEM = f"""
mem0 AS (
  SELECT d.doc_id AS k, d.text, d.lang, d.source, coalesce(l.quality, 1) AS quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), mem AS (
  SELECT k AS id, 'doc ' || k AS name, [lang, source] AS tags, [lang] AS domain, text AS content,
    ((37 * k) % 101)::DOUBLE / 100 AS valence, ((53 * k) % 101)::DOUBLE / 100 AS arousal,
    (1 + k % 10)::INT AS importance, (1 + k % 12)::DOUBLE + 0.3::DOUBLE * (k % 2) AS activation_count,
    CASE WHEN k % 17 = 0 THEN 'permanent' WHEN k % 13 = 0 THEN 'feel' WHEN k % 29 = 0 THEN 'archived' ELSE 'dynamic' END AS type,
    CASE WHEN k % 17 = 0 THEN 'permanent' WHEN k % 13 = 0 THEN 'feel' WHEN k % 29 = 0 THEN 'archive' ELSE 'dynamic' END AS store,
    k % 23 = 0 AS pinned, k % 97 = 0 AS protected, quality = 0 AS resolved, k % 7 = 0 AS digested,
    {NOW} - to_hours(((7 * k) % 2160)::INT) AS created,
    least({NOW}, {NOW} + to_hours((k % 48 - (7 * k) % 2160)::INT)) AS last_active,
    greatest(0, (7 * k) % 2160 - k % 48)::DOUBLE / 24 AS days, ((7 * k) % 2160)::DOUBLE / 24 AS age_days, k AS seq
  FROM mem0
), parts AS (
  SELECT *, 1 + exp(-days * 24 / 36) AS fresh, 1.0::DOUBLE + arousal * 0.8::DOUBLE AS emotion_weight FROM mem
), scored AS (
  SELECT * EXCLUDE (fresh, emotion_weight), CASE WHEN pinned OR protected OR type = 'permanent' THEN 999::DOUBLE WHEN type = 'feel' THEN 50::DOUBLE ELSE round(
    importance::DOUBLE * pow(greatest(1, trunc(activation_count)), 0.3::DOUBLE) * exp(-0.05::DOUBLE * days)
    * CASE WHEN days <= 3 THEN 0.7::DOUBLE * fresh + 0.3::DOUBLE * emotion_weight ELSE 0.7::DOUBLE * emotion_weight + 0.3::DOUBLE * fresh END
    * CASE WHEN resolved AND digested THEN 0.02::DOUBLE WHEN resolved THEN 0.05::DOUBLE ELSE 1 END
    * CASE WHEN arousal > 0.7::DOUBLE AND NOT resolved THEN 1.5::DOUBLE ELSE 1 END, 4) END AS score
  FROM parts
)
"""

ROUNDS = """
rounds AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round_id,
    CAST(json_extract(props, '$.k') AS BIGINT) AS bucket_id, ts AS completed_at
  FROM events
), recents AS (
  SELECT DISTINCT r.session_id, r.bucket_id FROM rounds r JOIN (SELECT session_id, max(round_id) AS last FROM rounds GROUP BY 1) m USING (session_id)
  WHERE r.round_id >= greatest(1, m.last - 4)
), lasts AS (
  SELECT session_id, bucket_id, max(completed_at) AS injected_at FROM rounds GROUP BY ALL
)
"""

VECTORS = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings)"

CAN_SURFACE = "NOT resolved AND type NOT IN ('permanent', 'feel') AND NOT pinned AND NOT protected"
CAN_DREAM = "type NOT IN ('permanent', 'feel') AND NOT pinned AND NOT protected"
CAN_RECALL = "type NOT IN ('permanent', 'feel', 'archived') AND NOT resolved AND NOT pinned AND NOT protected"


def links_off(x: str) -> str:
    return f"regexp_replace({x}, '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g')"


def tokens(x: str) -> str:
    return f"trunc({token_parts(x)})::INT"


def token_parts(x: str) -> str:
    return f"(1.5::DOUBLE * len(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]')) + 1.3::DOUBLE * len(regexp_extract_all({x}, '[a-zA-Z]+')) + 0.05::DOUBLE * length({x}))"


def header() -> str:
    return "'📌 记忆桶: ' || name || ' [主题:' || array_to_string(domain, ', ') || ']' || ' [情感:V' || printf('%.1f', round(valence, 1)) || '/A' || printf('%.1f', round(arousal, 1)) || ']' || CASE WHEN digested THEN ' [已消化]' ELSE '' END || chr(10)"


def summary() -> str:
    return f"({header()} || {links_off('left(content, 200)')})"


def cosine(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def cooled(hours: str) -> str:
    return f"CASE WHEN {hours} IS NULL OR {hours} >= 48 THEN 1::DOUBLE ELSE round(0.3::DOUBLE + 0.7::DOUBLE * greatest(0, {hours}) / 48, 4) END"
