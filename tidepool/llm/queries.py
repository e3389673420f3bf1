"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe_automaton as bpe_op
from tidepool.llm import decontamination as leak_op
from tidepool.llm import hmm_scoring as hmm_op
from tidepool.llm import language_id as language_op
from tidepool.llm import minhash_dedup as minhash_op
from tidepool.llm import periodic_runs as runs_op
from tidepool.llm import phrase_dedup as phrase_op
from tidepool.llm import quality_classifier as quality_op
from tidepool.llm import quality_rules as rules_op
from tidepool.llm import run_length_dedup as repeat_op
from tidepool.llm import source_divergence as source_op
from tidepool.llm import url_filters as url_op
from tidepool.llm import warc as warc_op
from tidepool.llm.runtime import documents, remainder, shared_folder

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_op.near_duplicates(documents(spark, sf_dir)).drop("row_key")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_op.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def removal_digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(repeat_op.remove_repeats(documents(spark, sf_dir)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules_op.quality_rules(docs, rules_op.fit_rules(docs, labels))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_op.train(docs, remainder(F.col("doc_id"), 4) != 2)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return language_op.language_id(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_op.train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality_op.quality_scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_op.url_filters(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_op.rules_frame(spark, URL_RULES))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_op.remove_phrases(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = remainder(F.col("doc_id"), 7)
    scores = hmm_op.hmm_scores(documents(spark, sf_dir), part != 2)
    return scores.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), r(verdict, host, path, rule) AS (
  VALUES ('block', 'com', '/en/', 'com/en/'), ('allow', 'example.com', '/en/7', 'example.com/en/7'), ('block', 'net', '/de/', 'net/de/'),
         ('block', 'example.net', '/de/8', 'example.net/de/8'), ('block', 'org', '/es/', 'org/es/')
), m AS (
  SELECT u.page_id, u.host, u.path, arg_max(r.rule, length(r.host) + length(r.path)) AS rule, arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM u) u JOIN r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path)
  GROUP BY u.page_id, u.host, u.path
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id IS NOT DISTINCT FROM m.page_id AND u.host = m.host AND u.path = m.path
"""

def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    trip = bpe_op.bpe_round_trip(docs, path)
    return trip.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of documents whose h = crc32(doc_id) ends in 0, the words from a on repeat the p words at a."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / F.lit(10)), F.col("n")
    told = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    told = told.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)) + 1)
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return told.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(collapsed: DataFrame) -> DataFrame:
    """The contract's columns: the run with most periods (of equal ones the first), and digests of all runs and of the text left."""
    kind = "struct<start: long, length: long, period: long>"
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    told = collapsed.withColumn("best", best)
    return told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(runs_op.collapse_runs(with_periods(documents(spark, sf_dir))))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    warc_op.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = warc_op.read_archives(spark, path, strict=True).where(F.col("record_type").isin("response", "revisit"))
    return back.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('{_LETTERS}', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS digest FROM p),
o AS (SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS first_id FROM d WINDOW w AS (PARTITION BY hex ORDER BY page_id NULLS LAST))
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_id END AS refers_to FROM o
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_op.source_divergence(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT DISTINCT k, lang, term FROM w) GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept t ON t.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS p FROM grid WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM grid GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f) WHERE part = 'pair' OR rank <= 200
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_url_filters": op7_url_filters,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_hmm_scoring": op10_hmm_scoring,
    "op11_warc": op11_warc,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {"op7_url_filters": OP7_SQL, "op11_warc": OP11_SQL, "op13_source_divergence": OP13_SQL}
