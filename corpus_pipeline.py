"""A corpus pipeline made of the training-data operators: quality, near-duplicates, repeats, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of ``documents`` (doc_id, text, lang, source, n_chars); ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm import decontamination, minhash_dedup, quality_classifier, run_length_dedup
from tidepool.llm.queries import bpe_digests
from tidepool.llm.runtime import discard, documents, remainder, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Passages of some fifty words go here, which are shorter than the 400 bytes of query op3.
REPEAT = run_length_dedup.Settings(length=240, least=240)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from labelled rows of its input, as query op6 does.

    Null and empty texts have the score of the model's bias; rows with a null doc_id are scored too, and repeated rows alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return quality_classifier.quality_scores(docs.select(*COLUMNS), model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, once if its row is repeated.

    Documents without words are in no group and stay. So do rows with a null doc_id whose group has no other.
    """
    found = minhash_dedup.near_duplicates(docs).where("kept").select("row_key", F.col("doc_id").alias("id")).distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    # Spelt so that only the key deals out the rows: the window below then needs no other shuffle of the texts.
    same = F.coalesce(F.col("doc_id") == F.col("id"), F.col("doc_id").isNull() & F.col("id").isNull())
    kept = keyed.join(found.hint("merge"), (F.col("key") == F.col("row_key")) & same)
    once = Window.partitionBy("key", "doc_id").orderBy("lang", "source", "n_chars")
    return kept.withColumn("nth", F.row_number().over(once)).where("nth = 1 OR text IS NULL").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 240 bytes that start elsewhere too; cut characters go whole, and documents left with no text go.

    Null and empty texts stay as they are. Of rows with one text all lose it.
    """
    marked = docs.select(*COLUMNS, F.col("text").isNull().alias("no_text"))
    removed = run_length_dedup.remove_repeats(marked, REPEAT, carry=("lang", "source", "n_chars", "no_text"), as_text=True)
    cut = F.size("span_starts") > 0
    stay = removed.where(~cut | F.col("kept").rlike("[^\\x20\\x09-\\x0D]"))
    text, n_chars = F.when(~F.col("no_text"), F.col("kept")), F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return stay.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever its length. Null and empty texts hold none; rows with one doc_id and text go or stay together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    hits = decontamination.contaminated(keyed, benchmark, carry=("key",))
    found = stored(hits.select(F.col("key").alias("bad"), F.col("doc_id").alias("id")).distinct())
    return keyed.join(found, (F.col("key") == F.col("bad")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, as query op8 has them; null texts count as empty, repeated rows stay."""
    import public_tokenizers

    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("repeated strings", repeats), ("benchmark leaks", leaks), ("bpe round trip", tokens)]

#: SQL expresses none of the stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = documents(spark, sf_dir)
    kept = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if kept is not None:
            discard(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
