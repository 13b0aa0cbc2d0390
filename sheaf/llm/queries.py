"""The queries over the operators of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, edits, language_model, licenses, quality, sharding, simhash, token_counts, token_output
from .common import table


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encoded_digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.edit_fingerprints(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), split_pattern())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 16)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=2, words=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op4: lengths and digests of the edited texts."""
    return op4_edits(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op10: the parting, the counts and the base."""
    return op10_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def shards_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op8: sizes, equal texts in one shard, slots without gaps, and no shard far from its share."""
    shards = op8_sharding(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    own = shards.join(texts, "doc_id")
    apart = own.groupBy("digest").agg(F.countDistinct("shard").alias("shards")).where("shards > 1").select("digest", F.lit(True).alias("apart"))
    per = shards.groupBy("shard").agg((F.max("slot") + 1 == F.count(F.lit(1))).alias("gapless"), F.sum("size").alias("bytes"), F.countDistinct("slot").alias("slots"), F.count(F.lit(1)).alias("n"))
    total = shards.agg((F.sum("size") / 16).alias("mean"), F.max("size").alias("largest"))
    near = per.join(F.broadcast(total)).select("shard", (F.col("gapless") & (F.col("slots") == F.col("n"))).alias("gapless"), (F.abs(F.col("bytes") - F.col("mean")) <= F.greatest(F.col("largest"), 0.02 * F.col("mean"))).alias("near_share"))
    return own.join(apart, "digest", "left").join(near, "shard").select("doc_id", "size", F.coalesce(~F.col("apart"), F.lit(True)).alias("together"), "gapless", "near_share")


def verbatim_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5's pairs those whose document holds the item's text as it stands."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    found = op5_decontamination(spark, sf_dir).select("doc_id", "item_id").join(texts, "doc_id").join(items, "item_id")
    return found.where(F.contains("text", "item")).select("doc_id", "item_id").distinct()


#: Notices that are no part of another template.
NOTICES = ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-4.0", "BSD-3-Clause", "CC-BY-SA-4.0", "All-rights-reserved-notice")


def verbatim_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6's parts those that are a notice as it stands in the text."""
    notices = spark.createDataFrame([(n, licenses.TEMPLATES[n]) for n in NOTICES], "license string, notice string")
    found = op6_licenses(spark, sf_dir).select("doc_id", "license").join(F.broadcast(notices), "license")
    return found.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where(F.contains("text", "notice")).select("doc_id", "license").distinct()


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op2: bytes, and that no text has more tokens than bytes."""
    return op2_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes")).alias("fewer_tokens"))


#: crc32 of a document's id as text, from the polynomial; DuckDB has no function for it.
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT)))))"
_NOTICE_ROWS = ", ".join("('{}', '{}')".format(n, licenses.TEMPLATES[n].replace("'", "''")) for n in NOTICES)
_ORACLES = {
    "edited_texts": """SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2)) AS edited_sha256
        FROM (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (ORDER BY doc_id))""",
    "token_statistics": rf"""WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), chr(10)) AS words FROM documents),
        t AS (SELECT doc_id, held_out, unnest(words) AS word FROM d), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score FROM t LEFT JOIN c USING (word), n GROUP BY doc_id, held_out""",
    "shards_of_groups": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, true AS together, true AS gapless, true AS near_share FROM documents",
    "verbatim_passages": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "verbatim_licenses": f"SELECT DISTINCT doc_id, license FROM documents JOIN (VALUES {_NOTICE_ROWS}) AS v(license, notice) ON contains(text, notice)",
    "text_bytes": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, true AS fewer_tokens FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_output, op2_token_counts, op3_quality, op4_edits, op5_decontamination, op6_licenses, op7_bpe, op8_sharding, op9_simhash, op10_language_model,
            edited_texts, token_statistics, shards_of_groups, verbatim_passages, verbatim_licenses, text_bytes,
        )
    }


def oracle_sql() -> dict[str, str]:
    """SQL that DuckDB runs on the same tables, for what it can express of the operators."""
    return dict(_ORACLES)
