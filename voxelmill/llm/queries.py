"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import alignment, bpe, decontam, exact, html, minhash, pii, quality, repeats, secrets, sharding, token_counts, variants
from voxelmill.session import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.extract_pages(pages, html.fit(html.example_pages()))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), **minhash.COPIES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (quality.remainder(F.col("doc_id")) == quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_pre_tokens", "n_tokens")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.mark_contamination(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", "contamination")
    hit = decontam.hit_words(F.col("contamination"))
    listed = F.array_join(F.array_sort(F.transform("contamination.items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, id_cols=["doc_id"], ids=False)


#: The key of the registered query; a user passes a secret of their own.
PII_KEY = "an example key"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pii.pseudonymise(docs, PII_KEY)
    counts = [F.coalesce(F.col("pii_counts")[kind], F.lit(0)).alias(f"n_{kind}") for kind in pii.KINDS]
    return made.select("doc_id", F.col("pseudonymised").alias("text"), (F.size("pii_counts") > 0).alias("changed"), *counts)


#: Every so manieth run of letters, by checksum, loses a code point.
TYPO_EVERY = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(variants.runs(F.col("text"), "A-Za-z\u00C0-\u00FF", 6)).alias("run"))
    check = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.withColumn("h", check).select(F.when(F.col("h") % TYPO_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return variants.group_variants(variants.count_words(words, least_chars=6, least_count=5)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.measure(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.scan(docs, owner=F.col("source"), repository=F.col("doc_id"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")
    counts = [count("kind", kind) for kind in secrets.KINDS]
    judged = [count("verdict", told) for told in ("live", "example")]
    return found.select("doc_id", *counts, *judged, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query in globals().items() if name.startswith("op") and callable(query)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact.OP7_SQL, "op8_decontamination": decontam.OP8_SQL}
