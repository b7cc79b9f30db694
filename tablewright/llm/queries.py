"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bestfit_pack import pack_documents
from .common import scratch_root, table
from .decontaminate import find_contamination
from .html_density import extract_main_text
from .license_scan import scan_licenses
from .ngram_join import similar_components
from .quality_rules import quality_rules
from .rendezvous import rendezvous_shards
from .secrets import BASE, scan_secrets
from .suffix_dedup import remove_repeats
from .token_store import digests, write_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).drop("first")


@query
def op3_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    carry = ((F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = rendezvous_shards(table(spark, sf_dir, "documents"), "doc_id", [1.0] * 8, [1.0] * 9, carry)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")))
    path = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    # the ids are no names of files: what a document holds decides whether it declares for its folder
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"), named=False)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
