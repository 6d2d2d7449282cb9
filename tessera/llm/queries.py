"""The queries of this package and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import sql
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.filter_audit import audit_filters
from tessera.llm.fim import Fim, fill_in_middle, restored
from tessera.llm.html_extract import extract_text
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import quality_rules
from tessera.llm.secrets import scan_secrets
from tessera.llm.sharding import shard_records
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.token_store import StoreFormat, read_store, write_store
from tessera.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_shingles, component_id and kept for every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """size, source_size, target and taken for every document."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_pack_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot for every document."""
    return pack(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to the store and read back: start, n_tokens, ids_crc32."""
    import public_tokenizers

    fmt = StoreFormat(public_tokenizers.path("word_bpe_49k.json"))
    folder = write_store(_table(spark, sf_dir, "documents"), fmt)
    return read_store(spark, folder, fmt).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for every document."""
    rows = quality_rules(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 for every document."""
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, by its digest, with the forest's verdict."""
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ordinal", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"), keep_largest=True)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, for every language, and their Shapley values times 120."""
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_shard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards are near equal in bytes."""
    rows = shard_records(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into lines and rearranged, by digests of the output and of the text restored from it."""
    fim = Fim()
    rows = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), fim)
    sha = lambda c: F.sha2(c, 256)
    back = restored(F.col("fim.output"), F.col("fim.form"), fim)
    return rows.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha("fim.output").alias("output_sha256"), sha(back).alias("restored_sha256"))


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_pack_lengths": op3_pack_lengths,
    "op4_html_text": op4_html_text,
    "op5_token_store": op5_token_store,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_shard_records": op12_shard_records,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": sql.OP1,
    "op2_mix_sources": sql.OP2,
    "op6_quality_rules": sql.OP6,
    "op8_warc": sql.OP8,
    "op10_exact_dedup": sql.OP10,
    "op11_filter_audit": sql.OP11,
    "op12_shard_records": sql.OP12,
    "op13_fill_in_middle": sql.OP13,
}
