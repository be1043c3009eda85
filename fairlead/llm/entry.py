"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlead.llm.fuzzylines import dedup_lines
from fairlead.llm.media import media_documents
from fairlead.llm.merkle import merkle_documents
from fairlead.llm.minhash import near_duplicates
from fairlead.llm.mixing import mix_documents
from fairlead.llm.oracle import SQL
from fairlead.llm.packing import pack_documents
from fairlead.llm.paragraphs import repeated_paragraphs
from fairlead.llm.quality import judge
from fairlead.llm.quotes import link_conversations
from fairlead.llm.tokenfiles import token_documents
from fairlead.llm.toxicity import score_documents
from fairlead.llm.variants import spelling_variants
from fairlead.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_documents(_table(spark, sf_dir, "documents"))


def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(_table(spark, sf_dir, "conversations"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("failed_rules")


def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"), min_chars=1).select("doc_id", "text", "n_lines", "n_removed_lines")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_table(spark, sf_dir, "documents"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op11_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_documents(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [
        op1_media_chunks, op2_quote_linking, op3_best_fit_packing, op4_toxicity, op5_minhash_near_dedup, op6_quality_rules,
        op7_fuzzy_line_dedup, op8_warc, op9_source_mixing, op10_paragraph_dedup, op11_wavelet_tokens,
        op12_merkle_manifest, op13_spelling_variants, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The other operators train, pack, hash or route in ways that SQL has no words for; tests hold them to brute force, round
    trips or held-out accuracy."""
    return dict(SQL)
