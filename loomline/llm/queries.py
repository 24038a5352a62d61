"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm import alignment, bitpack, bpe, fim, jaccard, langid, line_frequency, media, packing, sharding, token_counts, toxicity, warc
from loomline.llm.common import documents

#: The end mark of the word vocabulary.
WORD_END_ID = 1
#: A document of more tokens is over the limit of op11.
TOKEN_LIMIT = 512


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.Topology.even(8)
    return sharding.shard_documents(documents(spark, sf_dir), tree, tree.with_new_region(8))


def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality_by_lines(documents(spark, sf_dir))


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.resolve_revisits(warc.parse_records(warc.records_of_pages(pages)))


def op6_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op6_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_sequences(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(documents(spark, sf_dir))


def op7_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.count_links(documents(spark, sf_dir))


def op8_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bitpack.pack_documents(documents(spark, sf_dir), path, bitpack.vocabulary_size(path), WORD_END_ID)


def op9_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_near_copies_apart(documents(spark, sf_dir))


def op11_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform_digests(documents(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_tree_sharding": op1_hash_tree_sharding,
    "op2_prefix_bpe": op2_prefix_bpe,
    "op3_nnpu_toxicity": op3_nnpu_toxicity,
    "op4_line_frequency": op4_line_frequency,
    "op5_revisit_resolution": op5_revisit_resolution,
    "op6_interleaved_media": op6_interleaved_media,
    "op6_page_sequences": op6_page_sequences,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op7_ngram_jaccard_links": op7_ngram_jaccard_links,
    "op8_bit_packed_ids": op8_bit_packed_ids,
    "op9_kneser_ney_language": op9_kneser_ney_language,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_token_counts": op11_prefix_token_counts,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLE_SQL: dict[str, str] = {"op4_line_frequency": line_frequency.ORACLE, "op5_revisit_resolution": warc.ORACLE, "op7_ngram_jaccard": jaccard.ORACLE, "op12_fill_in_middle": fim.ORACLE}
