"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import shared_dir, table


def vocabulary(name: str) -> str:
    """A public vocabulary file's place; vocabularies are installed beside Python, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import write_and_read

    return write_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import report

    return report(table(spark, sf_dir, "documents"))


def op4_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_content_addressed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archive

    write_archive(table(spark, sf_dir, "pages"), path := shared_dir(spark))
    return read_records(spark, path)


def op6_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .addquant import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pack import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import report

    return report(table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whiten import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import report

    return report(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_repair_files": op2_repair_files,
        "op3_deletion_neighbourhood": op3_deletion_neighbourhood,
        "op4_unigram_counts": op4_unigram_counts,
        "op5_content_addressed_archive": op5_content_addressed_archive,
        "op6_additive_quantisation": op6_additive_quantisation,
        "op7_hilbert_shards": op7_hilbert_shards,
        "op8_vector_best_fit": op8_vector_best_fit,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_line_first_cleaning": op10_line_first_cleaning,
        "op11_benchmark_decontamination": op11_benchmark_decontamination,
        "op12_bit_sliced_whitening": op12_bit_sliced_whitening,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from . import decontam, linededup, quality, warc

    return {
        "op3_deletion_neighbourhood": linededup.SQL,
        "op5_content_addressed_archive": warc.SQL,
        "op10_line_first_cleaning": quality.SQL,
        "op11_benchmark_decontamination": decontam.SQL,
    }
