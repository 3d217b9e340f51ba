"""The registered queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, ctw, html_density, line_spread, minhash, ogg, packing, periodic_runs, substring_sketch, target_quality, viterbi, warc, wavelet
from .common import read_table


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.write_media(read_table(spark, sf_dir, "documents")))


def op2_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode_and_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_main_text(read_table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = target_quality.score_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return scored.drop("text")


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")))


def op8_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(read_table(spark, sf_dir, "documents"))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_shards(shards)


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_spread.remove_spread_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(read_table(spark, sf_dir, "conversations"))


def op13_substring_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_sketch.remove_repeated_passages(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ogg_media,
        op2_minhash_components,
        op3_sentencepiece_viterbi,
        op4_html_main_text,
        op5_best_fit_packing,
        op6_quality_llr,
        op7_warc_chunks,
        op8_ctw_scores,
        op9_wavelet_shards,
        op10_line_spread,
        op11_periodic_runs,
        op12_conversation_repair,
        op13_substring_sketch,
    )
}
ORACLE_SQL: dict[str, str] = {"op10_line_spread": line_spread.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE, "op13_substring_sketch": substring_sketch.ORACLE}
