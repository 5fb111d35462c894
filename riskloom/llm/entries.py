"""Queries of this subpackage, with production parameters, over whole tables; and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import chat, jaccard, language, media, mixing, packing, quality, repeats, resampling, search, sstable, token_counts, vector_codes
from riskloom.llm.common import in_training_folds, shared_path, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op2_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train_on_folds(documents)
    rows = documents.select("doc_id", (~in_training_folds(F.col("doc_id"))).alias("held_out"), "text")
    return language.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit_on_folds(documents, table(spark, sf_dir, "labels"))
    rows = documents.select("doc_id", (~in_training_folds(F.col("doc_id"))).alias("held_out"), "text")
    return quality.classify(rows, model).select("doc_id", "held_out", "score", "predicted")


def op6_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op7_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-shards")
    sstable.write_shards(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return sstable.read_shards(spark, path)


def op8_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op9_rtree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op10_snapshot_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op11_exact_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_sort_count_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), order=1, buckets=10_000, percent=10, min_words=20, seed=2024)


def op13_run_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_png_media": op1_png_media,
        "op2_wordpiece_counts": op2_wordpiece_counts,
        "op3_pareto_mix": op3_pareto_mix,
        "op4_viterbi_language": op4_viterbi_language,
        "op5_neighbour_quality": op5_neighbour_quality,
        "op6_differencing_pack": op6_differencing_pack,
        "op7_sstable_tokens": op7_sstable_tokens,
        "op8_impact_topk": op8_impact_topk,
        "op9_rtree_jaccard": op9_rtree_jaccard,
        "op10_snapshot_chat": op10_snapshot_chat,
        "op11_exact_vector_codes": op11_exact_vector_codes,
        "op12_sort_count_resampling": op12_sort_count_resampling,
        "op13_run_index_repeats": op13_run_index_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_pareto_mix": mixing.ORACLE_SQL,
        "op8_impact_topk": search.ORACLE_SQL,
        "op10_snapshot_chat": chat.ORACLE_SQL,
        "op11_exact_vector_codes": vector_codes.oracle_sql(),
        "op12_sort_count_resampling": resampling.ORACLE_SQL,
    }
