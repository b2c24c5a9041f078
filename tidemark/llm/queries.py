"""Registered queries of the subpackage; ``__spark_entry__`` adds them to the library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.session import tune
from tidemark.llm import exact_dedup, hard_negatives, knn, lines, mixing, near_dedup, packing, passages, pii, prefix_trie, quality, secret_scan, token_files, warc
from tidemark.llm import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: tune(spark).read.parquet(f"{sf_dir}/{table}.parquet"))
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


@_query("op1_exact_dedup", S.EXACT_DEDUP)
def _op1(read) -> DataFrame:
    return exact_dedup.deduplicate(read("documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op2_mix_sources", S.MIX)
def _op2(read) -> DataFrame:
    return mixing.mix(read("documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op3_secret_scan")
def _op3(read) -> DataFrame:
    return secret_scan.report(read("documents"))


@_query("op4_line_dedup", S.PASSAGES)
def _op4(read) -> DataFrame:
    return passages.repeated(read("documents")).drop("text_key", "keep_text_key")


@_query("op4_every_line_dedup", S.EVERY_LINE)
def _op4_every_line(read) -> DataFrame:
    return lines.repeated(read("documents"), min_words=1).drop("text_key", "keep_text_key")


@_query("op4_line_run_dedup")
def _op4_line_run(read) -> DataFrame:
    return lines.repeated(read("documents"), "run", 1).drop("text_key", "keep_text_key")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op5_minhash_near_dedup")
def _op5(read) -> DataFrame:
    return near_dedup.near_duplicates(read("documents"))


@_query("op6_pii", S.PII)
def _op6(read) -> DataFrame:
    return pii.report(read("documents"))


@_query("op7_warc_round_trip", S.WARC)
def _op7(read) -> DataFrame:
    return warc.round_trip(read("pages"))


@_query("op8_best_fit_packing")
def _op8(read) -> DataFrame:
    return packing.pack_documents(read("documents"), tokenizer_file())


@_query("op9_voronoi_top_k", S.TOP_K)
def _op9(read) -> DataFrame:
    return knn.search(read("embeddings"), F.col("vec_id") % 50 == 0)


@_query("op10_quality_classifier")
def _op10(read) -> DataFrame:
    docs = read("documents")
    return quality.judge(docs, quality.model_for(docs, read("labels")), quality.CLEAN, quality.CLEAN_LEAST)


@_query("op11_plane_files")
def _op11(read) -> DataFrame:
    return token_files.round_trip(read("documents"), tokenizer_file())


@_query("op12_threshold_negatives", S.NEGATIVES)
def _op12(read) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read("embeddings"), noisy, F.col("vec_id") % 50 == 0)


@_query("op13_prefix_trie", S.TRIE)
def _op13(read) -> DataFrame:
    return prefix_trie.trie(read("conversations"))
