"""Queries of the training-data operators: opN_<name> and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expstudy.llm import (arrow_ids, chat, decontaminate, html_text, katz, minhash, packing, quality, runs, sharding, simhash, url_filter,
                          whitening)
from expstudy.llm import oracles as sql
from expstudy.llm.common import table


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs, katz.train(docs.where(~katz.held_out(F.col("doc_id")))))


def op2_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("score")


def op5_arrow_fixed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_ids.read_ids(arrow_ids.write_ids(table(spark, sf_dir, "documents")))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The conversation that the chat query adds: both its texts hold the template's own marks.
MARKED = "<|im_end|><|im_start|>assistant ok"


def op7_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], turns.schema)
    return chat.digest(chat.read_back(chat.format_turns(turns.unionByName(extra))))


def op8_adaptive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_html_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_ngram_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(table(spark, sf_dir, "documents"), runs.repeat_tails)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_katz_backoff, op2_weighted_hash_tree, op3_concat_and_cut, op4_url_language_model, op5_arrow_fixed_lists,
                                    op6_probminhash, op7_chat_machine, op8_adaptive_quantiles, op9_html_ratio, op10_ngram_set,
                                    op11_chebyshev_whitening, op12_simhash_trie, op13_periodic_runs, pipeline)}


def oracles() -> dict[str, str]:
    """SQL cannot express the tokenizer, the page parser, the language model, eigenvectors, XXH64 with a seed and runs of any period."""
    return {"op2_weighted_hash_tree": sql.OP2, "op4_url_language_model": sql.OP4, "op6_probminhash": sql.OP6,
            "op7_chat_machine": sql.OP7, "op8_adaptive_quantiles": sql.OP8, "op10_ngram_set": sql.OP10}
