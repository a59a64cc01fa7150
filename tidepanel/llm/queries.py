"""One registered query per corpus operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import alignment, chat, language, mixing, nearduplicates, oracles, packing, pages, pii, quality, sharding, spelling, vectors
from tidepanel.llm.common import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def register(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@register
def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


@register
def op2_setsketch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearduplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register
def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.transform("entities", lambda e: e["type"]).alias("types"))


@register
def op4_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_links(table(spark, sf_dir, "embeddings"))


@register
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vectors.exact_top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


@register
def op6_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@register
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@register
def op8_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(*chat.prefix_tree(chat.with_probe(table(spark, sf_dir, "conversations"))))


@register
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, blocks = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), block_words=2_000)
    taken = mixing.taken_per_document(documents, blocks)
    return taken.select("doc_id", "size", "source_size", "target", "taken", "places")


@register
def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(table(spark, sf_dir, "documents"))


@register
def op12_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op13_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


LLM_ORACLES |= {
    "op1_wrapper_text": oracles.OP1,
    "op2_setsketch_duplicates": oracles.OP2,
    "op4_embedding_duplicates": oracles.OP4,
    "op5_exact_top_k": oracles.OP5,
    "op8_prefix_tree_chat": oracles.OP8,
    "op11_permuterm_variants": oracles.OP11,
}
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
