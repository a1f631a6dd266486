"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specton.llm.common import staged, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import chat

    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    members = staged(chat.members(turns))
    return chat.digests(chat.conversations(members, staged(chat.tree(members, tokenizer_path()))))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import html

    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import neardup

    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import decontaminate

    return decontaminate.links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import licences

    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = lm.vocabulary(docs)
    return lm.score(docs, vocab, lm.fit(docs, vocab)).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import audit

    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specton.llm import resampling

    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from specton.llm import audit, decontaminate, licences, resampling

    return {"op4_benchmark_decontamination": decontaminate.SQL, "op5_licence_scan": licences.sql(), "op10_exact_top_k": OP10_SQL, "op12_filter_audit": audit.SQL, "op13_importance_resampling": resampling.SQL}
