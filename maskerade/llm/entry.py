"""The registered queries of the training-data operators, and SQL where it can express one."""

from __future__ import annotations

from ..session import ship
from . import chroma, jaccard_forest, langid, lm_bloom, mixing, packing, quality_crf, sharding, suffix_dedup, template_html


def _table(spark, sf_dir, name):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lsh_forest_join(spark, sf_dir):
    return jaccard_forest.join(_table(spark, sf_dir, "documents"))


def op2_line_crf(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.train(docs, _table(spark, sf_dir, "labels")))


def op8_bitmask_filters(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_log_frequency_filter(spark, sf_dir):
    return lm_bloom.score_documents(_table(spark, sf_dir, "documents"))


def op3_chroma_search(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as samples")
    return chroma.search_digest(vectors).withColumnRenamed("id", "vec_id")


def op5_template_classes(spark, sf_dir):
    return template_html.extract(_table(spark, sf_dir, "pages"))


def op4_suffix_array(spark, sf_dir):
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op6_pivotal_mixing(spark, sf_dir):
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


def op7_stratified_interleaving(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_vector_best_fit(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lsh_forest_join,
        op2_line_crf,
        op3_chroma_search,
        op4_suffix_array,
        op5_template_classes,
        op6_pivotal_mixing,
        op7_stratified_interleaving,
        op8_bitmask_filters,
        op9_log_frequency_filter,
        op10_vector_best_fit,
    )
}
ORACLE_SQL: dict[str, str] = {}
