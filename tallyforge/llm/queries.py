"""The registered queries: each operator over its whole table with production parameters."""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, mixing, neardup, ordering, outliers, sharding, simhash, urlfilter, zstdclass
from .common import table

#: The rules of op3: fixed values.
RULES = [
    urlfilter.Rule("org", "/", "allow"), urlfilter.Rule("example.org", "/es/", "block"), urlfilter.Rule("example.org", "/en/1", "block"),
    urlfilter.Rule("com", "/fr/", "allow"), urlfilter.Rule("com", "/de/", "block"),
]


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def op6_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstdclass.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_training_order, op2_embedding_neardup, op3_url_filter, op4_entropy_mix, op5_label_propagation_shards, op6_mcd_outliers, op7_compression_quality, op8_simhash_neardup, op9_bpe, op10_language)
}

#: Only links and components of vectors have a plain SQL form; the others are tested against brute force in tests/llm.
ORACLES = {
    "op2_embedding_neardup": """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e,
        coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
    FROM embeddings
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), reach AS (
    SELECT vec_id, vec_id AS root FROM v
    UNION
    SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.vec_id
), least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least USING (vec_id)
""",
}
