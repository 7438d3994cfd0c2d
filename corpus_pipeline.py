"""The corpus pipeline: quality, language, near-duplicates, mixing, tokens. Each stage works on all that the one before it kept."""
import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, langid, mixing, similar, zstdclass
from tallyforge.llm.common import Scratch, table

#: SQL can't express the stages; tests/llm holds each against brute force or held-out labels.
ORACLE_SQL = None


def _boxed(docs: DataFrame) -> DataFrame:
    """All columns in one struct, so that none clashes with a stage's own."""
    return docs.select(F.struct("*").alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the compression classifier, fitted on this stage's documents with labels, predicts as good (score >= 0.7).

    Null and empty texts have the score of no difference; repeated rows and rows with a null doc_id are judged by their text like any other. Without labelled texts of both
    qualities in both of its parts nothing can be told apart: a warning is given and all documents stay. An empty table stays empty.
    """
    model = zstdclass.fit(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        warnings.warn("quality: no labelled documents of both qualities to learn from; all documents stay", stacklevel=2)
        return docs
    return zstdclass.with_score(_boxed(docs), model, "row.text").where("score >= 0.7").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those too far from every language's centroids.

    Rows with a null doc_id or lang and repeated rows are judged by their text. If no document has a language to learn from, a warning is given and all documents stay.
    """
    model = langid.fit(docs)
    if not model.langs:
        warnings.warn("language: no document with a language to learn from; all documents stay", stacklevel=2)
        return docs
    return langid.with_language(_boxed(docs), model, "row.text").where("not lang_far").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash candidates linked by Jaccard similarities of 0.8 or more over shingles of five words.

    The least doc_id stays, null ids last; of repeated rows one. All texts without words are one group.
    """
    return similar.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the entropy-balanced mix says, up to three times. Texts without words are taken once, a null source is one of its own."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, source, lang, n_tokens, digests of the ids and of the decoded bytes, ids. A null text has no ids; repeated rows give a row each."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids_column=True, keep=("source", "lang"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
