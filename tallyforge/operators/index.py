"""The incremental embedding index: what to embed, what to drop, how far it got."""
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_indexable
from ..plans.views import approved, is_purchase


def indexable(items: DataFrame) -> DataFrame:
    """Items that may be indexed: named, purchases, neither rejected nor to be reviewed (the views only leave out rejected ones)."""
    return items.where(is_indexable(F.col("raw_name")) & is_purchase(F.col("item_type")) & ~F.lower(F.coalesce("item_status", F.lit(""))).isin("rejected", "needs_review"))


def semantic_document(name: Column, category: Column, brand: Column, merchant: Column) -> Column:
    """Two to five labelled lines; parts that are null or blank are left out."""
    part = lambda label, c, n: F.when(F.trim(c) != "", F.concat(F.lit(label + ": "), F.substr(F.trim(c), F.lit(1), F.lit(n))))
    return F.concat_ws("\n", part("Product", name, 500), part("Category", category, 500), part("Brand", brand, 500), part("Merchant", merchant, 500))


def content_hash(document: Column, policy: str = "v1") -> Column:
    return F.sha2(F.concat(F.lit(policy + "\n"), document), 256)


def pending(documents: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """documents: item_id, document, content_hash. Those whose hash is new or differs."""
    if force:
        return documents
    old = index.select("item_id", F.col("content_hash").alias("old_hash"))
    return documents.join(old, "item_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("old_hash"))).drop("old_hash")


def stale(index: DataFrame, documents: DataFrame) -> DataFrame:
    return index.join(documents.select("item_id"), "item_id", "left_anti")


def embed(documents: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """item_id, content_hash, embedding, error: a failed batch has errors and no vectors, later batches go on."""

    def run(frames):
        for t in frames:
            for i in range(0, len(t), batch):
                part = t.iloc[i : i + batch]
                try:
                    vectors, error = provider(part["document"].tolist()), None
                    if len(vectors) != len(part) or len({len(v) for v in vectors}) > 1:
                        raise ValueError("the provider gave another number or size of vectors")
                except Exception as e:  # noqa: BLE001  any provider error is the batch's own
                    vectors, error = [None] * len(part), str(e)[:500]
                yield pd.DataFrame({"item_id": part["item_id"].values, "content_hash": part["content_hash"].values, "embedding": vectors, "error": error})

    return documents.select("item_id", "content_hash", "document").mapInPandas(run, "item_id long, content_hash string, embedding array<float>, error string")


def refresh(index: DataFrame, documents: DataFrame, embedded: DataFrame) -> DataFrame:
    """The index without what is gone, with new vectors in place of old ones."""
    good = embedded.where("error is null").select("item_id", "content_hash", "embedding")
    kept = index.join(documents.select("item_id"), "item_id", "left_semi").join(good.select("item_id"), "item_id", "left_anti")
    return kept.select("item_id", "content_hash", "embedding").unionByName(good)


__all__ = ["approved", "content_hash", "embed", "indexable", "pending", "refresh", "semantic_document", "stale"]
