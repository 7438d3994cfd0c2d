"""Candidates for a product: filters over records and items, text and vector hits joined to them, and the way from a name to item ids."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.views import PURCHASES, approved
from .answers import candidates, prefix_terms
from .retrieval import cosine, hybrid


def category_of() -> Column:
    """The first of key, group and category that isn't null, even if it is empty."""
    return F.coalesce("category_key", "category_group", "category")


def structured(items: DataFrame, receipts: DataFrame, merchant: str = "", category: str = "", item_ids: list[int] | None = None, approved_only: bool = True, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Items that may be found, with their record's merchant and date. A merchant fits by its normalised or its raw name; blank conditions don't count.

    Conditions on one table stand below the join, so they reach its scan.
    """
    i = items.where(F.lower(F.coalesce("item_type", F.lit("item"))).isin(PURCHASES) & ~F.lower(F.coalesce("item_status", F.lit(""))).isin("rejected", "needs_review"))
    r = receipts.where(approved(F.col("review_status"))) if approved_only else receipts
    merchant, category = " ".join(merchant.split()), " ".join(category.split())
    if merchant:
        r = r.where((F.lower(F.coalesce("merchant_normalized", F.lit(""))) == merchant.lower()) | (F.lower(F.coalesce("merchant_name", F.lit(""))) == merchant.lower()))
    if category:
        i = i.where(F.lower(F.coalesce(category_of(), F.lit(""))) == category.lower())
    if item_ids:
        i = i.where(F.col("item_id").isin([int(x) for x in item_ids]))
    if date_from:
        r = r.where(F.col("receipt_date") >= date_from)
    if date_to:
        r = r.where(F.col("receipt_date") <= date_to)
    return i.join(r.select("receipt_id", "merchant_normalized", "merchant_name", "receipt_date"), "receipt_id")


def text_hits(postings: DataFrame, found: DataFrame, query: str, weights: dict[str, float], limit: int | None = 50) -> DataFrame:
    """postings: term, item_id, field, tf. Items of `found` with a word that a word of the query begins; score: weighted counts by field, rank from 1."""
    terms = prefix_terms(query)
    hit = postings.where(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.col("term").startswith(t)) if terms else F.lit(False))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field"))
    score = hit.groupBy("item_id").agg(F.sum((weight * F.col("tf")).cast("decimal(28,6)")).cast("double").alias("score"))
    out = found.join(score, "item_id").orderBy(F.desc("score"), "item_id")
    return out.limit(limit) if limit else out


def vector_hits(embeddings: DataFrame, found: DataFrame, vector: list[float], limit: int = 12, least: float | None = None) -> DataFrame:
    """Items of `found` by the cosine of their embedding (item_id, embedding) with one vector."""
    sim = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
    out = found.join(embeddings.select("item_id", sim.alias("similarity")), "item_id").where("similarity is not null")
    if least is not None:
        out = out.where(F.col("similarity") >= least)
    return out.orderBy(F.desc("similarity"), "item_id").limit(limit)


def resolve_products(name: str, items: DataFrame, vector: list[float], decide: Callable[[str, list[dict]], dict[str, str]], limit: int = 12) -> dict:
    """From a product's name to item ids: the hybrid search's first groups become candidates c001 and on, `decide` (the caller's model) says selected, uncertain or rejected for each,
    and every candidate has to be decided once. status: resolved, needs_clarification, not_found. Only `limit` candidates come to the driver."""
    ranked = hybrid(items, name, vector, limit=limit)
    shown = candidates(ranked.select("description", "item_ids", F.struct((-F.col("fusion")).alias("f"), F.element_at("item_ids", 1).alias("i")).alias("rank")), limit)
    rows = [r.asDict() for r in shown.collect()]
    if not rows:
        return {"status": "not_found", "item_ids": [], "uncertain": [], "rejected": []}
    said = decide(name, rows)
    if set(said) != {r["candidate_id"] for r in rows} or not set(said.values()) <= {"selected", "uncertain", "rejected"}:
        raise ValueError("every candidate has to be decided once, as selected, uncertain or rejected")
    by = {kind: [r["candidate_id"] for r in rows if said[r["candidate_id"]] == kind] for kind in ("selected", "uncertain", "rejected")}
    ids = sorted({i for r in rows if said[r["candidate_id"]] == "selected" for i in r["item_ids"]})
    return {"status": "resolved" if ids else "needs_clarification" if by["uncertain"] else "not_found", "item_ids": ids, "uncertain": by["uncertain"], "rejected": by["rejected"]}
