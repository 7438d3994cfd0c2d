"""One object for the whole engine: tables in, DataFrames out. Every method is a thin call of an operator, so plans stay lazy and open to Catalyst."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import analytics, duplicates, enrichment, guard, index, lookup, reports, retrieval, review, telemetry, validation, workflow
from .plans.views import items_view, receipts_view
from .sources import records


class Engine:
    """receipts and items in the form that sources.records.flatten gives; queue, calls, prices and embeddings only for the methods that use them."""

    def __init__(self, spark: SparkSession, receipts: DataFrame, items: DataFrame, queue: DataFrame | None = None, calls: DataFrame | None = None, prices: DataFrame | None = None, embeddings: DataFrame | None = None):
        self.spark, self.receipts, self.items = spark, receipts, items
        self.queue, self.calls, self.prices, self.embeddings = queue, calls, prices, embeddings

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, preferred: str = "approved.json") -> "Engine":
        """The preferred or newest document of each folder below path."""
        docs = records.newest_per_folder(records.read_json_documents(spark, path, records.RECEIPT), preferred)
        return cls(spark, *records.flatten(docs))

    # records

    def import_receipts(self, new: DataFrame) -> "Engine":
        """The engine with new documents in place of those of the same jobs."""
        return Engine(self.spark, *records.import_receipts(self.receipts, self.items, new), self.queue, self.calls, self.prices, self.embeddings)

    def delete(self, ids: DataFrame) -> "Engine":
        queue = records.reopen(self.queue, ids) if self.queue is not None else None
        return Engine(self.spark, *records.delete_receipts(self.receipts, self.items, ids), queue, self.calls, self.prices, self.embeddings)

    def views(self) -> dict[str, DataFrame]:
        return {"analytics_receipts": receipts_view(self.receipts, self.items), "analytics_purchase_items": items_view(self.receipts, self.items)}

    # analytics

    def row_counts(self) -> DataFrame:
        return analytics.row_counts(self.receipts, self.items)

    def list_receipts(self, order: str = "date_desc", limit: int = 100, **filters) -> DataFrame:
        return analytics.list_receipts(self.receipts, self.items, order, limit, **filters)

    def aggregate(self, operation: str, **filters) -> DataFrame:
        return analytics.aggregate_receipts(self.receipts, operation, **filters)

    def group(self, by: str, operation: str, limit: int = 100) -> DataFrame:
        return analytics.group_receipts(self.receipts, by, operation, limit)

    def ask(self, sql: str, parameters: dict[str, object] | None = None, shape: str = "rows", **rules) -> guard.Result:
        """A planner's query over the two views, guarded."""
        return guard.run(self.spark, guard.Plan(sql, parameters or {}, shape), self.views(), **rules)

    # search

    def search(self, query: str, aliases: dict[str, list[str]] | None = None, limit: int = 25) -> DataFrame:
        return enrichment.search(self.items, "item_id", "raw_name", query, aliases, limit)

    def find_items(self, merchant: str = "", category: str = "", **filters) -> DataFrame:
        return lookup.structured(self.items, self.receipts, merchant, category, **filters)

    def similar(self, vector: list[float], limit: int = 12, **filters) -> DataFrame:
        return lookup.vector_hits(self.embeddings, self.find_items(**filters), vector, limit)

    def pending_embeddings(self, documents: DataFrame) -> DataFrame:
        return index.pending(documents, self.embeddings)

    def evaluate(self, results: DataFrame, cases: DataFrame) -> DataFrame:
        return retrieval.evaluate(results, cases)

    # model calls

    def call_summary(self, **conditions) -> DataFrame:
        return telemetry.summary(telemetry.with_cost(telemetry.select_calls(self.calls, **conditions), self.prices))

    def calls_by(self, key: str) -> DataFrame:
        return telemetry.by_group(telemetry.with_cost(self.calls, self.prices), key)

    # review

    def review_queue(self, text: str = "", limit: int = 100) -> DataFrame:
        queue = review.effective_status(self.queue, self.receipts)
        return review.queue_order(reports.queue_search(queue, text) if text else queue, limit)

    def queue_buckets(self) -> DataFrame:
        return workflow.buckets(review.effective_status(self.queue, self.receipts))

    def finalize(self, reviews: DataFrame) -> DataFrame:
        return workflow.finalize(reviews)

    def duplicate_candidates(self, records_: DataFrame, limit: int = 10) -> DataFrame:
        return workflow.top_duplicates(duplicates.candidate_pairs(records_), limit)

    def validate(self, records_: DataFrame, items: DataFrame, codes: list[str] | None = None) -> DataFrame:
        return validation.check_records(records_, validation.item_facts(items), codes=codes)


#: The stages of an extraction, in order. Each is a function from a DataFrame of records to one; models behind them are the caller's.
STAGES = ["transcription", "header", "items", "reconciliation", "categorization", "validation", "finalization"]


def extract(records_: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs the stages in their order, each over all records that the one before gave, written between them. A missing or an unknown stage is an error before anything runs."""
    if set(stages) != set(STAGES):
        raise ValueError(f"the stages are {', '.join(STAGES)}; missing or unknown: {sorted(set(stages) ^ set(STAGES))}")
    for name in STAGES:
        records_ = cut(stages[name](records_))
    return records_
