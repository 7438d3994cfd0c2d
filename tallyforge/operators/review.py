"""Review queue: decisions, effective status, upserts, revisions."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def queue_status(duplicate: Column, decision: Column, clean: Column) -> Column:
    return F.when(duplicate, "possible_duplicate").when(decision == "reject", "rejected").when(clean & (decision == "import"), "auto_validated").otherwise("needs_review")


def effective_status(queue: DataFrame, receipts: DataFrame) -> DataFrame:
    """The status of the receipt by id, else by job, else the queue's own."""
    by_id = receipts.select(F.col("receipt_id").alias("r_id"), F.col("review_status").alias("s_id"))
    by_job = receipts.select(F.col("job_id").alias("r_job"), F.col("review_status").alias("s_job"))
    j = queue.join(by_id, queue["receipt_id"] == by_id["r_id"], "left").join(by_job, queue["job_id"] == by_job["r_job"], "left")
    return j.select(*[queue[c] for c in queue.columns], F.coalesce("s_id", "s_job", "queue_status").alias("status"))


def summary(queue: DataFrame, status: str = "status") -> DataFrame:
    return queue.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def queue_order(queue: DataFrame, limit: int = 100) -> DataFrame:
    rank = F.when(F.col("status") == "possible_duplicate", 0).when(F.col("status") == "needs_review", 1).otherwise(2)
    return queue.orderBy(rank, F.asc_nulls_first("updated_at"), "job_id").limit(max(1, min(500, limit)))


def latest(events: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The last value of each key: one aggregation, no sort."""
    return events.groupBy(key).agg(F.max_by(value, seq).alias(value), F.count("*").alias("n_events"))


def reason_codes(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """New values replace old ones where they aren't null; columns in keep_first are written once."""
    cols = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    return j.select(key, *[(F.coalesce(f"o.{c}", f"n.{c}") if c in keep_first else F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in cols])


def add_revisions(history: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits: job_id, base_revision, draft. Those based on the last revision (0: none yet) become the next one, at most one a job; the rest are returned as stale."""
    last = history.groupBy("job_id").agg(F.max("revision").alias("last"))
    j = edits.join(last, "job_id", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    fit = j.where(F.col("base_revision") == F.col("last")).groupBy("job_id").agg(F.min("draft").alias("draft"), F.max("last").alias("last"))
    taken = fit.select("job_id", (F.col("last") + 1).alias("revision"), "draft")
    stale = edits.join(taken.select("job_id", "draft", (F.col("revision") - 1).alias("base_revision")), ["job_id", "draft", "base_revision"], "left_anti")
    return history.unionByName(taken), stale


def changed_fields(before: Column, after: Column, names: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(~before[n].eqNullSafe(after[n]), n) for n in names]))
