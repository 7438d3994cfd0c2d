"""The review workflow: final decisions, status changes, duplicates, leases of jobs."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a reviewer may ask for, codes and severities that block an approval, statuses of the queue, and its fixed buckets.
REQUESTS = ["approved", "needs_review", "rejected"]
BLOCKING_CODES, BLOCKING_SEVERITIES = ["LLM_PARSE_FAILED", "MISSING_MERCHANT", "MISSING_TOTAL", "NO_ITEMS"], ["critical", "high"]
STATUSES = ["needs_review", "approved", "auto_validated", "rejected", "duplicate_candidate", "duplicate_confirmed", "dismissed_duplicate", "imported"]
BUCKETS = ["needs_review", "duplicate_candidate", "rejected", "auto_validated", "approved", "imported"]


def finalize(reviews: DataFrame) -> DataFrame:
    """reviews: job_id, requested, decision (of the rules), issues (array of code and severity).

    Adds status, import_decision, blocked, override, import_allowed and blocking (codes, in the order of the issues). A reviewer may override warnings, not missing core data, a high or
    critical issue, or a decision to reject. No request counts as needs_review; an unknown one is an error.
    """
    asked = F.lower(F.trim(F.coalesce(F.nullif(F.col("requested"), F.lit("")), F.lit("needs_review"))))
    asked = F.when(asked.isin(REQUESTS), asked).otherwise(F.raise_error(F.concat(F.lit("unsupported review status: "), asked)))
    decision = F.coalesce("decision", F.lit("needs_review"))
    severe = lambda i: F.coalesce(F.lower(i["severity"]).isin(BLOCKING_SEVERITIES), F.lit(False)) | F.coalesce(i["code"].isin(BLOCKING_CODES), F.lit(False))
    out = reviews.withColumns({"_asked": asked, "_decision": decision, "blocking": F.transform(F.filter(F.coalesce("issues", F.array().cast(reviews.schema["issues"].dataType)), severe), lambda i: F.coalesce(i["code"], F.lit("")))})
    hard = F.col("_decision").isin("reject", "llm_failed")
    blocked = (F.col("_asked") == "approved") & ((F.size("blocking") > 0) | hard)
    status = F.when(blocked, "needs_review").otherwise(F.col("_asked"))
    final = F.when(blocked, F.when(hard, F.col("_decision")).otherwise("reject")).when(F.col("_asked") == "approved", "import").when(F.col("_asked") == "rejected", "reject").otherwise("needs_review")
    override = (F.col("_asked") == "approved") & ~blocked & (F.col("_decision") != "import")
    return out.select(*reviews.columns, status.alias("status"), final.alias("import_decision"), blocked.alias("blocked"), override.alias("override"), ((F.col("_asked") == "approved") & ~blocked).alias("import_allowed"), "blocking")


def item_status(own: Column, status: Column, blocked: Column) -> Column:
    """An item's status after its record was finalised."""
    low = F.lower(F.trim(F.coalesce(own, F.lit(""))))
    return F.when((status == "approved") & (low != "rejected"), F.when(low == "corrected", "corrected").otherwise("approved")).when(blocked & (low == "approved"), "needs_review").otherwise(own)


def change_status(queue: DataFrame, duplicates: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """changes: job_id, status, receipt_id (null keeps the old one), at; one a job. Queue (job_id, queue_status, receipt_id, updated_at, ..) and duplicates (job_id, status, resolved_at, ..) after them, and the
    changes of jobs that aren't in the queue. A confirmed or dismissed duplicate resolves the job's open candidates. An unknown status is an error."""
    known = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unsupported review status: "), F.col("status"))))
    c = changes.select("job_id", known.alias("_status"), F.col("receipt_id").alias("_receipt"), F.col("at").alias("_at"))
    new = {"queue_status": F.coalesce("_status", "queue_status"), "receipt_id": F.coalesce("_receipt", "receipt_id"), "updated_at": F.coalesce("_at", "updated_at")}
    after = queue.join(c, "job_id", "left").select(*[new.get(n, F.col(n)).alias(n) for n in queue.columns])
    lost = changes.join(queue.select("job_id"), "job_id", "left_anti")
    resolved = F.when(F.col("status") == "candidate", F.when(F.col("_status") == "duplicate_confirmed", "confirmed_duplicate").when(F.col("_status") == "dismissed_duplicate", "dismissed"))
    d = duplicates.join(c.join(queue.select("job_id"), "job_id", "left_semi"), "job_id", "left").withColumn("_to", resolved)
    fresh = {"status": F.coalesce("_to", "status"), "resolved_at": F.when(F.col("_to").isNotNull(), F.col("_at")).otherwise(F.col("resolved_at"))}
    return after, d.select(*[fresh.get(n, F.col(n)).alias(n) for n in duplicates.columns]), lost


def top_duplicates(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """pairs: id_a, id_b, score. For each record its best candidates with their place: record_id, candidate_id, score, place. Tasks keep `limit` rows a record before records meet."""
    both = pairs.select(F.col("id_a").alias("record_id"), F.col("id_b").alias("candidate_id"), "score").union(pairs.select("id_b", "id_a", "score"))
    place = F.row_number().over(W.partitionBy("record_id").orderBy(F.desc("score"), "candidate_id"))
    return both.withColumn("place", place).where(F.col("place") <= limit)


def buckets(queue: DataFrame, status: str = "status") -> DataFrame:
    """One row: total and a count for each fixed bucket."""
    return queue.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == b).alias(b) for b in BUCKETS])


def claim(leases: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """leases: job_id, owner_id, expires_at; requests: job_id, owner_id, asked_at, seconds. The leases after the requests: a job with no live lease goes to the one that asked first; leases last a second at least."""
    live = leases.where(F.col("expires_at") > now)
    first = requests.join(live.select("job_id"), "job_id", "left_anti").groupBy("job_id").agg(F.min_by(F.struct("owner_id", "seconds"), F.struct("asked_at", "owner_id")).alias("r"))
    return live.unionByName(first.select("job_id", F.col("r.owner_id").alias("owner_id"), (F.lit(float(now)) + F.greatest(F.col("r.seconds").cast("double"), F.lit(1.0))).alias("expires_at")))


def renew(leases: DataFrame, owner_id: str, now: float, seconds: float) -> DataFrame:
    """An owner's leases last from now on again; others stay as they are."""
    return leases.withColumn("expires_at", F.when(F.col("owner_id") == owner_id, F.lit(now + max(1.0, seconds))).otherwise(F.col("expires_at")))


def release(leases: DataFrame, job_id: str, owner_id: str) -> DataFrame:
    return leases.where(~((F.col("job_id") == job_id) & F.coalesce(F.col("owner_id") == owner_id, F.lit(True))))


def recoverable(jobs: DataFrame, leases: DataFrame, now: float, slots: int) -> DataFrame:
    """Queued or running jobs without a live lease, the oldest first, as many as there are slots."""
    live = leases.where(F.col("expires_at") > now).select("job_id")
    return jobs.where(F.col("status").isin("queued", "running")).join(live, "job_id", "left_anti").orderBy("created_at", "job_id").limit(slots)


def batch_failures(jobs: DataFrame) -> DataFrame:
    """Jobs and failed ones of each batch."""
    return jobs.groupBy("batch_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"))
