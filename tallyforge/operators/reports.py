"""Reports and sums: model calls of a query, what the review pages show, job reports and how they are written."""
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Durations that are added up, and the fields that a queue search looks at.
DURATIONS = {"total_request_duration_ms": "request_duration_ms", "total_provider_duration_ms": "total_duration_ms", "total_load_duration_ms": "load_duration_ms", "total_prompt_eval_duration_ms": "prompt_eval_duration_ms", "total_generation_duration_ms": "eval_duration_ms"}
QUEUE_FIELDS = ["job_id", "merchant_name", "merchant_normalized", "receipt_date", "queue_status", "decision"]


def call_totals(calls: DataFrame) -> DataFrame:
    """calls: query_id, stage, provider and durations. One row a query: calls, calls by provider (`unknown` for none), and the sums of the durations, to three places."""
    per = calls.groupBy("query_id", F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(28,6)")).alias(k) for k, c in DURATIONS.items() if c in calls.columns])
    sums = [F.round(F.sum(k), 3).cast("double").alias(k) for k, c in DURATIONS.items() if c in calls.columns]
    return per.groupBy("query_id").agg(F.sum("n").alias("call_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "n")))).alias("providers"), *sums)


def exact_total(c: Column) -> Column:
    """A sum in which null counts as 0."""
    return F.sum(F.coalesce(c, F.lit(0)).cast("decimal(18,2)")).cast("double")


def queue_text(reasons: Column) -> Column:
    """What a queue row is searched by: its fields and reason codes, in lower case."""
    said = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in QUEUE_FIELDS]
    return F.lower(F.concat_ws(" ", *said, F.filter(reasons, lambda r: r != "")))


def queue_search(queue: DataFrame, text: str) -> DataFrame:
    text = text.strip().lower()
    return queue.where(queue_text(F.col("reason_codes")).contains(text)) if text else queue


def job_states(jobs: DataFrame) -> DataFrame:
    """jobs: file_path, type, job_id, filename, .. Job documents that count in a report: those nearest to the root if there are any two folders deep, else all; no batches; of a job the first by path.

    A job without an id takes its folder's name.
    """
    folder = F.regexp_extract("file_path", r"([^/]+)/[^/]*\z", 1)
    depth = F.size(F.split("file_path", "/"))
    found = jobs.withColumn("job_id", F.coalesce(F.nullif(F.col("job_id"), F.lit("")), folder)).withColumn("_depth", depth)
    least = found.agg(F.min("_depth").alias("_least"))  # one row
    found = found.crossJoin(F.broadcast(least)).where("_depth = _least").drop("_depth", "_least")
    found = found.where(F.coalesce(F.col("type") != "batch", F.lit(True)) & ((F.col("type") == "single_in_batch") | (F.coalesce("filename", F.lit("")) != "")))
    first = F.row_number().over(W.partitionBy("job_id").orderBy("file_path"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def job_summary(jobs: DataFrame) -> DataFrame:
    """jobs: job_id, decision, difference, issue_count, review_status. One row: counts, share of reviewed jobs, mean and greatest absolute difference (two places), and decisions."""
    size = F.abs("difference").cast("decimal(18,2)")
    per = jobs.groupBy(F.coalesce("decision", F.lit("unknown")).alias("decision")).agg(F.count("*").alias("n"), F.count("review_status").alias("reviewed"), F.count_if(F.col("issue_count") > 0).alias("issues"), F.sum(size).alias("sum"), F.count(size).alias("known"), F.max(size).alias("most"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_jobs"), F.coalesce(F.sum("reviewed"), F.lit(0)).alias("human_reviewed"), F.try_divide(F.sum("reviewed"), F.sum("n")).alias("review_rate"), F.coalesce(F.sum("issues"), F.lit(0)).alias("jobs_with_issues"),
        F.round(F.try_divide(F.sum("sum"), F.sum("known")), 2).cast("double").alias("avg_abs_difference"), F.max("most").cast("double").alias("max_abs_difference"), F.array_sort(F.collect_list(F.struct("decision", "n"))).alias("decisions"),
    )


def markdown(title: str, facts: list[tuple[str, object]], columns: list[str], rows: list[tuple], empty: str = "none") -> str:
    """A report of facts and one table; bars in cells are escaped. rows: a bounded result."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", *[f"- {k}: **{v}**" for k, v in facts], ""]
    if not rows:
        return "\n".join([*lines, f"_{empty}_", ""])
    return "\n".join([*lines, "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""])


def write_whole(path: str, content: object) -> None:
    """Writes a JSON document or text to a local path so that readers see the old file or the whole new one. For small reports; tables are written by Spark, whose committer does the same."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder, prefix=f".{os.path.basename(path)}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2, sort_keys=True))
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def log_queries(queries: DataFrame, path: str) -> None:
    """Opt-in log: one JSON document a query, in a folder for each day. queries: query_id, asked_at (text, ISO) and anything else."""
    queries.withColumn("day", F.substr("asked_at", F.lit(1), F.lit(10))).write.mode("append").partitionBy("day").json(path)


#: Artifacts of a finished record and the columns that they hold.
ARTIFACTS = {"validation": ["checks"], "reconciled": ["record"], "categorized": ["categories"], "metadata": ["metadata"], "trace": ["trace"]}


def write_artifacts(finished: DataFrame, path: str) -> None:
    """One table of JSON documents for each kind of artifact, from one pass over the finished records (job_id and a column for each kind)."""
    kept = finished.persist()
    try:
        for kind, columns in ARTIFACTS.items():
            kept.select("job_id", *columns).write.mode("overwrite").json(f"{path}/{kind}")
    finally:
        kept.unpersist()
