"""Sources and sinks of records: nested JSON, job states, call logs, vectors."""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import first_present

RECEIPT = """
job_id string, merchant struct<name: string>, date string, currency string, totals struct<grand_total: double, paid_total: double>, human_review struct<status: string>,
items array<struct<description: string, normalized_name: string, name: string, category: string, category_key: string, category_group: string, parser_item_type: string, review_status: string, line_total: double, quantity: double>>
"""
JOB = "job_id string, status string, stage string, updated_at string, decision string, difference double, issues array<string>"
CALL = "call_id string, recorded_at string, provider string, model string, operation string, status string, duration_ms double, input_tokens long, output_tokens long, generation_duration_ms double, attributes_json string"


def read_json_documents(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """One document a file, with its path and time; files that aren't JSON are left out."""
    df = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path)
    # a query of the corrupt-record column alone isn't allowed, so it is looked at together with a field
    first = F.col(df.columns[0])
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified")).where(F.col("_bad").isNull() & (first.isNull() | first.isNotNull())).drop("_bad")


def newest_per_folder(docs: DataFrame, preferred: str) -> DataFrame:
    """The preferred file of each folder, or else the newest."""
    folder = F.regexp_replace("file_path", r"/[^/]*\z", "")
    rank = F.row_number().over(W.partitionBy(folder).orderBy(F.desc(F.col("file_path").endswith("/" + preferred)), F.desc("modified"), "file_path"))
    return docs.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def list_files(spark: SparkSession, path: str, extensions: list[str], limit: int | None = None) -> DataFrame:
    """path, length, modificationTime and sha256 of files with these endings (any case), ordered by path in lower case."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.where(F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    out = df.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256")).orderBy(F.lower("path"))
    return out.limit(limit) if limit else out


def flatten(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested receipts as a table of receipts and one of items. Items without a description are left out but keep their place's number."""
    head = receipts.select("job_id", F.xxhash64("job_id").alias("receipt_id"), F.col("merchant.name").alias("merchant_name"), F.col("date").alias("receipt_date"), "currency", F.col("totals.grand_total").alias("grand_total"), F.col("human_review.status").alias("review_status"))
    i = receipts.select(F.xxhash64("job_id").alias("receipt_id"), F.posexplode("items").alias("item_index", "i"))
    name = first_present(F.col("i.normalized_name"), F.col("i.description"), F.col("i.name"))
    rows = i.select("receipt_id", "item_index", F.xxhash64("receipt_id", "item_index").alias("item_id"), F.trim(name).alias("raw_name"), F.col("i.category_key").alias("category_key"), F.col("i.category_group").alias("category_group"), F.col("i.category").alias("category"), F.col("i.parser_item_type").alias("item_type"), F.col("i.review_status").alias("item_status"), F.col("i.line_total").alias("line_total"), F.col("i.quantity").alias("quantity"))
    return head, rows.where(F.coalesce("raw_name", F.lit("")) != "")


def import_receipts(receipts: DataFrame, items: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts of the same job are replaced with all their items; ids depend on the job, so they stay."""
    r, i = flatten(new)
    return receipts.join(r.select("job_id"), "job_id", "left_anti").unionByName(r), items.join(r.select("receipt_id"), "receipt_id", "left_anti").unionByName(i)


def delete_receipts(receipts: DataFrame, items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return receipts.join(ids, "receipt_id", "left_anti"), items.join(ids, "receipt_id", "left_anti")


def delete_counts(receipts: DataFrame, items: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: receipts and items that a deletion of these ids takes away."""
    r = receipts.join(ids, "receipt_id", "left_semi").agg(F.count("*").alias("receipts"))
    return r.crossJoin(items.join(ids, "receipt_id", "left_semi").agg(F.count("*").alias("items")))  # one row each


def reopen(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Queue rows whose receipt was deleted wait for review again, without a receipt."""
    gone = queue.join(ids.withColumn("_gone", F.lit(True)), "receipt_id", "left")
    new = {"receipt_id": F.when(F.col("_gone").isNull(), F.col("receipt_id")), "queue_status": F.when(F.col("_gone"), "needs_review").otherwise(F.col("queue_status"))}
    return gone.select(*[new.get(c, F.col(c)).alias(c) for c in queue.columns])


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for reports, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_once(log: DataFrame, new: DataFrame, key: str = "call_id", order: str | None = None) -> DataFrame:
    """New calls whose key isn't in the log yet, one row a key: the last by `order`, else the greatest row, so that reruns agree. Only completed model calls belong here; a null key doesn't."""
    rows = new.where(F.col(key).isNotNull())
    best = rows.groupBy(key).agg(F.max(F.struct(*([order] if order else []), *[c for c in new.columns if c not in (key, order)])).alias("_row"))
    return best.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in new.columns]).join(log.select(key), key, "left_anti")


def decode_vector(c: Column) -> Column:
    """Little-endian 32-bit floats; null for no bytes, a broken length or a value that isn't finite."""

    def one(b):
        if not b or len(b) % 4:
            return None
        v = np.frombuffer(b, "<f4")
        return v if np.isfinite(v).all() else None

    @F.pandas_udf("array<float>")
    def run(blob: pd.Series) -> pd.Series:
        return blob.map(one)

    return run(c)


def encode_vector(c: Column) -> Column:
    def one(x):
        a = np.asarray(x if x is not None else [], "<f4")
        return a.tobytes() if len(a) and np.isfinite(a).all() else None

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(one)

    return run(c)


def job_report(jobs: DataFrame) -> DataFrame:
    """Jobs by state and decision."""
    return jobs.groupBy("status", "decision").agg(F.count("*").alias("n"), F.avg(F.abs("difference")).alias("mean_difference"), F.max(F.abs("difference")).alias("max_difference"), F.count_if(F.size("issues") > 0).alias("with_issues"))


def json_number(c: Column, path: str) -> Column:
    """A number of a JSON text; null for invalid JSON or another type."""
    return F.get_json_object(c, path).try_cast("double")
