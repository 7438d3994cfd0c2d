"""What the operators share: written intermediate tables, connected components, running totals, row hashes."""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch

#: Words are runs of anything but these characters (space, tab, line feed, vertical tab, form feed, return).
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(batch: pa.RecordBatch, path: str) -> pa.Array:
    """The column at a path like text or row.text."""
    first, *rest = path.split(".")
    col = batch.column(batch.schema.get_field_index(first))
    for name in rest:
        col = col.field(name)
    return col


#: A table of one row a key (some hundred bytes) is broadcast up to so many keys. Beyond, rows are dealt by key and salt, so that no hot key meets in one task.
BROADCAST_KEYS, SALTS = 100_000, 64


def by_key(rows: DataFrame, small: DataFrame, keys: int, key: str = "key", how: str = "inner", salt: list[str] | None = None) -> DataFrame:
    """rows joined with a table of one row a key: broadcast if `keys`, the counted number of keys, allows it, else dealt by key and a salt, the hash of all columns or of those named."""
    if keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(small), key, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*(salt or rows.columns)), F.lit(SALTS)).cast("int"))
    return salted.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), [key, "salt"], how).drop("salt")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """Connected components of edges (a, b) of one orderable type: a row (node, root) for every node of an edge, root the smallest of its component.

    Alternating large-star and small-star steps. Each round writes its edges, so that lineage stays short; the number of rounds grows
    with the logarithm of a component's size. Minima are pre-aggregated before the shuffle, and only joins see a hub's edges, which
    adaptive execution splits. Null ends and self-loops are left out. Raises if it hasn't converged after max_rounds.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    figures = {"rows": F.count(F.lit(1)), "mixed": F.bit_xor(F.xxhash64("u", "v")), "sum": F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))}
    cur, sign = scratch.cut_and_see(e, **figures)
    last = None
    for _ in range(max_rounds):
        if sign == last:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select("v", "v")).distinct()
        last = sign
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new, sign = scratch.cut_and_see(small.distinct(), **figures)
        scratch.release(cur)
        cur = new
    raise RuntimeError(f"components: not converged after {max_rounds} rounds")


def unit_hash(*cols: Column | str) -> Column:
    """A number above 0 and below 1 that depends on the columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def n_words(text: str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[str], value: str, scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """Adds `before`: the sum of the long column `value` over all rows that come earlier in the order.

    Rows are dealt by ranges of the order, each task sums its own range, and one number for each task is added up on the driver, so
    no task sees more than its range. The order should tell all rows apart for reruns to agree.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("before", T.LongType())])
    names = df.columns

    def sums(batches):
        from pyspark import TaskContext

        pid, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(names.index(value)).to_numpy(zero_copy_only=False).astype("i8")
            ends = np.cumsum(v) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), pid, "i4")), pa.array(ends - v)], [*names, "pid", "before"])
            total = int(ends[-1]) if len(ends) else total

    local = scratch.cut(ranged.mapInArrow(sums, out))
    sizes = sorted((r[0], r[1]) for r in local.groupBy("pid").agg(F.sum(value)).collect())
    offsets, total = [], 0
    for pid, s in sizes:
        offsets.append((pid, total))
        total += s or 0
    offset = spark.createDataFrame(offsets, "pid int, offset long")  # one row a task
    return local.join(F.broadcast(offset), "pid").select(*names, (F.col("before") + F.col("offset")).alias("before"))
