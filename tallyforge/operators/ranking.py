"""Ranks over a whole table without a single task: ranges, counts of the ranges, places within them."""
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the long column `name`: 1 for the first row in the order, and so on. The order should tell all rows apart.

    Rows are dealt by ranges of the order and kept, as the ranges' counts (one row a range) and the places have to come from the same dealing; what an executor
    loses is made again from the input.
    """
    at = "_at"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright(F.col(at), 33)
    counts = ranged.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))  # one row a range
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_range", part).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + place + 1).select(*df.columns, name)


#: Bins of a group's range in the first step of a percentile.
BINS = 4096


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place ceil(n * share) of each group's values in order (nulls don't count): the columns of `by` and `name`. Exact, without a group's values meeting in one task:
    counts by bin say which bin holds the place, and only that bin's values are counted one by one. Groups without a value have no row; without columns to group by there is one row."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    every = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    join = (lambda a, b: a.join(b, by)) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))  # without groups there is one row
    span = F.col("_high") - F.col("_low")
    bin_ = F.when(span > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / span * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
    counts = join(rows, every).groupBy(*by, "_n", "_low", "_high", bin_.alias("_bin")).agg(F.count("*").alias("_c"))
    place = F.ceil(F.col("_n") * F.lit(share))
    upto = F.sum("_c").over(W.partitionBy(*by).orderBy("_bin"))  # BINS rows a group at most
    found = counts.withColumn("_upto", upto).where((F.col("_upto") >= place) & (F.col("_upto") - F.col("_c") < place))
    found = found.select(*by, "_low", "_high", F.col("_bin").alias("_at"), (place - F.col("_upto") + F.col("_c")).alias("_rest"))
    inside = join(rows, found).where(bin_ == F.col("_at")).groupBy(*by, "_rest", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by).orderBy("_v"))  # values of one bin
    return inside.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_rest")).groupBy(*by).agg(F.min("_v").alias(name))
