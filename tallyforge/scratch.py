"""Intermediate tables in the folder that the session names in spark.checkpoint.dir."""
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a local master gets a folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    root = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive executors. release() deletes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def cut(self, df: DataFrame, partition_by: str | None = None, few: str | None = None) -> DataFrame:
        """The table, written and read again. few: a column by which rows of few bytes are dealt anew, so that there are only as many files as their size takes.

        Each file costs: without native Hadoop a child process sets its permissions, and for some milliseconds that counts the memory of the whole JVM again. A marker of success has no reader.
        """
        path = self.path()
        w = (df.hint("rebalance", few) if few else df).write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def cut_and_see(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """The written table, and figures (aggregates) over its rows that are taken on the way, without another job. Each partition that is written counts once."""
        seen = Observation()
        out = self.cut(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
        return out, seen.get

    def release(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, *frames: DataFrame) -> None:
        """Deletes all tables but these. Nothing that is still lazy may read the others."""
        held = {id(f) for f in frames}
        self.release(*[df for df, _ in self.paths.values() if id(df) not in held])
