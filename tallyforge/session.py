"""The Spark session that tests and bench.py use. On a cluster the session comes from the caller."""
import os
import sys

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", name: str = "tallyforge", shuffle_partitions: int = 8, checkpoint_dir: str | None = None, memory: str = "8g") -> SparkSession:
    """ANSI mode, UTC and adaptive execution; nothing here is needed for right results but UTC."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x)
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    b = (
        SparkSession.builder.master(master).appName(name)
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.host", "127.0.0.1")
    )
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", f"file://{checkpoint_dir}")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
