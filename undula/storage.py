"""Tables that several passes read: written once to the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table that may be broadcast.
SMALL = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session on this machine alone may do without: it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="undula-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(remove, spark, path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the session may have ended; what is left lies in the shared scratch folder
        if not isinstance(e, (AttributeError, ConnectionError, OSError)) and "py4j" not in type(e).__module__:
            raise


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/undula-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialize(df: DataFrame, most: int = 0) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors. most: rows of a file, for tables of very large rows (0: any number)."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

def few(small: DataFrame) -> DataFrame:
    """small (a written table, so that counting is cheap), marked for a broadcast if it has at most SMALL rows; else both sides are shuffled."""
    return F.broadcast(small) if small.count() <= SMALL else small
