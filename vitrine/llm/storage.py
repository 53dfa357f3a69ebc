"""Tables and files in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a folder of this machine on a local master only; on a
    cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="vitrine-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Setting by which Spark deletes the shuffle files of a query as soon as it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write are deleted at its end; else they stay until the driver's memory is collected, beside
    those of the next steps.
    """
    spark = df.sparkSession
    path = new_dir(spark, what)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `stored` gave and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, upper and lower case alike."""
    used = {c.lower() for c in taken}
    name = f"_{name}"
    while name.lower() in used:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
