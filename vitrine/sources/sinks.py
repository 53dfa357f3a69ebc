"""Sinks: checked appends to the catalogue tables, vectors written back, blobs, and re-embedding."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import schema
from vitrine.functions.vector import nonzero
from vitrine.sources.providers import Provider, embedded


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the schema of a table: missing columns null, missing lists empty, choices and required values checked.

    A row that breaks a rule raises an error when it is computed."""
    fields = T.StructType.fromDDL(schema.TABLES[name])
    required = ("id", *schema.REQUIRED[name])
    out = []
    for f in fields:
        c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if f.name in schema.LISTS:
            c = F.coalesce(c, F.array().cast(f.dataType))
        if f.name in ("is_kit", "is_searchable"):
            c = F.coalesce(c, F.lit(False))
        if f.name in required:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{name}.{f.name} is null")).cast(f.dataType)).otherwise(c)
        if options := schema.CHOICES.get((name, f.name)):
            c = F.when(c.isNull() | c.isin(*options), c).otherwise(F.raise_error(F.concat(F.lit(f"{name}.{f.name}: "), c)).cast(f.dataType))
        out.append(c.alias(f.name))
    return rows.select(*out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a folder of this machine on a local master only; on
    a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="vitrine-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append(rows: DataFrame, name: str, path: str, partition: str | None = "catalog_id") -> None:
    """Append checked rows to a table's folder, by catalogue where it has one: a catalogue's rows come together first, a
    large one's in several parts, so that there is not a file for each task and catalogue."""
    checked = conformed(rows, name)
    if partition and partition in schema.TABLES[name]:
        checked.hint("rebalance", F.col(partition)).write.mode("append").partitionBy(partition).parquet(path)
    else:
        checked.write.mode("append").parquet(path)


def with_vectors(table: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """The table with the vectors of `vectors` (key, vector) in place of its own; empty or zero vectors change nothing."""
    fresh = vectors.where(nonzero(F.col("vector"))).select(F.col(key).alias("_k"), F.col("vector").alias("_v"))
    wide = table.join(fresh, table[key] == F.col("_k"), "left")
    return wide.withColumn("embedding", F.coalesce("_v", "embedding")).drop("_k", "_v")


def reembedded(table: DataFrame, text: str, make: Callable[[], Provider]) -> tuple[DataFrame, DataFrame]:
    """The table with all vectors made anew, where that worked, and one row of counts: ok, failed."""
    out = embedded(table.withColumnRenamed("embedding", "_old"), text, make, "_new")
    counts = out.agg(F.count_if(F.col("_new_error").isNull()).alias("ok"), F.count_if(F.col("_new_error").isNotNull()).alias("failed"))
    return out.withColumn("embedding", F.coalesce("_new", "_old")).drop("_old", "_new", "_new_error"), counts


def uploaded(blobs: DataFrame, folder: str, base_url: str) -> DataFrame:
    """Write blobs (path, content) under a folder of any file system that pyarrow opens; path, url, error of each.

    A blob that is there is replaced; each is written under another name first, so a task that runs again does no harm."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for path, content in batch[["path", "content"]].itertuples(index=False):
                try:
                    target = f"{root}/{path}"
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    part = f"{target}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as f:
                        f.write(content)
                    fs.move(part, target)
                    rows.append((path, f"{base_url}/storage/v1/object/public/{path}", None))
                except (OSError, ValueError) as e:
                    rows.append((path, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "url", "error"])

    return blobs.select("path", "content").mapInPandas(put, "path string, url string, error string")
