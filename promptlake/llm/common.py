"""Small helpers that the operators of this package share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import import_on_workers

#: ASCII white space, as Java regular expressions and as a trim set.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_SET = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors. rows_a_file bounds what one
    read holds of very large rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of exchanges that nothing can read any more once the driver has collected their handles: collect them now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ends_up_to(ends: Column, common: Column) -> Column:
    """For each of the ascending common ends, how many of the ascending ends are not beyond it."""
    merged = F.sort_array(F.concat(F.transform(ends, lambda e: e * F.lit(2)), F.transform(common, lambda e: e * F.lit(2) + F.lit(1))))
    spots = F.filter(F.transform(merged, lambda e, i: F.when(e % 2 == 1, i).otherwise(-1)), lambda i: i >= 0)
    return F.transform(spots, lambda i, k: i - k)


def cut_at(values: Column, upto: Column) -> Column:
    """The values cut at the counts in upto, which ascend."""
    return let(upto, lambda u: F.transform(u, lambda to, k: let(F.when(k == 0, 0).otherwise(F.get(u, k - 1)), lambda of: F.slice(values, of + 1, to - of))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 20_000) -> DataFrame:
    """A broadcast hint where the counted rows allow it; otherwise the join stays a shuffle join."""
    return F.broadcast(df) if rows <= limit else df
