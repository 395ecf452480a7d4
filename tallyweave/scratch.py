"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where it is unset a local master gets a folder of its own, as in tests; a
    cluster gets an error, as executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    Lost executors cost nothing that was written, plans don't nest, and values that
    Spark may compute differently a second time (row numbers, samples) are fixed.
    What nothing reads any more goes by ``discard``; the folder of a run that was
    stopped, and the last table of a result, are the user's to delete.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


class Tables:
    """The intermediate tables of one operator, all deleted when the block ends but those of ``result``.

    Where the block fails, everything goes. A DataFrame returned from the block
    must read given tables and results only.
    """

    def __init__(self) -> None:
        self.own: list[DataFrame] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error: object) -> None:
        discard(*self.own)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.own.append(written(df, name))
        return self.own[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete before the block ends what nothing reads any more."""
        self.own = [t for t in self.own if all(t is not x for x in tables)]
        discard(*tables)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with its place from 0 in the whole order, without ever sorting it in one task.

    Rows are sorted by ranges and written; what comes before a range is then known
    from a count of each. Only these counts, one for each partition, meet in one task.
    """
    part = F.spark_partition_id()
    rows = written(df.orderBy(*order).withColumn("_part", part).withColumn("_n", F.monotonically_increasing_id()), name)
    first = rows.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_n").alias("_first")).selectExpr("_part", "_first", "sum(_rows) over (order by _part) - _rows as _before")
    return rows.join(F.broadcast(first), "_part").withColumn(name, F.col("_n") - F.col("_first") + F.col("_before")).drop("_part", "_n", "_first", "_before")
