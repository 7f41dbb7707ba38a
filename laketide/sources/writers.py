"""Writers: replace one partition, compaction, clustered layout, empty clones."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laketide.session import fresh_dir

TARGET_FILE_BYTES = 192 * 1024 * 1024


def exists(spark: SparkSession, path: str) -> bool:
    """True when a committed Parquet table lies at ``path``. A write that died leaves only a
    temporary folder, which holds nothing to read."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full replacement, schema included. ``path`` must not be a table that ``df`` reads."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def clustered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a partition together, for few files, but a large partition over several tasks:
    adaptive execution splits a rebalanced shuffle by size."""
    return df.hint("rebalance", *columns) if columns else df


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], values: Sequence[Mapping[str, object]] = ()) -> None:
    """Replace exactly the partitions that ``df`` contains, so a repeated load of a day
    leaves one copy of it.

    ``values`` names partitions that the load is about (a mapping from every partition column
    to its value): one that got no row is emptied, so a day that lost all its rows is gone."""
    wanted = [{c: v[c] for c in partition_by} for v in values]
    filled = set()
    for v in wanted:
        if not df.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(x)) for c, x in v.items()])).isEmpty():
            filled.add(tuple(v.values()))
    clustered(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)

    spark = df.sparkSession
    for v in wanted:
        if tuple(v.values()) not in filled:
            folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *[f"{c}={_folder(x)}" for c, x in v.items()]]))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _folder(value: object) -> str:
    """A value as it stands in a partition folder's name."""
    return "__HIVE_DEFAULT_PARTITION__" if value is None else quote(str(value), safe=" -_.,;+()@&~!$")


def create_empty_like(df: DataFrame, path: str) -> None:
    df.limit(0).write.mode("overwrite").parquet(path)


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """Files, rows and bytes of a table, from the file metadata columns."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
    per_file = files.groupBy("file_path", "file_size").agg(F.count("*").alias("rows"))
    return per_file.agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("file_size").alias("bytes")
    )


def compact(spark: SparkSession, path: str, into: str, target_bytes: int = TARGET_FILE_BYTES) -> None:
    """Rewrite many small files as files of about ``target_bytes`` at a new path.

    A task reads the small files of its large one: nothing is shuffled, since rows unpacked from
    Parquet would be many times the bytes of their file, all read by the task that writes it."""
    stats = file_counts(spark, path).first()
    n = max(1, math.ceil((stats["bytes"] or 0) / target_bytes))
    spark.read.parquet(path).coalesce(n).write.mode("overwrite").parquet(into)


def cluster(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None) -> None:
    """Range-partition and sort by the keys, so each file holds a narrow value range and a
    filter skips files and row groups by their min/max statistics."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Store a result that is read several times and continue from the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` below the shared folder: later jobs read the table instead of
    computing it again, also when an executor is lost."""
    return materialize(df, fresh_dir(df.sparkSession, label))
