"""Files laid out by several columns at once, so that a filter on any of them skips files.

Each column becomes a range rank: how many of its quantile bounds a value reaches. The bits of
the ranks are interleaved to one key, and the table is range-partitioned and sorted by that key, so
a file holds a small box of all columns instead of a thin slice of the first one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laketide.functions.scalars import bucket_by_bounds
from laketide.operators.joins import row_bytes
from laketide.sources.writers import TARGET_FILE_BYTES

MAX_BITS = 10
#: Bytes of row values that make a byte of Parquet, as a rough guide to file sizes.
PACKED = 3


def file_count(df: DataFrame, target_bytes: int = TARGET_FILE_BYTES) -> int:
    """Files of about ``target_bytes`` for a frame, from the measured bytes of its values."""
    held = df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0
    return max(1, math.ceil(held / PACKED / target_bytes))


def number_of(df: DataFrame, column: str) -> Column:
    """An image of a column as a number that keeps its order; of text the first seven bytes count."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(value, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value).cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        first = F.substring(F.concat(value.cast("binary"), F.lit(b"\0" * 7)), 1, 7)
        return F.conv(F.hex(first), 16, 10).cast("double")
    raise TypeError(f"{column}: {kind.simpleString()} has no order to lay files out by")


def range_ranks(df: DataFrame, columns: Sequence[str], bits: int) -> list[Column]:
    """For each column the number of its ``2**bits - 1`` approximate quantiles that a value reaches; NULL has
    0. One aggregate for all columns; only the bounds come to the driver. Where a bound lies
    changes the balance of the files, never a row."""
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(number_of(df, c), F.lit(at), F.lit(10 << bits)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [bucket_by_bounds(number_of(df, c), sorted(set(found[f"b{i}"] or []))) for i, c in enumerate(columns)]


def interleaved(ranks: Sequence[Column], bits: int) -> Column:
    """The bits of all ranks in turn, the highest first."""
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for i, rank in enumerate(ranks):
            one = F.shiftright(rank.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(one, bit * len(ranks) + i))
    return key


def zorder(df: DataFrame, path: str, columns: Sequence[str], files: int | None = None, target_bytes: int = TARGET_FILE_BYTES) -> int:
    """Write ``df`` laid out by the interleaved ranks of ``columns``; returns the number of files aimed at.

    The count follows from the bytes and the number of bits from the count. Rows of one key, such as
    a value that fills a third of the table, are dealt over several files by a hash."""
    files = file_count(df, target_bytes) if files is None else files
    bits = max(1, min(MAX_BITS, 62 // len(columns), math.ceil(math.log2(max(files, 2)) / len(columns)) + 3))
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])
    keyed = df.select("*", interleaved(range_ranks(df, columns, bits), bits).alias("__z"))
    ranged = keyed.repartitionByRange(files, F.col("__z"), spread)
    ranged.sortWithinPartitions("__z", *columns).drop("__z").write.mode("overwrite").parquet(path)
    return files


def file_ranges(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Per file of a table its rows and the range of each column, as a filter would use them to skip it."""
    ends = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *ends)


def files_touched(ranges: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """How many files a filter ``column BETWEEN low AND high`` cannot skip, and how many there are."""
    meets = (F.col(f"lo_{column}") <= F.lit(high)) & (F.col(f"hi_{column}") >= F.lit(low))
    return ranges.agg(F.count_if(meets).alias("touched"), F.count("*").alias("files"))
