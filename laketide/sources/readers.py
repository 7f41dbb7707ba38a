"""Readers for landing folders and tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from laketide.sources.writers import exists


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. With a declared schema the files are read once; inference costs an
    extra pass over all of them and turns id strings such as 000000001 into numbers."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def with_audit(df: DataFrame, run_id: str, load_type: str, at: Column, source_file: Column | None = None) -> DataFrame:
    """Ingestion columns. Pass ``F.col("_metadata.file_path")`` as ``source_file`` for frames
    read from files; ``at`` is explicit so that a re-run can repeat the same value."""
    return df.withColumns(
        {
            "_ingested_at": at,
            "_ingest_date": at.cast("date"),
            "_source_file": source_file if source_file is not None else F.lit(None).cast("string"),
            "_run_id": F.lit(run_id),
            "_load_type": F.lit(load_type),
        }
    )


def load_if_missing(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Return the table at ``path``; build and store it first when it is not complete there."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_sources(spark: SparkSession, config: Sequence[Mapping], run_id: str, at: Column) -> dict[str, DataFrame]:
    """Read several raw sources by configuration rows ``{name, path, format, schema}``; the
    result is lazy, one audited frame per source."""
    frames = {}
    for entry in config:
        reader = spark.read.options(**entry.get("options", {}))
        if entry.get("schema") is not None:
            reader = reader.schema(entry["schema"])
        df = reader.format(entry["format"]).load(entry["path"])
        audited = with_audit(df.select("*", F.col("_metadata.file_path").alias("__file")), run_id, "full", at, F.col("__file"))
        frames[entry["name"]] = audited.drop("__file").withColumn("_source", F.lit(entry["name"]))
    return frames
