"""Streaming sources, triggers and run-to-completion helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, fmt: str, schema: StructType | str, **options) -> DataFrame:
    """Files of a landing folder as a stream, with the file each row came from."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return reader.load(path).select("*", F.col("_metadata.file_path").alias("_source_file"))


def table_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table that only grows, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def evolving_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """A Parquet landing folder whose files may bring new columns. The merged schema is taken
    from the file footers when the stream starts, so a restart from the same checkpoint picks
    up columns that came since; older files read them as NULL."""
    merged = spark.read.option("mergeSchema", True).parquet(path).schema
    return spark.readStream.schema(merged).options(**options).parquet(path)


def triggered(writer: DataStreamWriter, kind: str = "available_now", interval: str | None = None) -> DataStreamWriter:
    """``available_now`` reads what is there and stops; the other kinds keep running."""
    options = {
        "available_now": {"availableNow": True},
        "processing_time": {"processingTime": interval},
        "continuous": {"continuous": interval},
    }
    return writer.trigger(**options[kind])


def append_to(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), kind: str = "available_now", interval: str | None = None) -> StreamingQuery:
    """Append to a Parquet folder. The checkpoint remembers which files were read and the
    sink's own log which files it wrote, so a re-run adds new input only."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return triggered(writer, kind, interval).start()


def run_batches(df: DataFrame, process, checkpoint: str, mode: str = "append", kind: str = "available_now", interval: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to ``process(batch, batch_id)``."""
    writer = df.writeStream.foreachBatch(process).outputMode(mode).option("checkpointLocation", checkpoint)
    return triggered(writer, kind, interval).start()


def await_all(queries: Sequence[StreamingQuery]) -> None:
    """Wait for several started streams; the first failure is raised after the others are
    stopped."""
    try:
        for q in queries:
            q.awaitTermination()
    except Exception:
        for q in queries:
            q.stop()
        raise


def active_streams(spark: SparkSession) -> list[str]:
    return [q.name or str(q.id) for q in spark.streams.active]


def stop_all(spark: SparkSession) -> None:
    for q in spark.streams.active:
        q.stop()


class SchemaChanged(RuntimeError):
    """The files of a micro-batch have columns that the running reader does not know."""


def _known(fields, known) -> list[str]:
    have = {f.name.lower(): f.dataType for f in known.fields}
    return [f.name for f in fields if have.get(f.name.lower()) != f.dataType]


def run_evolving(spark: SparkSession, path: str, process, checkpoint: str, restarts: int = 1, reader=None, **options) -> int:
    """Read a Parquet landing folder to its end, also when files with new columns arrive meanwhile.

    Before a micro-batch is handed to ``process`` the footers of its own files are compared with
    the schema of the running reader. A batch with unknown columns fails before anything of it is
    written; the reader is opened again with the merged schema of the folder, on the same
    checkpoint, and the batch is the first one it repeats. After ``restarts`` such restarts, and
    for any other failure, the error is raised. ``reader`` opens the stream, by default
    ``evolving_stream``. Returns the number of restarts."""
    for attempt in range(restarts + 1):
        stream = reader() if reader else evolving_stream(spark, path, **options)
        known = stream.schema

        def guarded(batch: DataFrame, batch_id: int, known=known) -> None:
            files = [r[0] for r in batch.select("_source_file").distinct().collect()]  # those of one batch
            if files:
                new = _known(spark.read.option("mergeSchema", True).parquet(*files).schema.fields, known)
                if new:
                    raise SchemaChanged(f"new or changed columns {new}")
            process(batch.drop("_source_file"), batch_id)

        marked = stream.select("*", F.col("_metadata.file_path").alias("_source_file"))
        query = run_batches(marked, guarded, checkpoint)
        try:
            await_all([query])
            return attempt
        except Exception as failure:
            if attempt == restarts or "SchemaChanged" not in str(failure):
                raise
    raise AssertionError("not reached")
