"""What the text operators share: words, stored tables, block sizes."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laketide.session import fresh_dir

#: The white space of every contract here, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they may not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_laketide_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="laketide-code-")) / "laketide.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._laketide_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without white space; none for null or empty text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


#: Spark's own setting: shuffle files of a query are removed when it ends, not when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of the batches in which rows travel to Python; a batch is held several times, in the JVM and in the worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """The rows written below the shared folder and read again.

    What several jobs need is computed once, and a lost executor loses none of it. Nothing reads
    the shuffle files of the write again, so they go with it. ``batch_bytes`` bounds the batches
    that the write sends to Python, but for a row that is larger alone.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, f"llm-{label}")
    wanted = {CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing lazy reads any more."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/laketide/llm-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def block_count(df: DataFrame, size: Column, per_block: int) -> int:
    """How many blocks of about ``per_block`` hold the rows: it grows with the data."""
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // per_block))
