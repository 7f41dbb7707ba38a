"""Ingestion under a declared schema that loses nothing: what does not fit is kept as JSON text.

JSON lines are parsed twice, as the declared schema and as a variant; the declared fields that
fit are taken out of the variant and the rest is the rescued text: unknown fields, at any depth of
declared structs, and values whose type does not fit. CSV lines are matched with the header of
their own file, so files may bring new columns or another order; values that cannot be cast,
columns nobody declared and lines that do not parse are rescued. ``rescued`` is NULL when there is
nothing to rescue. A record that cannot be read at all is kept whole under ``_corrupt_record``.

Everything is a column expression, so the same functions serve batches and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laketide.operators.joins import broadcast_if_small
from laketide.sources.writers import stored

RESCUED = "_rescued_data"
CORRUPT = "_corrupt_record"
#: Lines of a CSV file are read as one column: no text holds this separator.
NO_SEPARATOR = "￿"


def schema_of(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


# ---- JSON ---------------------------------------------------------------------------------------


def _misfit(raw: Column, typed: Column, kind: T.DataType) -> Column:
    """A value is there, and the declared type does not hold all of it."""
    lost = raw.isNotNull() & ~F.is_variant_null(raw) & typed.isNull()
    inner = None
    if isinstance(kind, T.StructType):
        inner = F.size(_leftover(raw, typed, kind)) > 0
    elif isinstance(kind, T.ArrayType):
        pairs = F.zip_with(F.try_variant_get(raw, "$", "array<variant>"), typed, lambda r, t: _misfit(r, t, kind.elementType))
        inner = F.exists(pairs, lambda x: x)
    elif isinstance(kind, T.MapType):
        pairs = F.map_zip_with(F.try_variant_get(raw, "$", "map<string,variant>"), typed, lambda _, r, t: _misfit(r, t, kind.valueType))
        inner = F.exists(F.map_values(pairs), lambda x: x)
    return lost if inner is None else F.coalesce(lost, F.lit(False)) | F.coalesce(inner, F.lit(False))


def _leftover(raw: Column, typed: Column, kind: T.StructType) -> Column:
    """map<string,variant>: the fields of an object that are unknown or do not fit; NULL if it is no object."""
    fields = F.try_variant_get(raw, "$", "map<string,variant>")
    none = F.map_filter(fields, lambda k, v: F.lit(False))
    parts = [F.map_filter(fields, lambda k, v: ~k.isin([f.name for f in kind.fields])) if kind.fields else fields]
    for f in kind.fields:
        value, fit = F.try_element_at(fields, F.lit(f.name)), typed.getField(f.name)
        part = F.when(F.coalesce(_misfit(value, fit, f.dataType), F.lit(False)), F.create_map(F.lit(f.name), value)).otherwise(none)
        if isinstance(f.dataType, T.StructType):  # of a nested object only what does not fit
            rest = _leftover(value, fit, f.dataType)
            part = F.when(F.size(rest) > 0, F.create_map(F.lit(f.name), F.to_variant_object(rest))).otherwise(part)
        parts.append(part)
    return F.map_concat(*parts) if len(parts) > 1 else parts[0]


def rescue_json(lines: DataFrame, schema: T.StructType | str, value: str = "value", rescued: str = RESCUED) -> DataFrame:
    """``lines`` (text column ``value``, a JSON object in each row) as the declared columns and the
    rescued text; other columns of ``lines`` follow. Blank lines are skipped, as the JSON reader does."""
    kind = schema_of(lines.sparkSession, schema)
    others = [F.col(f"`{c}`") for c in lines.columns if c != value]
    raw = F.try_parse_json(F.col(value))
    read = lines.where(F.trim(F.coalesce(value, F.lit(""))) != "").select(*others, F.col(value).alias("__line"), raw.alias("__raw"), F.from_json(value, kind).alias("__typed"))
    is_object = F.try_variant_get("__raw", "$", "map<string,variant>").isNotNull()
    rest = _leftover(F.col("__raw"), F.col("__typed"), kind)
    text = F.when(~is_object, F.to_json(F.struct(F.col("__line").alias(CORRUPT)))).when(F.size(rest) > 0, F.to_json(rest))
    typed = [F.when(is_object, F.col("__typed").getField(f.name)).alias(f.name) for f in kind.fields]
    return read.select(*typed, text.alias(rescued), *others)


def read_json_rescued(spark: SparkSession, path: str, schema: T.StructType | str, rescued: str = RESCUED) -> DataFrame:
    """JSON lines with rescued data and the file each row came from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_source_file"))
    return rescue_json(lines, schema, rescued=rescued)


def stream_json_rescued(spark: SparkSession, path: str, schema: T.StructType | str, rescued: str = RESCUED, **options) -> DataFrame:
    lines = spark.readStream.options(**options).text(path).select("value", F.col("_metadata.file_path").alias("_source_file"))
    return rescue_json(lines, schema, rescued=rescued)


# ---- CSV ----------------------------------------------------------------------------------------


def csv_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``_source_file`` and ``header``, the first line of every file: a minimum by position that is
    combined before the shuffle, one row per file."""
    place = F.monotonically_increasing_id().alias("place")
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_block_start").alias("start"), place)
    return lines.where("start = 0").groupBy("_source_file").agg(F.min_by("value", "place").alias("header"))


def _lines(reader, path: str | list[str]) -> DataFrame:
    """The lines of CSV files without their headers, and the file of each."""
    whole = reader.schema("value string").option("header", True).option("sep", NO_SEPARATOR).option("quote", "").option("enforceSchema", True)
    return whole.csv(path).select("value", F.col("_metadata.file_path").alias("_source_file"))


def _names(header: str) -> list[str]:
    """The columns of a header line; a repeated name gets its number."""
    import csv

    seen: dict[str, int] = {}
    out = []
    for name in next(csv.reader([header.removeprefix("﻿")]), []):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}__{seen[name]}")
    return out


def rescue_csv(lines: DataFrame, headers: DataFrame, schema: T.StructType | str, rescued: str = RESCUED) -> DataFrame:
    """``lines`` (``value``, ``_source_file``, others) as the declared columns and the rescued text.

    Each different header line, of which there are as many as changes of the format, is parsed by
    its own columns. A line with more or fewer values than its header is kept as text beside what
    could be read of it."""
    spark = lines.sparkSession
    kind = schema_of(spark, schema)
    declared = [f.name for f in kind.fields]
    others = [F.col(f"`{c}`") for c in lines.columns if c != "value"]
    known = [r["header"] for r in headers.select("header").distinct().collect()]  # one row per change of the format
    located = lines.join(broadcast_if_small(headers), "_source_file", "left")
    parsed, broken = F.lit(None).cast("map<string,string>"), F.lit(None).cast("string")
    for header in known:
        names = _names(header or "")
        struct = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT])
        row = F.from_csv("value", struct, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE", "escape": '"'})
        fields = F.create_map(*[x for n in names for x in (F.lit(n), row.getField(n))]).cast("map<string,string>")
        mine = F.col("header").eqNullSafe(F.lit(header))
        parsed = F.when(mine, fields).otherwise(parsed)
        broken = F.when(mine, row.getField(CORRUPT)).otherwise(broken)
    read = located.select(*others, F.col("value").alias("__line"), parsed.alias("__fields"), broken.alias("__broken"))

    fields = F.col("__fields")
    typed, rest = [], [F.map_filter(fields, lambda k, v: v.isNotNull() & ~k.isin(declared)) if declared else fields]
    for f in kind.fields:
        value = F.try_element_at(fields, F.lit(f.name))
        fit = value.try_cast(f.dataType)
        typed.append(fit.alias(f.name))
        lost = value.isNotNull() & fit.isNull()
        rest.append(F.when(lost, F.create_map(F.lit(f.name), value)).otherwise(F.map_filter(fields, lambda k, v: F.lit(False))))
    whole = F.coalesce(F.col("__broken"), F.when(fields.isNull(), F.col("__line")))
    nothing = F.create_map().cast("map<string,string>")
    left = F.map_concat(F.coalesce(F.map_concat(*rest), nothing), F.when(whole.isNotNull(), F.create_map(F.lit(CORRUPT), whole)).otherwise(nothing))
    return read.select(*typed, F.when(F.size(left) > 0, F.to_json(left)).alias(rescued), *others)


def read_csv_rescued(spark: SparkSession, path: str | list[str], schema: T.StructType | str, rescued: str = RESCUED) -> DataFrame:
    """CSV files with headers that may differ, with rescued data and the file of each row. A quote in
    a quoted value is doubled; a value must not hold a line break."""
    return rescue_csv(_lines(spark.read, path), stored(csv_headers(spark, path), "csv_headers"), schema, rescued)


def stream_csv_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of a landing folder as a stream; ``rescued_batches`` turns its batches into columns."""
    return _lines(spark.readStream.options(**options), path)


def rescued_batches(process, schema: T.StructType | str, rescued: str = RESCUED):
    """A micro-batch function for ``stream_csv_lines``: reads the headers of the batch's own files,
    a number that ``maxFilesPerTrigger`` bounds, and hands the rescued rows to ``process``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        files = [r[0] for r in batch.select("_source_file").distinct().collect()]
        if not files:
            process(rescue_csv(batch, batch.sparkSession.createDataFrame([], "_source_file string, header string"), schema, rescued), batch_id)
            return
        headers = stored(csv_headers(batch.sparkSession, files), "csv_headers")
        process(rescue_csv(batch, headers, schema, rescued), batch_id)

    return each


def ingest_report(df: DataFrame, rescued: str = RESCUED) -> DataFrame:
    """Rows, rows with rescued data and files by source column ``_source_file``, in one aggregate."""
    return df.agg(F.count("*").alias("rows"), F.count(rescued).alias("rescued_rows"), F.countDistinct("_source_file").alias("files"))
