"""Schema evolution: rescue unexpected columns, add new columns, widen types, tables that grow."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType


def rescue_columns(df: DataFrame, expected: StructType, name: str = "_rescued_data") -> DataFrame:
    """Fit a frame to an expected schema. Unexpected columns, and values that do not fit the
    expected type, are kept as one JSON text; NULL when there is nothing to rescue."""
    known = {f.name: f for f in expected.fields}
    extra = [c for c in df.columns if c not in known]
    fitted, misfits = [], []
    for field in expected.fields:
        if field.name not in df.columns:
            fitted.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = F.col(field.name).try_cast(field.dataType)
        fitted.append(value.alias(field.name))
        if df.schema[field.name].dataType != field.dataType:
            misfits.append(F.when(value.isNull(), F.col(field.name)).alias(field.name))
    parts = [F.col(c) for c in extra] + misfits
    if not parts:
        rescued = F.lit(None).cast("string")
    else:
        text = F.to_json(F.struct(*parts))
        rescued = F.when(text != "{}", text)
    return df.select(*fitted, rescued.alias(name))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing columns as typed NULLs."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def append_evolving(df: DataFrame, path: str) -> None:
    """Append a batch whose schema may have grown; readers merge the file schemas."""
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))


# ---- schemas that grow --------------------------------------------------------------------------

_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_DIGITS = dict(zip(_WHOLE, (3, 5, 10, 19), strict=True))


class IncompatibleTypes(ValueError):
    """Two types of one column that no wider type holds without loss."""


def common_type(a: T.DataType, b: T.DataType, name: str = "value") -> T.DataType:
    """The smallest type that holds all values of both: whole numbers widen to larger ones, to
    decimals and, up to 32 bits, to double; float to double; decimals to more digits; a date to a
    timestamp without zone. Structs take the fields of both."""
    kinds = {type(a), type(b)}
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema(a, b, f"{name}.")
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType, f"{name}[]"))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType, f"{name} key"), common_type(a.valueType, b.valueType, f"{name} value"))
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        return _decimal(max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale), name, a, b)
    if a == b:
        return a
    if kinds <= set(_WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    for x, y in ((a, b), (b, a)):
        if type(x) in _DIGITS and isinstance(y, T.DecimalType):
            return _decimal(max(_DIGITS[type(x)], y.precision - y.scale), y.scale, name, a, b)
        if type(x) in _WHOLE[:3] and isinstance(y, T.DoubleType):
            return y
        if type(x) in _WHOLE[:3] and isinstance(y, T.FloatType):
            return y if type(x) in _WHOLE[:2] else T.DoubleType()
    if kinds == {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    raise IncompatibleTypes(f"{name}: {a.simpleString()} and {b.simpleString()} have no common type")


def _decimal(whole: int, scale: int, name: str, a: T.DataType, b: T.DataType) -> T.DecimalType:
    if whole + scale > 38:
        raise IncompatibleTypes(f"{name}: {a.simpleString()} and {b.simpleString()} need {whole + scale} digits")
    return T.DecimalType(whole + scale, scale)


def _by_name(schema: StructType, path: str) -> dict[str, T.StructField]:
    out: dict[str, T.StructField] = {}
    for f in schema.fields:
        if f.name.lower() in out:
            raise IncompatibleTypes(f"{path}{f.name}: two columns differ in case only")
        out[f.name.lower()] = f
    return out


def common_schema(a: StructType, b: StructType, path: str = "") -> StructType:
    """Columns of ``a`` in their order, wide enough for ``b``, then the columns only ``b`` has. Names
    are compared without case, as Spark does; ``a`` decides how they are written."""
    left, right = _by_name(a, path), _by_name(b, path)
    kept = [T.StructField(f.name, common_type(f.dataType, right[k].dataType, path + f.name) if k in right else f.dataType) for k, f in left.items()]
    return StructType([*kept, *[T.StructField(f.name, f.dataType) for k, f in right.items() if k not in left]])


def _widened(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, StructType):
        fields = _by_name(have, "")
        parts = [
            (_widened(value.getField(fields[f.name.lower()].name), fields[f.name.lower()].dataType, f.dataType) if f.name.lower() in fields else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: _widened(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        values = F.transform_values(value, lambda _, x: _widened(x, have.valueType, want.valueType))
        return F.transform_keys(values, lambda k, _: _widened(k, have.keyType, want.keyType))
    return value.cast(want)


def fit_to(df: DataFrame, schema: StructType) -> DataFrame:
    """A frame in a wider schema: types are widened, at any depth, and missing columns are NULL."""
    have = _by_name(df.schema, "")
    columns = []
    for f in schema.fields:
        own = have.get(f.name.lower())
        if own is None:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif own.dataType.simpleString() == f.dataType.simpleString():
            columns.append(F.col(f"`{own.name}`").alias(f.name))
        else:
            columns.append(_widened(F.col(f"`{own.name}`"), own.dataType, f.dataType).alias(f.name))
    return df.select(*columns)


class GrowingTable:
    """A Parquet table that only grows and whose batches may bring new columns and wider types.

    Files of one schema lie in one folder, named by the schema, so no file is ever rewritten; a
    read takes each folder with its own schema, widens it and stacks them. There are as many
    folders as there were schemas. ``partition_by`` columns are pruned in every folder."""

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), list(partition_by)

    def _folders(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        return sorted(s.getPath().toString() for s in files.listStatus(root) if s.getPath().getName().startswith("schema="))

    def _generations(self) -> list[DataFrame]:
        out = []
        for folder in self._folders():
            text = self.spark.read.text(f"{folder}/columns", wholetext=True).first()
            if text is not None:
                schema = StructType.fromDDL(text[0])
                out.append(self.spark.read.schema(schema).parquet(f"{folder}/rows"))
        return out

    def schema(self) -> StructType | None:
        """The common schema of all batches; None before the first."""
        kinds = [g.schema for g in self._generations()]
        return reduce(common_schema, kinds) if kinds else None

    def append(self, df: DataFrame, overwrite_partitions: bool = False) -> None:
        """Add a batch; refused if its columns and the table's have no common type. With
        ``overwrite_partitions`` a repeated batch replaces its own partitions."""
        known = self.schema()
        if known is not None:
            common_schema(known, df.schema)
        name = hashlib.sha256(df.schema.simpleString().encode()).hexdigest()[:12]
        folder = f"{self.path}/schema={name}"
        if folder.rsplit("/", 1)[1] not in {f.rsplit("/", 1)[1] for f in self._folders()}:
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            self.spark.createDataFrame([(ddl,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/columns")
        writer = df.write.mode("overwrite" if overwrite_partitions else "append").partitionBy(*self.partition_by)
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/rows")

    def read(self) -> DataFrame:
        parts = self._generations()
        if not parts:
            raise ValueError(f"no rows at {self.path}")
        schema = reduce(common_schema, [p.schema for p in parts])
        return reduce(DataFrame.unionByName, [fit_to(p, schema) for p in parts])
