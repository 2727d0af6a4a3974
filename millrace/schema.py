"""Canonical types, and what a table's schema carries beyond Spark's.

Primary keys, original types and JSON paths live in ``StructField.metadata``, so they
travel with a DataFrame through ``select`` and file formats alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical name -> Spark type.  Unsigned types widen by one; uint64 needs twenty digits.
SPARK_TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(), "double": T.DoubleType(), "string": T.BinaryType(), "utf8": T.StringType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(), "timestamp": T.TimestampType(),
    "interval": T.DayTimeIntervalType(), "any": T.StringType(),
}
RANGES = {f"int{n}": (-(2 ** (n - 1)), 2 ** (n - 1) - 1) for n in (8, 16, 32, 64)} | {f"uint{n}": (0, 2**n - 1) for n in (8, 16, 32, 64)}


def field(name: str, canonical: str, key: bool = False, required: bool = False, path: str = "", original: str = "") -> T.StructField:
    meta = {"canonical": canonical, "key": key, "path": path, "original_type": original}
    return T.StructField(name, SPARK_TYPES[canonical], not required, {k: v for k, v in meta.items() if v})


def canonical_of(f: T.StructField) -> str:
    """The declared canonical type of a field, else the one its Spark type stands for."""
    if "canonical" in f.metadata:
        return f.metadata["canonical"]
    simple = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double", T.BinaryType: "string", T.StringType: "utf8", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.DayTimeIntervalType: "interval"}
    return simple.get(type(f.dataType), "double" if isinstance(f.dataType, T.DecimalType) else "any")


def keys_of(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if f.metadata.get("key")]


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mark the primary key; other columns lose the mark."""
    out = []
    for f in df.schema:
        meta = {k: v for k, v in f.metadata.items() if k != "key"}
        out.append(F.col(f"`{f.name}`").alias(f.name, metadata=meta | ({"key": True} if f.name in keys else {})))
    return df.select(*out)


def schema_hash(schema: T.StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()


@dataclass(frozen=True)
class TableId:
    namespace: str
    name: str

    def quoted(self) -> str:
        q = lambda s: '"' + s.replace('"', '""') + '"'
        return f"{q(self.namespace)}.{q(self.name)}" if self.namespace else q(self.name)

    def variants(self) -> list[str]:
        return [f"{self.namespace}.{self.name}" if self.namespace else self.name, self.quoted()]

    def includes(self, other: TableId) -> bool:
        """An empty namespace or ``*`` stands for all."""
        return self.namespace in ("", "*", other.namespace) and self.name in ("*", other.name)


def strictify(value: Column, canonical: str) -> Column:
    """The value as its canonical type; a number outside the type's range or without a whole value is an error."""
    target = SPARK_TYPES[canonical]
    if canonical not in RANGES:
        return value.cast(target)
    low, high = RANGES[canonical]
    number = value.try_cast("decimal(38,6)")
    fits = number.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")) & (number == F.floor(number))
    wrong = F.raise_error(F.concat(F.lit(f"not a value of {canonical}: "), value.cast("string")))
    return F.when(value.isNull(), F.lit(None).cast(target)).when(fits, number.cast(target)).otherwise(wrong.cast(target))


def try_strictify(value: Column, canonical: str) -> Column:
    """As :func:`strictify`, with null for what does not fit."""
    target = SPARK_TYPES[canonical]
    if canonical not in RANGES:
        return value.try_cast(target)
    low, high = RANGES[canonical]
    number = value.try_cast("decimal(38,6)")
    return F.when(number.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), number.try_cast(target))


def strictness(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row a column: how many values are not of their canonical type."""
    counts = [F.count_if(F.col(f"`{c}`").isNotNull() & try_strictify(F.col(f"`{c}`"), t).isNull()).alias(c) for c, t in wanted.items()]
    row = df.agg(*counts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("violations")) for c in wanted])).alias("r")).select("r.*")


@dataclass(frozen=True)
class Fallback:
    """Rewrites tables for consumers of an older version of the type system."""

    to: int
    apply: Callable[[DataFrame], DataFrame]


def apply_fallbacks(df: DataFrame, version: int, fallbacks: list[Fallback]) -> DataFrame:
    """The newest first, down to the version asked for."""
    for f in sorted(fallbacks, key=lambda f: -f.to):
        if f.to >= version:
            df = f.apply(df)
    return df


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name) for f in df.schema])


def timestamps_to_seconds(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_trunc("second", f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema])


def underscore_without_namespace(df: DataFrame) -> DataFrame:
    return df.withColumn("_table", F.when(F.coalesce("_schema", F.lit("")) == "", F.concat(F.lit("_"), "_table")).otherwise(F.col("_table")))
