"""Comparison of two tables by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.parts import by_keys, hash_sample, top_bottom

#: Digits of doubles that count.
DIGITS = 12
FULL_BYTES = 20 * 1024 * 1024


def same(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    """Whether two stores mean the same value: nulls, numbers to twelve digits, times, bytes, JSON whatever its layout."""
    number = (T.FloatType, T.DoubleType, T.DecimalType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    real = (T.FloatType, T.DoubleType)
    if isinstance(ka, real) and isinstance(kb, number) or isinstance(kb, real) and isinstance(ka, number):
        x, y = a.cast("double"), b.cast("double")
        near = F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * 10.0**-DIGITS
        equal = near | (x == y)
    elif isinstance(ka, T.StringType) and isinstance(kb, T.StringType):
        ja, jb = F.try_parse_json(a), F.try_parse_json(b)
        equal = (a == b) | F.coalesce(a.rlike(r"^\s*[\[{]") & b.rlike(r"^\s*[\[{]") & (F.to_json(ja) == F.to_json(jb)), F.lit(False))
    elif type(ka) is type(kb):
        equal = a == b
    elif isinstance(ka, T.StringType) or isinstance(kb, T.StringType):
        other = kb if isinstance(ka, T.StringType) else ka
        equal = a.try_cast(other) == b.try_cast(other)
    else:
        equal = a.cast("string") == b.cast("string")
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(equal, F.lit(False)))


@dataclass
class Comparison:
    schema: list[str]
    differences: DataFrame


def compare_schemas(a: T.StructType, b: T.StructType) -> list[str]:
    missing = [f"{n}: only on the left" for n in a.names if n not in b.names] + [f"{n}: only on the right" for n in b.names if n not in a.names]
    return missing


def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> Comparison:
    """Rows (key columns, difference, columns): 'missing left', 'missing right' or 'values', with the columns that differ.

    One full outer join on the key.
    """
    common = [c for c in left.columns if c in right.columns and c not in keys]
    l = left.select(*[F.col(k).alias(f"__l_{k}") for k in keys], F.struct(F.lit(1).alias("__"), *common).alias("__l"))
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.struct(F.lit(1).alias("__"), *common).alias("__r"))
    both = l.join(r, [F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}")) for k in keys], "full_outer")
    off = F.filter(F.array(*[F.when(~same(F.col(f"__l.{c}"), F.col(f"__r.{c}"), left.schema[c].dataType, right.schema[c].dataType), F.lit(c)) for c in common], F.lit(None).cast("string")), lambda c: c.isNotNull())
    kind = F.when(F.col("__l").isNull(), "missing left").when(F.col("__r").isNull(), "missing right").when(F.size(off) > 0, "values")
    out = both.select(*[F.coalesce(f"__l_{k}", f"__r_{k}").alias(k) for k in keys], kind.alias("difference"), F.when(kind == "values", off).alias("columns"))
    return Comparison(compare_schemas(left.schema, right.schema), out.where("difference IS NOT NULL"))


def sampled_compare(left: DataFrame, right: DataFrame, keys: list[str], full: bool = False, n: int = 1000, one_in: int = 20) -> Comparison:
    """All rows, or the first and last by key and a hash sample of the left, looked up exactly on the right."""
    if full:
        return compare(left, right, keys)
    some = top_bottom(left, keys, n).unionByName(hash_sample(left, keys, one_in)).dropDuplicates(keys)
    return compare(some, by_keys(right, some, keys), keys)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
