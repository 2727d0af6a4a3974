"""Ways to cut a table into parts, to read only what is new, and to sample it."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import text_form


def key_ranges(df: DataFrame, key: str, parts: int) -> list[str]:
    """Conditions that cut the table at quantiles of a key: below the first bound, between bounds, from the last one on."""
    if parts <= 1:
        return []
    bounds = sorted(set(df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] or []))
    if not bounds:
        return []
    quoted = lambda v: str(v).replace("\\", "\\\\").replace("'", "\\'")
    lit = lambda v: repr(v) if isinstance(v, (int, float)) else f"'{quoted(v)}'"
    out = [f"{key} < {lit(bounds[0])} OR {key} IS NULL"]
    out += [f"{key} >= {lit(a)} AND {key} < {lit(b)}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [*out, f"{key} >= {lit(bounds[-1])}"]


def hash_shard(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """The part a row belongs to: the sum of numeric keys modulo the shards, else a hash of the key's text; none without a key."""
    if not keys or shards <= 1:
        return df.withColumn("__shard", F.lit(0))
    if all(isinstance(df.schema[k].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in keys):
        total = F.lit(0).cast("bigint")
        for k in keys:
            total = total + F.coalesce(F.col(k), F.lit(0))
        return df.withColumn("__shard", F.abs(total % shards).cast("int"))
    return df.withColumn("__shard", F.pmod(F.xxhash64(*[text_form(F.col(k), df.schema[k].dataType) for k in keys]), F.lit(shards)).cast("int"))


def jdbc(spark: SparkSession, url: str, table: str, predicates: list[str], properties: dict[str, str]) -> DataFrame:
    """A database table, one task a predicate; needs the database's driver on the class path."""
    return spark.read.jdbc(url, table, predicates=predicates or ["1 = 1"], properties=properties)


@dataclass
class Cursor:
    """How far an incremental table has been read."""

    column: str
    kind: str
    value: str | None = None

    def condition(self) -> str:
        return "true" if self.value is None else f"{self.column} > CAST('{self.value}' AS {self.kind})"

    def to_json(self) -> str:
        return json.dumps({"column": self.column, "kind": self.kind, "value": self.value})


def incremental_window(df: DataFrame, cursor: Cursor) -> tuple[DataFrame, Cursor]:
    """Rows after the cursor up to the largest value now there, and the cursor to keep once they are written.

    Rows that arrive meanwhile lie beyond the window and wait for the next run.
    """
    top = df.where(cursor.condition()).agg(F.max(cursor.column).cast("string").alias("m")).first()["m"]
    if top is None:
        return df.limit(0), cursor
    after = Cursor(cursor.column, cursor.kind, top)
    return df.where(F.expr(cursor.condition()) & ~F.coalesce(F.expr(after.condition()), F.lit(True))), after


def save_cursors(spark: SparkSession, path: str, cursors: dict[str, Cursor]) -> None:
    rows = [(t, c.column, c.kind, c.value) for t, c in cursors.items()]
    spark.createDataFrame(rows, "table string, column string, kind string, value string").coalesce(1).write.mode("overwrite").json(path)


def load_cursors(spark: SparkSession, path: str) -> dict[str, Cursor]:
    rows = spark.read.schema("table string, column string, kind string, value string").json(path).collect()
    return {r["table"]: Cursor(r["column"], r["kind"], r["value"]) for r in rows}


def top_bottom(df: DataFrame, keys: list[str], n: int = 1000) -> DataFrame:
    """The first and the last rows by the key."""
    return df.orderBy(*keys).limit(n).unionByName(df.orderBy(*[F.desc(k) for k in keys]).limit(n))


def hash_sample(df: DataFrame, keys: list[str], one_in: int = 20, limit: int = 2000) -> DataFrame:
    """One row in so many by a hash of the key, some at most; the same rows from equal tables."""
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(one_in)) == 0).orderBy(F.xxhash64(*keys), *keys).limit(limit)


def by_keys(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")
