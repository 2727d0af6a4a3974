"""Keyed tables kept as Parquet directories, one a version.

Plain files have no MERGE: a new state is written beside the old one and the
name that readers follow is a one-row pointer table, replaced last.  A run that
dies leaves the old state; repeating it gives the same new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.changelog import DELETE, apply_changes, data_columns, keys_changed, latest_wins, old_value, versioned_upsert


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _fs(self):
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version, -1 before the first."""
        pointer = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current")
        return self.spark.read.schema("version int").json(f"{self.path}/_current").first()[0] if self._fs().exists(pointer) else -1

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}")

    def replace(self, df: DataFrame, batch: str = "") -> int:
        """Write a state and point to it."""
        new = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        self.spark.range(1).select(F.lit(new).alias("version"), F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").json(f"{self.path}/_current")
        return new

    def last_batch(self) -> str:
        return self.spark.read.schema("batch string").json(f"{self.path}/_current").first()[0] if self.version() >= 0 else ""

    def upsert(self, changes: DataFrame, batch: str = "") -> None:
        """Apply a changelog; a batch that was the last one applied is not applied again."""
        if batch and batch == self.last_batch():
            return
        if self.version() < 0:
            self.replace(changes.limit(0).select(*data_columns(changes)))
        self.replace(apply_changes(self.read(), changes, self.keys), batch)

    def upsert_versioned(self, incoming: DataFrame, version: str) -> DataFrame:
        """Take strictly newer rows; the others are returned for ``<table>_skipped``."""
        taken, skipped = versioned_upsert(self.read(), incoming, self.keys, version)
        self.replace(taken)
        return skipped


CLEANUP: dict[str, Callable[[SparkSession, str], None]] = {
    "drop": lambda spark, table: spark.sql(f"DROP TABLE IF EXISTS {table}"),
    "truncate": lambda spark, table: spark.sql(f"TRUNCATE TABLE {table}"),
    "disabled": lambda spark, table: None,
}


def versioned_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Changes as rows of an append-only table with commit and delete times; a change of key is a deletion and an insertion."""
    columns = data_columns(df)
    ct = F.col("_commit_ts_ns").alias("__data_transfer_commit_time")
    gone = (F.col("_kind") == DELETE) | keys_changed(df, keys)
    dead = df.where(gone).select(*[old_value(df, c).alias(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns], ct, F.col("_commit_ts_ns").alias("__data_transfer_delete_time"))
    live = df.where(F.col("_kind") != DELETE).select(*columns, ct, F.lit(0).cast("bigint").alias("__data_transfer_delete_time"))
    return dead.unionByName(live)


def current_rows(history: DataFrame, keys: list[str]) -> DataFrame:
    """What a reader of such a table sees."""
    return latest_wins(history, keys, "__data_transfer_commit_time", "__data_transfer_delete_time").drop("__data_transfer_commit_time", "__data_transfer_delete_time")


def append_only_guard(df: DataFrame) -> DataFrame:
    """Fails on updates and deletes, for targets that can only append."""
    return df.withColumn("_kind", F.when(F.col("_kind").isin("update", "delete"), F.raise_error(F.concat(F.lit("target is append-only, got "), F.col("_kind")))).otherwise(F.col("_kind")))


def after_offset(messages: DataFrame, written: DataFrame) -> DataFrame:
    """Messages beyond what a log table holds of their partition."""
    done = written.groupBy("topic", "partition").agg(F.max("offset").alias("__done"))
    return messages.join(done, ["topic", "partition"], "left").where(F.col("__done").isNull() | (F.col("offset") > F.col("__done"))).drop("__done")


def index_rows(df: DataFrame, index: str, keys: list[str]) -> DataFrame:
    """A secondary index: the indexed column, then the key."""
    return df.select(index, *keys)
