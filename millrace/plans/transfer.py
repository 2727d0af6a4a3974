"""Whole transfers: tables read, transformed and written, once or table by table."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.changelog import as_changelog
from millrace.plans.chain import ChainResult, build, run_chain
from millrace.schema import TableId, keys_of


@dataclass
class Table:
    """A source table: how to read it, and a condition on its rows."""

    id: TableId
    read: Callable[[SparkSession], DataFrame]
    where: str = ""


@dataclass
class Transfer:
    tables: list[Table]
    transforms: list[dict] = field(default_factory=list)
    errors: str = "devnull"  # or "sink"
    snapshot_only: bool = True

    @staticmethod
    def from_text(text: str, tables: list[Table]) -> Transfer:
        """Settings as JSON, with ${NAME} taken from the environment; unknown keys are refused."""
        raw = json.loads(re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], text))
        if unknown := set(raw) - {"transforms", "errors", "snapshot_only"}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return Transfer(tables, **raw)

    def plan(self, spark: SparkSession, changelog: bool = True) -> dict[TableId, ChainResult]:
        """The chain over every table, not yet run."""
        transforms, out = build(self.transforms), {}
        for t in self.tables:
            df = t.read(spark)
            if t.where:
                df = df.where(t.where)
            if not self.snapshot_only and not keys_of(df.schema):
                raise ValueError(f"{t.id.quoted()} has no primary key, which replication needs")
            out[t.id] = run_chain(as_changelog(df, t.id.namespace, t.id.name) if changelog else df, t.id, transforms)
        return out

    def activate(self, spark: SparkSession, write: Callable[[TableId, DataFrame], None]) -> None:
        """Write every table's rows, and its errors to ``<table>_errors`` where they go to the sink."""
        for table, result in self.plan(spark).items():
            write(table, result.rows)
            if self.errors == "sink" and (errors := result.errors_frame()) is not None:
                write(TableId(table.namespace, f"{table.name}_errors"), errors.withColumn("table", F.lit(table.quoted())))
