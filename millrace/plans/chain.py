"""A chain of transforms over one table, with what they could not handle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.transforms import ERROR, REGISTRY, Transform
from millrace.schema import TableId


def build(configs: list[dict]) -> list[Transform]:
    """Transforms from one-key mappings {name: settings}, in order."""
    out = []
    for config in configs:
        (name, settings), *more = config.items()
        if more:
            raise ValueError(f"a transform is one key with its settings: {config}")
        if name not in REGISTRY:
            raise ValueError(f"no transform is named {name}; there are {sorted(REGISTRY)}")
        out.append(REGISTRY[name](**settings))
    return out


@dataclass
class ChainResult:
    rows: DataFrame
    errors: list[DataFrame]

    def errors_frame(self) -> DataFrame | None:
        """Errors of all steps as (error, row as JSON); their schemas may differ from step to step."""
        if not self.errors:
            return None
        frames = [e.select(F.col(ERROR).alias("error"), F.to_json(F.struct(*[c for c in e.columns if c != ERROR])).alias("row")) for e in self.errors]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def run_chain(df: DataFrame, table: TableId, transforms: list[Transform]) -> ChainResult:
    """Each suitable transform in turn; one that does not suit the table as it has become is passed over."""
    errors = []
    for t in transforms:
        if not t.suits(table, df.schema):
            continue
        result = t.apply(df)
        df = result.rows
        if result.errors is not None:
            errors.append(result.errors)
    return ChainResult(df, errors)
