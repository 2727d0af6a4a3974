"""Change events as rows.

A changelog has the table's own columns and these: ``_kind`` (insert, update, delete,
or a control kind), ``_lsn`` and ``_counter`` (order), ``_tx_id``, ``_commit_ts_ns``,
``_schema``, ``_table``, ``_part_id``, ``_present`` (the columns an event carries; null: all) and
``_old`` (the key, or the whole row, before an update or delete; null: as now).
A column that is not present keeps its earlier value, which null does not say.

Everything that acts a key at a time is one ``groupBy`` with aggregates that combine on
the map side, so an often changed key is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META: dict[str, str] = {
    "_tx_id": "bigint", "_lsn": "bigint", "_commit_ts_ns": "bigint", "_counter": "int", "_kind": "string",
    "_schema": "string", "_table": "string", "_part_id": "string",
}
INSERT, UPDATE, DELETE = "insert", "update", "delete"
ROW_KINDS = [INSERT, UPDATE, DELETE, "mongo:update_document"]


def order() -> Column:
    """What changes of a key are ordered by."""
    return F.struct("_lsn", "_counter")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META and c not in ("_present", "_old")]


def as_changelog(df: DataFrame, namespace: str, table: str, commit_ns: Column | None = None) -> DataFrame:
    """A snapshot's rows as inserts."""
    values = {"_tx_id": F.lit(0), "_lsn": F.lit(0), "_commit_ts_ns": F.lit(0) if commit_ns is None else commit_ns, "_counter": F.lit(0), "_kind": F.lit(INSERT), "_schema": F.lit(namespace), "_table": F.lit(table), "_part_id": F.lit("")}
    return df.select(*[values[c].cast(t).alias(c) for c, t in META.items()], *df.columns)


def present(df: DataFrame, column: str) -> Column:
    """Whether an event carries the column."""
    if "_present" not in df.columns:
        return F.col("_kind") != DELETE
    return (F.col("_kind") != DELETE) & (F.col("_present").isNull() | F.array_contains("_present", column))


def old_value(df: DataFrame, column: str) -> Column:
    """The column before the event: from ``_old`` where that has it, else as it is now."""
    if "_old" in df.columns and column in [f.name for f in df.schema["_old"].dataType]:
        return F.when(F.col("_kind").isin(UPDATE, DELETE) & F.col("_old").isNotNull(), F.col(f"_old.{column}")).otherwise(F.col(column))
    return F.col(column)


def key_string(df: DataFrame, keys: list[str], old: bool = True) -> Column:
    """JSON array of the key's values in the order of their names; the old key for updates and deletes."""
    values = [old_value(df, k) if old else F.col(k) for k in sorted(keys)]
    texts = [F.coalesce(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2), F.lit("null")) for v in values]
    return F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]"))


def keys_changed(df: DataFrame, keys: list[str]) -> Column:
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~old_value(df, k).eqNullSafe(F.col(k))
    return (F.col("_kind") == UPDATE) & changed


def is_partial(df: DataFrame) -> Column:
    """Updates that carry fewer columns than the table has."""
    if "_present" not in df.columns:
        return F.lit(False)
    return (F.col("_kind") == UPDATE) & F.col("_present").isNotNull() & (F.size("_present") < len(data_columns(df)))


def split_key_updates(df: DataFrame, keys: list[str]) -> DataFrame:
    """An update that changes the key becomes the old key's delete, then an insert with the counter one higher."""
    if "_old" not in df.columns:
        return df
    moved = df.withColumn("__moved", keys_changed(df, keys))
    steps = F.when(F.col("__moved"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1)))
    moved = moved.withColumn("__step", F.explode(steps))
    out = []
    for c in df.columns:
        v = F.col(c)
        if c == "_kind":
            v = F.when(F.col("__step") == 0, DELETE).when(F.col("__step") == 1, INSERT).otherwise(v)
        elif c == "_counter":
            v = F.when(F.col("__step") == 1, v + 1).otherwise(v)
        elif c == "_old":
            v = F.when(F.col("__step") != 1, v)
        elif c in keys:
            v = F.when(F.col("__step") == 0, old_value(df, c)).otherwise(v)
        elif c == "_present":
            v = F.when(F.col("__step") == -1, v)
        elif c not in META:
            v = F.when(F.col("__step") != 0, v)
        out.append(v.alias(c))
    return moved.select(*out)


def inserts_only(df: DataFrame) -> bool:
    return df.where(F.col("_kind").isin(*ROW_KINDS) & (F.col("_kind") != INSERT)).isEmpty()


def collapse(df: DataFrame, keys: list[str], keep_plain_inserts: bool = True) -> DataFrame:
    """At most one event a key: what all of a key's events together do.

    A batch of inserts alone is returned as it is, duplicates and all.  A key whose
    last event is a delete gives that delete, even if the batch inserted the row.
    Otherwise the columns present since the last insert or delete are merged, each
    with its last value; the kind is insert if the row was inserted in the batch.
    Key-changing updates are taken apart first.  Control events pass through.
    """
    if not keys or (keep_plain_inserts and inserts_only(df)):
        return df
    rows = split_key_updates(df, keys).where(F.col("_kind").isin(*ROW_KINDS))
    values = [c for c in data_columns(df) if c not in keys]
    meta = [c for c in META if c in df.columns and c != "_kind"]
    at = order()
    resets = F.when(F.col("_kind").isin(INSERT, DELETE), F.struct(at.alias("at"), F.col("_kind").alias("kind")))
    last = lambda c: F.max(F.when(present(rows, c), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(c)
    named = [old_value(rows, k).alias(k) for k in keys]
    rows = rows.select(*[c for c in rows.columns if c not in keys], *named)
    aggs = [F.max(F.struct(at.alias("at"), *meta, F.col("_kind").alias("kind"))).alias("__last"), F.max(resets).alias("__reset"), *[last(c) for c in values if _orderable(df.schema[c].dataType)]]
    aggs += [F.max_by(F.struct(at.alias("at"), F.col(c).alias("v")), F.when(present(rows, c), at)).alias(c) for c in values if not _orderable(df.schema[c].dataType)]
    one = rows.groupBy(*keys).agg(*aggs)
    kind = F.when(F.col("__last.kind") == DELETE, DELETE).when(F.col("__reset.kind") == INSERT, INSERT).otherwise(UPDATE)
    one = one.withColumn("__kind", kind)
    since = lambda c: F.col(c).isNotNull() & (F.col("__reset").isNull() | (F.col(f"{c}.at") >= F.col("__reset.at"))) & (F.col("__kind") != DELETE)
    carried = F.filter(F.array(*[F.lit(k) for k in keys], *[F.when(since(c), F.lit(c)) for c in values]), lambda x: x.isNotNull())
    out = []
    for c in df.columns:
        if c == "_kind":
            v = F.col("__kind")
        elif c in meta:
            v = F.col(f"__last.{c}")
        elif c == "_present":
            v = F.when(F.col("__kind") == UPDATE, carried)
        elif c == "_old":
            v = F.lit(None).cast(df.schema[c].dataType)
        elif c in keys:
            v = F.col(c)
        else:
            v = F.when(since(c), F.col(f"{c}.v"))
        out.append(v.alias(c))
    control = df.where(~F.col("_kind").isin(*ROW_KINDS))
    return control.unionByName(one.select(*out))


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def apply_changes(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: upserts merged column by column, deleted keys gone.

    One full outer join on the key; a partial update of an absent row inserts what it carries.
    """
    net = collapse(changes, keys, keep_plain_inserts=False).where(F.col("_kind").isin(*ROW_KINDS))
    has = {c: present(net, c) for c in data_columns(net)}
    marked = net.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("_kind").alias("__kind"), *[F.struct(has[c].alias("there"), F.col(c).alias("v")).alias(f"__n_{c}") for c in current.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    both = current.join(marked, same, "full_outer").where(F.col("__kind").isNull() | (F.col("__kind") != DELETE))
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.coalesce(c, f"__k_{c}").alias(c))
        else:
            n = F.col(f"__n_{c}")
            out.append(F.when(F.col("__kind").isNull() | ((F.col("__kind") == UPDATE) & ~n["there"]), F.col(c)).otherwise(n["v"]).alias(c))
    return both.select(*out)


def latest_wins(df: DataFrame, keys: list[str], version: str = "_commit_ts_ns", deleted: str | None = None) -> DataFrame:
    """Of each key the row with the largest version (ties: the largest order); rows whose ``deleted`` column is not 0 go."""
    rank = F.struct(version, *[c for c in ("_lsn", "_counter") if c in df.columns and c != version])
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), rank).alias("r")).select(*keys, "r.*").select(*df.columns)
    if deleted:
        one = one.where(F.coalesce(F.col(deleted), F.lit(0)) == 0)
    return one


def versioned_upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(the table after, the rows skipped with ``__stored_version``): only strictly newer versions are taken, deletes never."""
    if "_kind" in incoming.columns:
        incoming = incoming.where(F.col("_kind") != DELETE).select(*current.columns)
    stored = current.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(version).alias("__stored_version"))
    met = incoming.join(stored, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left").drop(*[f"__k_{k}" for k in keys])
    newer = F.col("__stored_version").isNull() | (F.col(version) > F.col("__stored_version"))
    taken = latest_wins(met.where(newer).drop("__stored_version"), keys, version)
    kept = current.join(taken.select(*keys), keys, "left_anti")
    return kept.unionByName(taken), met.where(~newer)


def fill_partial(changes: DataFrame, current: DataFrame, keys: list[str], upsert_absent: bool = False) -> DataFrame:
    """Partial updates completed from the stored rows; one without a stored row fails, or passes with ``upsert_absent``."""
    values = [c for c in current.columns if c not in keys]
    stored = current.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*values).alias("__stored"))
    met = changes.join(stored, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left")
    partial = is_partial(changes)
    missing = partial & F.col("__stored").isNull()
    fail = F.raise_error(F.concat(F.lit("no stored row for a partial update of key "), F.to_json(F.struct(*keys))))
    out = []
    for c in changes.columns:
        if c in values:
            filled = F.when(partial & ~present(changes, c), F.col(f"__stored.{c}")).otherwise(F.col(c))
            out.append((filled if upsert_absent else F.when(missing, fail.cast(changes.schema[c].dataType)).otherwise(filled)).alias(c))
        elif c == "_present":
            out.append(F.when(partial & F.col("__stored").isNotNull(), F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return met.select(*out)


def chunk_merge(chunk: DataFrame, log: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """A chunk of a running snapshot: rows whose key the log changed between the two watermarks give way to the log's events."""
    between = log.where((F.col("_lsn") > low) & (F.col("_lsn") <= high))
    touched = between.select(*[old_value(between, k).alias(k) for k in keys]).unionByName(between.select(*keys)).distinct()
    rest = as_changelog(chunk.join(touched, keys, "left_anti").select(*chunk.columns), "", "").withColumn("_lsn", F.lit(high).cast("bigint"))
    kept = [*rest.columns, *[c for c in ("_present", "_old") if c in log.columns]]  # what a partial update carries, and its key before
    return rest.unionByName(between.select(*kept), allowMissingColumns=True)


def transactions(df: DataFrame) -> DataFrame:
    """One row a transaction: its first and last place and its events."""
    return df.groupBy("_tx_id").agg(F.min(order()).alias("first"), F.max(order()).alias("last"), F.count("*").alias("events"))
