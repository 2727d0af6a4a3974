"""The transforms of a transfer: each rewrites a changelog, row by row, by Column expressions.

A transform says whether it suits a table (by name and schema, at plan time) and
gives the rows it passes and those it can't handle, with ``__transform_error``.
:data:`REGISTRY` has them by the names that transfer files use.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.changelog import DELETE, INSERT, META, ROW_KINDS, UPDATE, collapse, data_columns, old_value
from millrace.functions.text import crc_shard, go_template, hmac_sha256, text_form
from millrace.operators.predicate import Unsuitable, compile_filters
from millrace.operators.selectors import Selector
from millrace.schema import TableId, canonical_of, keys_of, with_keys

ERROR = "__transform_error"
REGISTRY: dict[str, type[Transform]] = {}


@dataclass
class Result:
    rows: DataFrame
    errors: DataFrame | None = None


def kind_of(df: DataFrame) -> Column:
    return F.col("_kind") if "_kind" in df.columns else F.lit(INSERT)


@dataclass(kw_only=True)
class Transform:
    tables: Selector = field(default_factory=Selector)

    def suits(self, table: TableId, schema: T.StructType) -> bool:
        return self.tables.table(table)

    def apply(self, df: DataFrame) -> Result:
        raise NotImplementedError


def register(name: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        REGISTRY[name] = dataclass(kw_only=True)(cls)
        return REGISTRY[name]

    return add


def split_errors(df: DataFrame, error: Column) -> Result:
    marked = df.withColumn(ERROR, error)
    return Result(marked.where(F.col(ERROR).isNull()).drop(ERROR), marked.where(F.col(ERROR).isNotNull()))


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The columns given replaced in place; metadata of the others stays."""
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def texts(df: DataFrame, columns: list[str]) -> list[Column]:
    return [text_form(F.col(f"`{c}`"), df.schema[c].dataType, canonical_of(df.schema[c]) == "any") for c in columns]


@register("filter_rows")
class FilterRows(Transform):
    """Keeps inserts that pass any of the filters.  Updates and deletes can't be judged by a part of a row: they are errors; control events pass."""

    filters: list = field(default_factory=list)
    filter: str = ""

    def __post_init__(self) -> None:
        if self.filter and self.filters:
            raise ValueError("give filter or filters, not both")
        self.filters = [self.filter] if self.filter else self.filters

    def suits(self, table: TableId, schema: T.StructType) -> bool:
        if not super().suits(table, schema):
            return False
        try:
            compile_filters(self.filters, schema)
        except Unsuitable:
            return False
        return True

    def apply(self, df: DataFrame) -> Result:
        passes, failed = compile_filters(self.filters, df.schema)
        if "_kind" not in df.columns:  # a plain table is all inserts: the filter reaches its scan
            return split_errors(df.where(passes | failed), F.when(failed, F.lit("unsupported type pair"))) if _may_fail(failed) else Result(df.where(passes))
        kind = kind_of(df)
        error = F.when(kind.isin(UPDATE, DELETE), F.concat(F.lit("filter_rows can't handle "), kind)).when((kind == INSERT) & failed, F.lit("unsupported type pair"))
        return split_errors(df.where((kind != INSERT) | passes | failed), error)


def _may_fail(failed: Column) -> bool:
    return "isnull" in str(failed).lower() or ">" in str(failed)


@register("filter_columns")
class FilterColumns(Transform):
    """Keeps the matching columns; a table whose key would lose a column is unsuitable."""

    columns: Selector = field(default_factory=Selector)

    def suits(self, table: TableId, schema: T.StructType) -> bool:
        keys, kept = keys_of(schema), self.columns.columns([n for n in schema.names if n not in META])
        return super().suits(table, schema) and bool(kept) and all(k in kept for k in keys)

    def apply(self, df: DataFrame) -> Result:
        kept = [c for c in df.columns if c in META or c in ("_present", "_old") or self.columns.matches(c)]
        out = df.select(*kept)
        if "_present" in kept:
            out = out.withColumn("_present", F.array_intersect("_present", F.array(*[F.lit(c) for c in kept])))
        if "_old" in kept:
            names = [f.name for f in df.schema["_old"].dataType if f.name in kept]
            out = out.withColumn("_old", F.when(F.col("_old").isNotNull(), F.struct(*[F.col(f"_old.{n}").alias(n) for n in names]))) if names else out.drop("_old")
        return Result(out)


@register("skip_events")
class SkipEvents(Transform):
    events: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> Result:
        return Result(df.where(~kind_of(df).isin(*self.events)) if self.events else df)


@register("filter_rows_by_ids")
class FilterRowsByIds(Transform):
    """Keeps rows where a chosen text column starts with one of the ids.

    Few ids are one disjunction; many are cut to prefixes of each length and met by semi-joins.
    Control events pass, however many ids there are.
    """

    columns: Selector = field(default_factory=Selector)
    ids: list[str] = field(default_factory=list)
    join_from: int = 200

    def apply(self, df: DataFrame) -> Result:
        names = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType)) and f.name not in META and self.columns.matches(f.name)]
        if not names or not self.ids:
            return Result(df.limit(0))
        values = [F.col(f"`{n}`").cast("string") for n in names]
        control = F.coalesce(~kind_of(df).isin(*ROW_KINDS), F.lit(False))
        if len(self.ids) < self.join_from:
            hit = F.lit(False)
            for v in values:
                for i in self.ids:
                    hit = hit | F.coalesce(v.startswith(i), F.lit(False))
            return Result(df.where(hit | control))
        lengths = sorted({len(i) for i in self.ids})
        ids = df.sparkSession.createDataFrame([(i,) for i in set(self.ids)], "__id string")
        prefixes = F.array(*[F.substring(v, 1, n) for v in values for n in lengths])
        keyed = df.where(~control).withColumn("__row", F.monotonically_increasing_id()).withColumn("__p", prefixes)
        hits = keyed.select("__row", F.explode("__p").alias("__id")).join(ids, "__id", "left_semi").select("__row").distinct()
        kept = keyed.join(hits, "__row", "left_semi").drop("__row", "__p")
        return Result(kept.unionByName(df.where(control)))


@register("mask_field")
class MaskField(Transform):
    """HMAC-SHA256 of the columns' text forms under the salt; the columns become text.  Null has a text, and so a hash."""

    columns: list[str] = field(default_factory=list)
    salt: str = ""

    def suits(self, table: TableId, schema: T.StructType) -> bool:
        return super().suits(table, schema) and any(c in schema.names for c in self.columns)

    def apply(self, df: DataFrame) -> Result:
        names = [c for c in self.columns if c in df.columns]
        return Result(replace_columns(df, {c: hmac_sha256(t, self.salt.encode()) for c, t in zip(names, texts(df, names), strict=True)}))


@register("convert_to_string")
class ConvertToString(Transform):
    columns: Selector = field(default_factory=Selector)
    to_bytes: bool = False

    def apply(self, df: DataFrame) -> Result:
        names = self.columns.columns(data_columns(df))
        return Result(replace_columns(df, {c: F.encode(t, "UTF-8") if self.to_bytes else t for c, t in zip(names, texts(df, names), strict=True)}))


@register("convert_to_datetime")
class ConvertToDatetime(Transform):
    """int32 and uint32 seconds to times; null is the epoch."""

    columns: Selector = field(default_factory=Selector)

    def suits(self, table: TableId, schema: T.StructType) -> bool:
        return super().suits(table, schema) and bool(self.columns.include or self.columns.exclude) and bool(self._names(schema))

    def _names(self, schema: T.StructType) -> list[str]:
        return [f.name for f in schema if f.name not in META and canonical_of(f) in ("int32", "uint32") and self.columns.matches(f.name)]

    def apply(self, df: DataFrame) -> Result:
        return Result(replace_columns(df, {c: F.timestamp_seconds(F.coalesce(F.col(c), F.lit(0))) for c in self._names(df.schema)}))


def _floats(value: object) -> object:
    if isinstance(value, dict):
        return {k: _floats(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_floats(v) for v in value]
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


@register("number_to_float_transformer")
class NumberToFloat(Transform):
    """Numbers at any depth of JSON columns as doubles.  JSON of unknown shape has no column form: Arrow batches."""

    columns: Selector = field(default_factory=Selector)

    def apply(self, df: DataFrame) -> Result:
        @F.pandas_udf("string")
        def floats(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else json.dumps(_floats(json.loads(v)), separators=(",", ":"), ensure_ascii=False))

        names = [f.name for f in df.schema if f.name not in META and canonical_of(f) == "any" and self.columns.matches(f.name)]
        changed = kind_of(df).isin(INSERT, UPDATE)
        return Result(replace_columns(df, {c: F.when(changed, floats(F.col(c))).otherwise(F.col(c)) for c in names}))


@register("regex_replace_transformer")
class RegexReplace(Transform):
    columns: Selector = field(default_factory=Selector)
    pattern: str = ""
    replacement: str = ""

    def apply(self, df: DataFrame) -> Result:
        new = {}
        for f in df.schema:
            if f.name in META or not self.columns.matches(f.name):
                continue
            if isinstance(f.dataType, T.StringType):
                new[f.name] = F.regexp_replace(f.name, self.pattern, go_template(self.replacement))
            elif isinstance(f.dataType, T.BinaryType):
                new[f.name] = F.encode(F.regexp_replace(F.decode(f.name, "UTF-8"), self.pattern, go_template(self.replacement)), "UTF-8")
        return Result(replace_columns(df, new))


@register("rename_tables")
class RenameTables(Transform):
    """{(namespace, name): (namespace, name)}"""

    renames: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> Result:
        schema, table = F.col("_schema"), F.col("_table")
        for (ns, name), (new_ns, new_name) in self.renames.items():
            here = (F.col("_schema") == ns) & (F.col("_table") == name)
            schema, table = F.when(here, F.lit(new_ns)).otherwise(schema), F.when(here, F.lit(new_name)).otherwise(table)
        return Result(replace_columns(df, {"_schema": schema, "_table": table}))


@register("replace_primary_key")
class ReplacePrimaryKey(Transform):
    """Other key columns, moved to the front; an update's old key becomes its present one."""

    keys: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(set(self.keys)) != len(self.keys):
            raise ValueError("a key column is named twice")

    def suits(self, table: TableId, schema: T.StructType) -> bool:
        return super().suits(table, schema) and all(k in schema.names for k in self.keys)

    def apply(self, df: DataFrame) -> Result:
        meta = [c for c in df.columns if c in META]
        rest = [c for c in df.columns if c not in meta and c not in self.keys]
        out = with_keys(df.select(*meta, *self.keys, *rest), self.keys)
        if "_old" in df.columns:
            now = F.struct(*[F.col(k).alias(k) for k in self.keys])
            before = F.struct(*[(F.col(f"_old.{k}") if k in df.schema["_old"].dataType.names else F.col(k)).alias(k) for k in self.keys])
            out = out.withColumn("_old", F.when(kind_of(df) == UPDATE, now).when(F.col("_old").isNotNull(), before))
        return Result(out)


@register("sharder_transformer")
class Sharder(Transform):
    """The part is the CRC-32 of the columns' text forms, modulo the number of shards."""

    columns: Selector = field(default_factory=Selector)
    shards: int = 1
    random: bool = False

    def apply(self, df: DataFrame) -> Result:
        names = self.columns.columns(data_columns(df))
        part = F.concat(F.uuid(), F.lit("_"), F.floor(F.rand() * self.shards).cast("string")) if self.random else crc_shard(texts(df, names), self.shards)
        return Result(df.withColumn("_part_id", part))


@register("table_splitter_transformer")
class TableSplitter(Transform):
    columns: list[str] = field(default_factory=list)
    splitter: str = "/"

    def apply(self, df: DataFrame) -> Result:
        names = [c for c in self.columns if c in df.columns]
        return Result(df.withColumn("_table", F.concat_ws(self.splitter, "_table", *texts(df, names))))


def _document(df: DataFrame, rest: str = "_rest") -> Column:
    """All columns as one JSON object; the map of unknown keys is laid open."""
    names = [c for c in data_columns(df) if c != rest]
    own = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    if rest not in df.columns:
        return own
    more = F.to_json(rest) if isinstance(df.schema[rest].dataType, T.MapType) else F.col(rest)
    inner = lambda s: s.substr(F.lit(2), F.length(s) - 2)
    joined = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inner(own), F.lit("")), F.nullif(inner(F.coalesce(more, F.lit("{}"))), F.lit(""))), F.lit("}"))
    return joined


def _commit_time(df: DataFrame) -> Column:
    return F.timestamp_micros((F.col("_commit_ts_ns") / 1000).cast("bigint"))


@register("raw_doc_grouper")
class RawDocGrouper(Transform):
    """Keys and chosen fields, the commit time as ``etl_updated_at``, and the whole row as ``doc``."""

    keys: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)

    def suits(self, table: TableId, schema: T.StructType) -> bool:
        return super().suits(table, schema) and all(c in schema.names for c in (*self.keys, *self.fields) if c not in ("etl_updated_at", "doc"))

    def apply(self, df: DataFrame) -> Result:
        named = [*self.keys, *[f for f in self.fields if f not in self.keys]]
        made = {"etl_updated_at": _commit_time(df), "doc": _document(df)}
        order = [*named, *[c for c in made if c not in named]]
        meta = [c for c in df.columns if c in META]
        return Result(with_keys(df.select(*meta, *[made[c].alias(c) if c in made else F.col(c) for c in order]), self.keys))


@register("raw_cdc_doc_grouper")
class RawCdcDocGrouper(Transform):
    """An append-only history: every row event is an insert with ``deleted_flg``; a delete takes its values from the old row."""

    keys: list[str] = field(default_factory=lambda: ["etl_updated_at"])
    fields: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> Result:
        rows = replace_columns(df, {c: F.when(F.col("_kind") == DELETE, old_value(df, c)).otherwise(F.col(c)) for c in data_columns(df)})
        keys = self.keys if "etl_updated_at" in self.keys else ["etl_updated_at", *self.keys]
        made = {"etl_updated_at": _commit_time(rows), "deleted_flg": F.col("_kind") == DELETE, "doc": _document(rows)}
        order = [*keys, *[c for c in (*self.fields, "deleted_flg", "doc") if c not in keys]]
        value = lambda c: made[c] if c in made else (F.col(c) if c in rows.columns else F.lit(None).cast("string"))
        meta = [F.when(F.col("_kind").isin(*ROW_KINDS), INSERT).otherwise(F.col("_kind")).alias("_kind") if c == "_kind" else F.col(c) for c in df.columns if c in META]
        return Result(with_keys(rows.select(*meta, *[value(c).alias(c) for c in order]), keys))


@register("jsonparser")
class JsonParser(Transform):
    """Rows of the blank form parsed by the generic parser."""

    parser: object = None

    def apply(self, df: DataFrame) -> Result:
        parsed = self.parser.parse(df.select(F.col("topic"), F.col("partition"), F.col("seq_no").alias("offset"), F.lit(None).cast("binary").alias("key"), F.col("raw_message").alias("value"), F.col("write_time").alias("timestamp")))
        return Result(parsed.rows, parsed.unparsed)


@register("sql")
class Sql(Transform):
    """Any SELECT over the view ``table``.

    A changelog is collapsed first, so the view has a row a key.  The result must expose the key;
    each output row takes its event's kind and order from the collapsed row with that key, and one
    without a match is an error.  Deletes keep their keys; control events pass beside the view.
    Aggregates see the whole table, not a batch of it.
    """

    query: str = ""
    keys: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> Result:
        keys = self.keys or keys_of(df.schema)
        meta = [c for c in df.columns if c in META]
        view = f"table_{abs(hash(self.query)) % 10**8}_{id(df) % 10**8}"
        if meta:
            df = collapse(df, keys, keep_plain_inserts=False)
        control = ~F.col("_kind").isin(*ROW_KINDS)
        live = df.where((F.col("_kind") != DELETE) & ~control) if meta else df
        live.select(*data_columns(df)).createOrReplaceTempView(view)
        if "{table}" in self.query:
            query = self.query.replace("{table}", view)
        else:  # a query that starts with WITH goes on from the view's own definition
            more = re.match(r"(?is)\s*WITH\s+(?!RECURSIVE\b)", self.query)
            query = f"WITH table AS (SELECT * FROM {view})" + (f", {self.query[more.end():]}" if more else f" {self.query}")
        out = df.sparkSession.sql(query)
        if not meta:
            return Result(out)
        if missing := [k for k in keys if k not in out.columns]:
            raise Unsuitable(f"the query does not give the key columns {missing}")
        origin = live.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*meta).alias("__meta"))
        met = out.join(origin, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left")
        back = met.select(*[F.col(f"__meta.{c}").alias(c) for c in meta], *out.columns, F.col("__meta").isNotNull().alias("__found"))
        gone = df.where((F.col("_kind") == DELETE) | control).select(*meta, *[old_value(df, c).alias(c) if c in keys else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns])
        errors = back.where(~F.col("__found")).drop("__found").withColumn(ERROR, F.lit("no input row has this key"))
        return Result(back.where("__found").drop("__found").unionByName(gone), errors)


@register("dbt")
class SqlModels(Transform):
    """Models run in order after a load, each over the tables and models before it; the first failure ends it."""

    models: list[tuple[str, str]] = field(default_factory=list)

    def apply(self, df: DataFrame) -> Result:
        df.createOrReplaceTempView("source")
        out = df
        for name, query in self.models:
            out = df.sparkSession.sql(query)
            out.createOrReplaceTempView(name)
        return Result(out)


@register("lambda")
class Lambda(Transform):
    """A user's function from pandas batch to pandas batch; it may split or drop rows."""

    function: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    schema: str = ""

    def apply(self, df: DataFrame) -> Result:
        function = self.function

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield function(batch)

        return Result(df.mapInPandas(run, self.schema or df.schema))


@register("batch_splitter")
class BatchSplitter(Transform):
    """Bounds what a task writes at once; rows are as they were."""

    max_items: int = 10_000

    def apply(self, df: DataFrame) -> Result:
        return Result(df)

    def writer_options(self) -> dict[str, str]:
        return {"maxRecordsPerFile": str(self.max_items)}


@register("logger")
class Logger(Transform):
    """Counts rows as they pass; the numbers are on the listener's ``observedMetrics``."""

    name: str = "rows"

    def apply(self, df: DataFrame) -> Result:
        return Result(df.observe(self.name, F.count(F.lit(1)).alias("rows")))


@register("problem_item_detector")
class ProblemItemDetector(Transform):
    """Rows for which a check fails are errors, named one by one."""

    check: str = "true"

    def apply(self, df: DataFrame) -> Result:
        return split_errors(df, F.when(~F.coalesce(F.expr(self.check), F.lit(False)), F.lit(f"fails {self.check}")))


@register("mongo_pk_extender")
class MongoKeyExtender(Transform):
    """``_id`` becomes {field: discriminator, _id}, or, with ``expand`` off, the plain ``_id`` again."""

    expand: bool = True
    discriminator_field: str = "shard"
    discriminators: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> Result:
        if not self.expand:
            return Result(df.withColumn("_id", F.col("_id._id")))
        value = F.lit(None).cast("string")
        for schema, v in self.discriminators.items():
            value = F.when(F.col("_schema") == schema, F.lit(v)).otherwise(value)
        return Result(df.withColumn("__d", value).where("__d IS NOT NULL").withColumn("_id", F.struct(F.col("__d").alias(self.discriminator_field), F.col("_id"))).drop("__d"))


@register("yt_dict")
class Composites(Transform):
    """Dictionaries that came as arrays of (key, value) as objects; arrays of plain values and other columns are left alone."""

    columns: Selector = field(default_factory=Selector)

    def apply(self, df: DataFrame) -> Result:
        new = {}
        for f in df.schema:
            if self.columns.matches(f.name) and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and len(f.dataType.elementType) == 2:
                new[f.name] = F.to_json(F.map_from_entries(f.name))
            elif self.columns.matches(f.name) and isinstance(f.dataType, (T.StructType, T.MapType)) and f.name != "_old":
                new[f.name] = F.to_json(f.name)
        return Result(replace_columns(df, new))


@register("filter_strm_access_log")
class FilterAccessLog(Transform):
    """Inserts of users' traffic in the given tiers."""

    traffic_type: str = "users"
    tiers: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> Result:
        wanted = (F.col("traffic_type") == self.traffic_type) & F.col("tier").isin(*self.tiers)
        return Result(df.where((kind_of(df) == INSERT) & wanted))


