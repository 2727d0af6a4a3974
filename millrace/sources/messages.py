"""Raw queue messages as a DataFrame, and the parsers that make rows of them.

A message frame has topic, partition, offset, key, value (binary), timestamp and,
optionally, headers.  A parser gives the rows, and what it could not parse as rows
of a side table; nothing bad stops a transfer.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import table_name, unescape_tskv
from millrace.schema import RANGES, SPARK_TYPES, try_strictify
from millrace.sinks.serialize import ConnectForms, decimal_of_bytes

UNPARSED = ["_timestamp", "_partition", "_offset", "_idx", "unparsed_row", "reason"]
#: Layouts that times are read by, the first that fits.
LAYOUTS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd", "dd/MMM/yyyy:HH:mm:ss Z"]


@dataclass
class Parsed:
    rows: DataFrame
    unparsed: DataFrame


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "utf8"
    key: bool = False
    required: bool = False
    path: str = ""


def as_messages(df: DataFrame, topic: str, value: Column, key: Column | None = None) -> DataFrame:
    """Rows of a table as messages of one topic and partition."""
    return df.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), (F.lit(None) if key is None else key).cast("binary").alias("key"), value.cast("binary").alias("value"), F.current_timestamp().alias("timestamp"))


def read_time(text: Column, layouts: list[str] | None = None) -> Column:
    """A number of seconds (with a fraction), or one of the layouts."""
    number = text.try_cast("double")
    found = [F.try_to_timestamp(text, F.lit(x)) for x in layouts or LAYOUTS]
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_micros((number * 1e6).cast("bigint"))), *found)


def lookup(json_text: Column, path: str) -> Column:
    """A value at a path cut by dots or slashes; a value that is JSON text is looked into as well."""
    parts = [p for p in path.replace("/", ".").split(".") if p]
    direct = F.get_json_object(json_text, "$" + "".join(f"['{p}']" for p in parts))
    if len(parts) < 2:
        return direct
    step = json_text
    for p in parts:
        step = F.get_json_object(step, f"$['{p}']")
    return F.coalesce(direct, step)


@dataclass
class GenericParser:
    """Lines of JSON or TSKV to typed columns.

    Every message is cut at line ends, empty lines are skipped, and lines numbered
    from 1.  Columns: the fields; ``_timestamp``, ``_partition``, ``_offset`` and ``_idx`` if
    ``aux``; unknown keys as the map ``_rest`` if ``rest``.  A line that is no
    JSON, lacks a key or required field or has a value of another type there is unparsed.
    """

    fields: list[FieldSpec]
    format: str = "json"
    rest: bool = False
    aux: bool = True
    null_keys: bool = False
    unescape: bool = False
    base64_bytes: bool = False
    time_field: str = ""
    layouts: list[str] = field(default_factory=list)
    topic_column: bool = False
    table_columns: list[str] = field(default_factory=list)

    def _coerce(self, text: Column, spec: FieldSpec) -> Column:
        if spec.type in ("datetime", "timestamp"):
            return read_time(text, self.layouts or None)
        if spec.type == "date":
            return F.to_date(read_time(text, self.layouts or None))
        if spec.type == "string":
            return F.unbase64(text) if self.base64_bytes else F.encode(text, "UTF-8")
        if spec.type in ("utf8", "any"):
            return text
        if spec.type in RANGES:
            return try_strictify(text, spec.type)
        return text.try_cast(SPARK_TYPES[spec.type])

    def lines(self, messages: DataFrame) -> DataFrame:
        text = F.decode(F.col("value"), "UTF-8")
        cut = messages.select(F.col("timestamp").alias("_timestamp"), F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"), F.posexplode(F.filter(F.split(text, r"\r?\n"), lambda s: s != "")).alias("_idx", "line"))
        return cut.withColumn("_idx", (F.col("_idx") + 1).cast("int"))

    def parse(self, messages: DataFrame) -> Parsed:
        rows = self.lines(messages)
        if self.format == "json":
            valid = F.try_parse_json("line").isNotNull() & F.ltrim("line").startswith("{")
            rows = rows.withColumn("__ok", valid)
            if self.rest:
                rows = rows.withColumn("__all", F.from_json("line", "map<string,string>"))
            raw = {f.name: lookup(F.col("line"), f.path or f.name) for f in self.fields}
        else:
            pairs = F.filter(F.transform(F.split("line", "\t"), lambda p: F.split(p, "=", 2)), lambda p: F.size(p) == 2)
            entries = F.transform(pairs, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))
            rows = rows.withColumn("__all", F.map_from_entries(F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda s, e: F.when(F.exists(s, lambda x: x["key"] == e["key"]), s).otherwise(F.array_append(s, e)))))
            rows = rows.withColumn("__ok", F.size("__all") > 0)
            value = lambda f: F.coalesce(F.col("__all")[f.path or f.name], lookup(F.col("__all")[(f.path or f.name).replace("/", ".").split(".")[0]], ".".join((f.path or f.name).replace("/", ".").split(".")[1:])) if "." in (f.path or f.name).replace("/", ".") else F.lit(None))
            raw = {f.name: unescape_tskv(value(f)) if self.unescape else value(f) for f in self.fields}
        for f in self.fields:
            rows = rows.withColumn(f"__raw_{f.name}", raw[f.name]).withColumn(f.name, self._coerce(F.col(f"__raw_{f.name}"), f))
        reason = F.when(~F.coalesce("__ok", F.lit(False)), F.lit("not a valid line"))
        for f in self.fields:
            if f.required or (f.key and not self.null_keys):
                reason = reason.when(F.col(f"__raw_{f.name}").isNull(), F.lit(f"no value for {f.name}"))
            if f.required or f.key:
                reason = reason.when(F.col(f"__raw_{f.name}").isNotNull() & F.col(f.name).isNull(), F.lit(f"{f.name} is no {f.type}"))
        rows = rows.withColumn("__reason", reason)
        if self.time_field:
            rows = rows.withColumn("_timestamp", F.coalesce(read_time(F.col(f"__raw_{self.time_field}"), self.layouts or None), "_timestamp"))
        names = [f.name for f in self.fields]
        out = [F.col(f.name).alias(f.name, metadata={"canonical": f.type, **({"key": True} if f.key else {})}) for f in self.fields]
        if self.aux:
            user_keys = any(f.key for f in self.fields)
            out += [F.col(c).alias(c if c not in names else f"_delivery_{c}", metadata={} if user_keys else {"key": True}) for c in ("_timestamp", "_partition", "_offset", "_idx")]
        if self.topic_column:
            out.append(F.col("_topic"))
        if self.rest:
            known = F.array(*[F.lit((f.path or f.name).split(".")[0]) for f in self.fields])
            out.append(F.map_filter("__all", lambda k, v: ~F.array_contains(known, k)).alias("_rest"))
        if self.table_columns:
            out.append(F.concat_ws("/", *[F.col(c).cast("string") for c in self.table_columns]).alias("_table"))
        bad = rows.where("__reason IS NOT NULL").select("_timestamp", "_partition", "_offset", "_idx", F.col("line").alias("unparsed_row"), F.col("__reason").alias("reason"))
        return Parsed(rows.where("__reason IS NULL").select(*out), bad)


def target_table(topic: Column) -> Column:
    return table_name(topic)


@dataclass
class RawToTable:
    """Messages as rows: key and value as bytes, text or JSON; what is not valid goes to the side table with its reasons."""

    key: bool = True
    key_type: str = "string"  # bytes, string or json
    value_type: str = "json"
    with_timestamp: bool = False
    with_headers: bool = False

    @staticmethod
    def _check(name: str, kind: str, c: Column) -> Column:
        if kind == "string":
            return F.when(c.isNotNull() & ~F.is_valid_utf8(c.cast("string")), F.lit(f"{name} is configured as string, but it isn't valid UTF-8"))
        if kind == "json":
            return F.when(c.isNotNull() & F.try_parse_json(c.cast("string")).isNull(), F.lit(f"{name} is configured as JSON, but it isn't valid JSON"))
        return F.lit(None).cast("string")

    def parse(self, messages: DataFrame) -> Parsed:
        checks = ([self._check("key", self.key_type, F.col("key"))] if self.key else []) + [self._check("value", self.value_type, F.col("value"))]
        rows = messages.withColumn("failure_reason", F.concat_ws("|", *checks))
        shown = lambda c, kind: F.col(c) if kind == "bytes" else F.col(c).cast("string").alias(c)
        key = {"metadata": {"key": True}}
        out = [F.col(c).alias(c, **key) for c in ("topic", "partition", "offset")]
        out += [F.col("timestamp")] * self.with_timestamp + ([F.col("headers")] if self.with_headers else [])
        out += ([shown("key", self.key_type)] if self.key else []) + [shown("value", self.value_type)]
        bad = rows.where("failure_reason != ''").select("topic", "partition", "offset", "timestamp", "key", "value", "failure_reason")
        return Parsed(rows.where("failure_reason = ''").select(*out), bad)


@dataclass
class Blank:
    """The raw form: what a queue says of a message, and its bytes."""

    def parse(self, messages: DataFrame) -> Parsed:
        rows = messages.select("partition", "topic", F.col("offset").alias("seq_no"), F.col("timestamp").alias("write_time"), F.col("value").alias("raw_message"))
        return Parsed(rows, messages.limit(0))


@dataclass
class Native:
    """Change events as JSON, as :func:`millrace.sinks.serialize.native` writes them."""

    schema: T.StructType

    def parse(self, messages: DataFrame) -> Parsed:
        got = messages.withColumn("__e", F.from_json(F.col("value").cast("string"), self.schema))
        bad = F.col("__e._kind").isNull()
        return Parsed(got.where(~bad).select("__e.*"), got.where(bad).select("topic", "partition", "offset", F.col("value").cast("string").alias("unparsed_row")))


@dataclass
class Debezium:
    """Envelopes of ``before``, ``after``, ``op`` and ``ts_ms``, with or without their schema, to a changelog.

    c and r are inserts, u an update, d a delete with the values of ``before``; a
    message without a value is the tombstone of the delete before it and is left out.
    ``forms``: how the sender shows types that JSON has not, for envelopes with a schema block.
    """

    schema: T.StructType
    keys: list[str] = field(default_factory=list)

    forms: ConnectForms | None = None

    def _value(self, c: Column, kind: T.DataType) -> Column:
        """A value as ``forms`` shows it, as its type again."""
        if isinstance(kind, T.DecimalType):
            return decimal_of_bytes(c, kind) if self.forms.decimals == "precise" else c.cast(kind)
        if isinstance(kind, T.DateType):
            return F.date_from_unix_date(c.cast("int"))
        if isinstance(kind, T.TimestampNTZType):
            micros = c.cast("bigint") * (1 if self.forms.times == "adaptive" else 1000)
            return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
        if isinstance(kind, T.DayTimeIntervalType):
            return F.make_dt_interval(secs=(c.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
        if isinstance(kind, T.BinaryType):
            return F.unbase64(c) if self.forms.binary == "bytes" else F.unhex(c)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.from_json(c, kind)
        return c.cast(kind)

    def parse(self, messages: DataFrame) -> Parsed:
        row = T.StructType([T.StructField(f.name, T.StringType()) for f in self.schema]) if self.forms else self.schema  # by form: read as text first
        place = T.StructType().add("lsn", T.LongType()).add("txId", T.LongType()).add("schema", T.StringType()).add("table", T.StringType())
        envelope = T.StructType().add("before", row).add("after", row).add("source", place).add("op", T.StringType()).add("ts_ms", T.LongType())
        text = F.col("value").cast("string")
        body = F.coalesce(F.get_json_object(text, "$.payload"), text)
        got = messages.where("value IS NOT NULL").withColumn("__e", F.from_json(body, envelope))
        if self.forms:
            typed = lambda side: F.when(F.col(f"__e.{side}").isNotNull(), F.struct(*[self._value(F.col(f"__e.{side}.`{f.name}`"), f.dataType).alias(f.name) for f in self.schema]))
            got = got.withColumn("__e", F.col("__e").withField("before", typed("before")).withField("after", typed("after")))
        kind = F.when(F.col("__e.op").isin("c", "r"), "insert").when(F.col("__e.op") == "u", "update").when(F.col("__e.op") == "d", "delete")
        got = got.withColumn("__kind", kind)
        value = lambda c: F.when(F.col("__kind") == "delete", F.col(f"__e.before.`{c}`")).otherwise(F.col(f"__e.after.`{c}`"))
        meta = {"_tx_id": F.col("__e.source.txId"), "_lsn": F.coalesce("__e.source.lsn", "offset").cast("bigint"), "_commit_ts_ns": F.col("__e.ts_ms") * 1_000_000, "_counter": F.lit(0), "_kind": F.col("__kind"), "_schema": F.col("__e.source.schema"), "_table": F.col("__e.source.table"), "_part_id": F.lit("")}
        old = F.when(F.col("__kind").isin("update", "delete"), F.col("__e.before")).alias("_old")
        columns = [value(f.name).alias(f.name, metadata={"key": True} if f.name in self.keys else f.metadata) for f in self.schema]
        good = got.where("__kind IS NOT NULL").select(*[v.alias(k) for k, v in meta.items()], *columns, old)
        bad = got.where("__kind IS NULL").select("topic", "partition", "offset", text.alias("unparsed_row"), F.lit("no envelope with a known op").alias("reason"))
        return Parsed(good, bad)


@dataclass
class SchemaRegistryJson:
    """A zero byte, the schema's number as four bytes, then JSON; ``schemas`` maps numbers to Spark schemas.

    The frames of messages without such a head or of an unknown schema, and of bodies that are no JSON object, are unparsed,
    with their bytes; each is in the side table once: of its schema's number, or of None.
    """

    schemas: dict[int, str]

    def parse(self, messages: DataFrame) -> dict[int | None, Parsed]:
        head = F.hex(F.substring("value", 1, 5))
        number = F.when((F.octet_length("value") >= 5) & head.startswith("00"), F.conv(F.substring(head, 3, 8), 16, 10).cast("int"))
        rows = messages.withColumn("__schema", number).withColumn("__body", F.expr("substring(value, 6)").cast("string"))
        valid = F.try_parse_json("__body").isNotNull() & F.ltrim("__body").startswith("{")
        side = lambda df, reason: df.select("topic", "partition", "offset", "value", reason.alias("reason"))
        out: dict[int | None, Parsed] = {}
        for k, schema in self.schemas.items():
            mine = rows.where(F.col("__schema") == k).withColumn("__ok", valid)
            good = mine.where("__ok").withColumn("__e", F.from_json("__body", schema)).select("topic", "partition", "offset", "__e.*")
            out[k] = Parsed(good, side(mine.where("NOT __ok"), F.lit("the body is no JSON object")))
        known = F.coalesce(F.col("__schema").isin(*self.schemas), F.lit(False))
        reason = F.when(F.col("__schema").isNull(), F.lit("no head of a zero byte and a schema's number")).otherwise(F.concat(F.lit("unknown schema "), F.col("__schema").cast("string")))
        out[None] = Parsed(messages.limit(0), side(rows.where(~known), reason))
        return out


def cloud_log() -> GenericParser:
    """Log entries of a fixed JSON shape."""
    kinds = {"timestamp": "datetime", "uid": "utf8", "resource": "any", "ingestedAt": "datetime", "savedAt": "datetime", "level": "utf8", "message": "utf8", "jsonPayload": "any", "streamName": "utf8"}
    return GenericParser([FieldSpec(n, t, key=n in ("timestamp", "uid")) for n, t in kinds.items()], aux=False)


def fields_from_json(text: str) -> list[FieldSpec]:
    return [FieldSpec(**f) for f in json.loads(text)]
