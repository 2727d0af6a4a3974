"""What the file and queue formats make of each type, and change events as queue messages."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.changelog import DELETE, INSERT, UPDATE, data_columns, keys_changed, old_value
from millrace.functions.text import plain_number, rfc3339
from millrace.schema import canonical_of, keys_of


def _as_text(f: T.StructField) -> Column:
    c, k = F.col(f"`{f.name}`"), f.dataType
    if isinstance(k, T.BinaryType):
        return F.base64(c)
    if isinstance(k, (T.TimestampType, T.TimestampNTZType)):
        return rfc3339(c)
    if isinstance(k, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(k, (T.FloatType, T.DoubleType)):
        return plain_number(c)
    if isinstance(k, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def for_csv(df: DataFrame) -> DataFrame:
    """Null is empty, bytes are base64, nested values JSON."""
    return df.select(*[F.coalesce(_as_text(f), F.lit("")).alias(f.name) for f in df.schema])


def for_parquet(df: DataFrame) -> DataFrame:
    """Doubles and decimals as text, so no digit is lost; nested values as JSON."""
    out = []
    for f in df.schema:
        c, k = F.col(f"`{f.name}`"), f.dataType
        if isinstance(k, T.DoubleType):
            c = plain_number(c)
        elif isinstance(k, T.DecimalType):
            c = c.cast("string")
        elif isinstance(k, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(k, T.DayTimeIntervalType):
            c = F.timestamp_seconds(F.lit(0)) + c
        out.append(c.alias(f.name))
    return df.select(*out)


def json_value(f: T.StructField, any_as_text: bool) -> Column:
    c, k = F.col(f"`{f.name}`"), f.dataType
    if isinstance(k, T.BinaryType):
        return F.base64(c)
    if isinstance(k, (T.TimestampType, T.TimestampNTZType)):
        return rfc3339(c)
    if isinstance(k, T.DayTimeIntervalType):
        return (F.unix_micros(F.timestamp_seconds(F.lit(0)) + c) * 1000).cast("bigint")
    if canonical_of(f) == "any" and isinstance(k, T.StringType) and not any_as_text:
        return F.try_parse_json(c)
    return c


def to_jsonl(df: DataFrame, any_as_text: bool = False) -> DataFrame:
    """One JSON object a row, nulls and all, in the column ``value``."""
    return df.select(F.to_json(F.struct(*[json_value(f, any_as_text).alias(f.name) for f in df.schema]), {"ignoreNullFields": "false"}).alias("value"))


def raw_bytes(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("value").cast("string").alias("value"))


def write_files(df: DataFrame, path: str, form: str, max_rows: int | None = None, compression: str | None = None, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Files of one of the formats csv, jsonl, parquet and raw; ``by``: columns that become directories."""
    shape = {"csv": for_csv, "parquet": for_parquet, "raw": raw_bytes}
    by = by or []
    if form == "jsonl":
        body = F.to_json(F.struct(*[json_value(f, False).alias(f.name) for f in df.schema if f.name not in by]), {"ignoreNullFields": "false"}).alias("value")
        out = df.select(*by, body)
    else:
        kept = df.select(*[c for c in df.columns if c not in by])
        out = shape[form](kept) if not by else df.select(*by, *[_as_text(f).alias(f.name) if form == "csv" else F.col(f.name) for f in kept.schema])
    writer = out.write.mode(mode)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if compression:
        writer = writer.option("compression", compression)
    if by:
        writer = writer.partitionBy(*by)
    {"csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}.get(form, writer.text)(path)


# --- layouts ----------------------------------------------------------------------------------------------

LAYOUTS = {"hour": "yyyy/MM/dd/HH", "day": "yyyy/MM/dd", "month": "yyyy/MM"}


def time_bucket(df: DataFrame, layout: str = "day", column: str | None = None) -> DataFrame:
    """Inserts with their ``bucket``: the layout of a column's or of the commit time."""
    t = F.col(column) if column else F.timestamp_micros((F.col("_commit_ts_ns") / 1000).cast("bigint"))
    rows = df.where(F.col("_kind") == INSERT) if "_kind" in df.columns else df
    return rows.withColumn("bucket", F.date_format(t, LAYOUTS.get(layout, layout)))


def queue_files(messages: DataFrame, rows_a_file: int) -> DataFrame:
    """Messages with the file they go to, ``topic/partition=p/topic+p+first offset``; files are cut at multiples of the offset."""
    first = F.floor(F.col("offset") / rows_a_file) * rows_a_file
    return messages.withColumn("file", F.concat(F.col("topic"), F.lit("/partition="), F.col("partition"), F.lit("/"), F.concat_ws("+", "topic", F.col("partition").cast("string"), first.cast("string"))))


def rotated_table(name: Column, at: Column, unit: str, size: int, template: str = "{{name}}/{{partition}}") -> Column:
    """The table of a time bin.  Days are counted within the month, months within the year, hours within the day."""
    if unit == "h":
        start, shown = F.date_trunc("day", at) + F.make_dt_interval(hours=F.hour(at) - F.hour(at) % size), "yyyy-MM-dd'T'HH:mm:ss"
    elif unit == "d":
        start, shown = F.date_add(F.trunc(at, "month"), ((F.dayofmonth(at) - 1) - (F.dayofmonth(at) - 1) % size)), "yyyy-MM-dd"
    elif unit == "m":
        start, shown = F.make_date(F.year(at), F.month(at) - (F.month(at) - 1) % size, F.lit(1)), "yyyy-MM"
    else:
        raise ValueError("a bin's unit is h, d or m")
    before, _, rest = template.partition("{{name}}")
    middle, _, after = rest.partition("{{partition}}")
    return F.concat(F.lit(before), name, F.lit(middle), F.date_format(start, shown), F.lit(after))


def expired(bin_start: Column, now: Column, unit: str, size: int, keep: int) -> Column:
    """Whether a bin is older than the number to keep."""
    span = {"h": F.make_dt_interval(hours=F.lit(size * keep)), "d": F.make_dt_interval(days=F.lit(size * keep)), "m": F.make_ym_interval(months=F.lit(size * keep))}[unit]
    return bin_start < now - span


# --- change events as messages ----------------------------------------------------------------------------


def native(df: DataFrame) -> DataFrame:
    """Whole events as JSON."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).cast("binary").alias("value"))


@dataclass(frozen=True)
class ConnectForms:
    """How an envelope with a schema block shows types that JSON has not.

    decimals: 'precise' (bytes of the unscaled number), 'double' or 'string'; times: 'adaptive'
    (microseconds) or 'connect' (milliseconds); binary: 'bytes' (base64) or 'hex'.
    """

    decimals: str = "precise"
    times: str = "adaptive"
    binary: str = "bytes"

    def __post_init__(self) -> None:
        for name, known in (("decimals", ("precise", "double", "string")), ("times", ("adaptive", "connect")), ("binary", ("bytes", "hex"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}")

    def of(self, kind: T.DataType, c: Column) -> tuple[dict, Column]:
        """The schema of a type, and a value of it."""
        if isinstance(kind, T.DecimalType):
            if self.decimals != "precise":
                return {"type": self.decimals}, c.cast(self.decimals)
            return {"type": "bytes", "name": "org.apache.kafka.connect.data.Decimal", "version": 1, "parameters": {"scale": str(kind.scale), "connect.decimal.precision": str(kind.precision)}}, decimal_bytes(c)
        if isinstance(kind, T.DateType):
            return {"type": "int32", "name": "io.debezium.time.Date" if self.times == "adaptive" else "org.apache.kafka.connect.data.Date", "version": 1}, F.unix_date(c)
        if isinstance(kind, T.TimestampNTZType):
            micros = F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
            if self.times == "adaptive":
                return {"type": "int64", "name": "io.debezium.time.MicroTimestamp", "version": 1}, micros
            return {"type": "int64", "name": "org.apache.kafka.connect.data.Timestamp", "version": 1}, F.floor(micros / 1000)
        if isinstance(kind, T.TimestampType):
            return {"type": "string", "name": "io.debezium.time.ZonedTimestamp", "version": 1}, rfc3339(c)
        if isinstance(kind, T.DayTimeIntervalType):
            return {"type": "int64", "name": "io.debezium.time.MicroDuration", "version": 1}, F.unix_micros(F.timestamp_seconds(F.lit(0)) + c)
        if isinstance(kind, T.BinaryType):
            return ({"type": "bytes"}, F.base64(c)) if self.binary == "bytes" else ({"type": "string"}, F.lower(F.hex(c)))
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return {"type": "string", "name": "io.debezium.data.Json", "version": 1}, F.to_json(c)
        plain = {"tinyint": "int16", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double", "boolean": "boolean"}
        return {"type": plain.get(kind.simpleString(), "string")}, c if kind.simpleString() in plain else c.cast("string")


#: How far the upper half of a 128-bit number is shifted, as text.
WORD = str(2**64)


def decimal_bytes(c: Column) -> Column:
    """Base64 of the unscaled number, big-endian in two's complement, in as few bytes as hold it."""
    u, word = F.replace(c.cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)"), F.lit(WORD).cast("decimal(20,0)")
    low = F.pmod(u, word)
    high = F.call_function("div", u, word) - F.when((u < 0) & (low != 0), 1).otherwise(0)
    digits = F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.conv(low.cast("string"), 10, 16), 16, "0"))
    return F.base64(F.unhex(F.regexp_replace(digits, "^(?:(?:00)+(?=[0-7])|(?:FF)+(?=[89A-F]))", "")))


def decimal_of_bytes(text: Column, kind: T.DecimalType) -> Column:
    """The decimal whose :func:`decimal_bytes` are given."""
    digits = F.hex(F.unbase64(text))
    negative = digits.rlike("^[89A-F]")
    # -n has the flipped digits of n - 1
    digits = F.lpad(F.when(negative, F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(digits), 32, "0")
    high, low = (F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
    shown = (high * F.lit(WORD).cast("decimal(20,0)") + low + F.when(negative, 1).otherwise(0)).cast("decimal(38,0)").cast("string")
    number = F.lpad(shown, F.greatest(F.length(shown), F.lit(kind.scale + 1)), "0")
    point = F.length(number) - kind.scale
    return F.concat(F.when(negative, "-").otherwise(""), F.substring(number, F.lit(1), point), F.lit("."), F.substring(number, point + 1, F.lit(kind.scale + 1))).cast(kind)


def _connect_struct(fields: list[dict], name: str, optional: bool = False) -> dict:
    return {"type": "struct", "fields": fields, "optional": optional, "name": name}


def debezium(df: DataFrame, keys: list[str] | None = None, snapshot: bool = False, tombstones: bool = True, forms: ConnectForms | None = None, name: str = "") -> DataFrame:
    """Rows (key, value, seq) of envelopes; a delete and a change of key leave a tombstone, and the latter then a create.

    With ``forms`` each key and value is an object of ``schema`` and ``payload``, of types so named; ``name``: the prefix of its structs.
    """
    keys = keys or keys_of(df.schema)
    columns = data_columns(df)
    kinds = {c: df.schema[c].dataType for c in columns}
    form = lambda n, c: (forms.of(kinds[n], c)[1] if forms else c).alias(n)
    now = F.struct(*[form(c, F.col(f"`{c}`")) for c in columns])
    was = F.struct(*[form(c, old_value(df, c)) for c in columns])
    key_now = F.to_json(F.struct(*[form(k, F.col(f"`{k}`")) for k in keys]), {"ignoreNullFields": "false"})
    key_was = F.to_json(F.struct(*[form(k, old_value(df, k)) for k in keys]), {"ignoreNullFields": "false"})
    source = F.struct(F.col("_lsn").alias("lsn"), F.col("_tx_id").alias("txId"), F.col("_schema").alias("schema"), F.col("_table").alias("table"))
    empty = F.lit(None).cast(df.select(now.alias("x")).schema["x"].dataType)
    wrap = lambda c, schema: c
    key_schema = value_schema = None
    if forms:
        field = lambda n, optional: {**forms.of(kinds[n], F.lit(None))[0], "optional": optional, "field": n}
        wrap = lambda c, schema: F.concat(F.lit('{"schema":' + json.dumps(schema, separators=(",", ":")) + ',"payload":'), c, F.lit("}"))
        row = _connect_struct([field(c, c not in keys) for c in columns], f"{name}.Value", True)
        place = [{"type": t, "optional": True, "field": n} for n, t in (("lsn", "int64"), ("txId", "int64"), ("schema", "string"), ("table", "string"))]
        value_schema = _connect_struct([{**row, "field": "before"}, {**row, "field": "after"}, {**_connect_struct(place, f"{name}.Source"), "field": "source"}, {"type": "string", "optional": False, "field": "op"}, {"type": "int64", "optional": True, "field": "ts_ms"}], f"{name}.Envelope")
        key_schema = _connect_struct([field(k, False) for k in keys], f"{name}.Key")
    key_now, key_was = wrap(key_now, key_schema), wrap(key_was, key_schema)

    def message(key: Column, before: Column, after: Column, op: str, seq: int) -> Column:
        body = F.to_json(F.struct(before.alias("before"), after.alias("after"), source.alias("source"), F.lit(op).alias("op"), (F.col("_commit_ts_ns") / 1_000_000).cast("bigint").alias("ts_ms")), {"ignoreNullFields": "false"})
        return F.struct(key.alias("key"), wrap(body, value_schema).alias("value"), F.lit(seq).alias("seq"))

    grave = lambda seq: [F.struct(key_was.alias("key"), F.lit(None).cast("string").alias("value"), F.lit(seq).alias("seq"))] if tombstones else []
    create = "r" if snapshot else "c"
    moved = F.array(message(key_was, was, empty, "d", 0), *grave(1), message(key_now, empty, now, "c", 2))
    messages = (
        F.when(F.col("_kind") == INSERT, F.array(message(key_now, empty, now, create, 0)))
        .when(keys_changed(df, keys), moved)
        .when(F.col("_kind") == UPDATE, F.array(message(key_now, was, now, "u", 0)))
        .when(F.col("_kind") == DELETE, F.array(message(key_was, was, empty, "d", 0), *grave(1)))
    )
    return df.select("_lsn", "_counter", F.explode(messages).alias("m")).select("_lsn", "_counter", "m.seq", "m.key", "m.value")
