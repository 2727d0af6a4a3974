"""File readers with their own rules for names and types.

Types are inferred from the first data row alone, on the driver; the rows are then
read by Spark's readers under that schema, so nothing is scanned twice.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import SPARK_TYPES, field as schema_field

_TIME = re.compile(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")


@dataclass
class Read:
    rows: DataFrame
    unparsed: DataFrame | None = None


def with_file_columns(df: DataFrame, row_index: bool = False) -> DataFrame:
    """``__file_name`` and, where asked for, ``__row_index`` (from 1, by position in the file) as the key, first."""
    out = df.withColumn("__file_name", F.col("_metadata.file_path"))
    names = ["__file_name"]
    if row_index:
        from pyspark.sql import Window

        place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
        out = out.withColumn("__row_index", F.row_number().over(Window.partitionBy("__file_name").orderBy(place)))
        names.append("__row_index")
    return out.select(*names, *df.columns)


# --- CSV -------------------------------------------------------------------------------------------------


@dataclass
class CsvOptions:
    delimiter: str = ","
    quote: str = '"'
    escape: str = "\\"
    encoding: str = "UTF-8"
    multiline: bool = False
    null_values: list[str] = field(default_factory=list)
    true_values: list[str] = field(default_factory=lambda: ["true", "True", "TRUE"])
    false_values: list[str] = field(default_factory=lambda: ["false", "False", "FALSE"])
    decimal_point: str = "."
    names: list[str] = field(default_factory=list)
    generate_names: bool = False
    include: list[str] = field(default_factory=list)
    include_missing: bool = False
    skip_rows: int = 0


def csv_type(value: str, options: CsvOptions) -> str:
    """Empty is text; what holds a quote is JSON if it is an object or array; true and false; every number is a double."""
    if value == "":
        return "utf8"
    if '"' in value or "`" in value:
        try:
            return "any" if isinstance(json.loads(value), (dict, list)) else "utf8"
        except ValueError:
            return "utf8"
    if value in options.true_values or value in options.false_values:
        return "boolean"
    try:
        float(value.replace(options.decimal_point, ".") if options.decimal_point != "." else value)
        return "double"
    except ValueError:
        return "utf8"


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> Read:
    o = options or CsvOptions()
    head = [r.value for r in spark.read.text(path).limit(o.skip_rows + 2).collect()][o.skip_rows :]
    cut = lambda line: next(csv.reader([line], delimiter=o.delimiter, quotechar=o.quote), [])
    header = not o.names and not o.generate_names
    if not head:
        return Read(spark.createDataFrame([], T.StructType()))
    first = cut(head[0])
    names = o.names or ([f"f{i}" for i in range(len(first))] if o.generate_names else first)
    sample = cut(head[1]) if header and len(head) > 1 else [] if header else first
    kinds = [csv_type(sample[i], o) if i < len(sample) else "utf8" for i in range(len(names))]
    reader = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_broken"]])).options(sep=o.delimiter, quote=o.quote, escape=o.escape, encoding=o.encoding, multiLine=o.multiline, header=header and o.skip_rows == 0, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", columnPruning=False)  # a line is broken whatever columns are asked for
    df = reader.csv(path)
    if o.skip_rows:
        # each file's own first lines go, by their place: the split that starts a file has them in front
        from pyspark.sql import Window

        top = Window.partitionBy("__file").orderBy("__place")
        lines = spark.read.option("encoding", o.encoding).text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__place"))
        skipped = lines.where("__start = 0").withColumn("__n", F.row_number().over(top)).where(F.col("__n") <= o.skip_rows + header).groupBy("__file").agg(F.max("__place").alias("__last"))
        lines = lines.join(skipped, "__file", "left").where(F.col("__last").isNull() | (F.col("__start") > 0) | (F.col("__place") > F.col("__last")))
        df = lines.select(F.from_csv("value", df.schema.simpleString()[7:-1].replace(":", " "), {"sep": o.delimiter, "quote": o.quote, "escape": o.escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    out = []
    for n, kind in zip(names, kinds, strict=True):
        c = F.col(f"`{n}`")
        if o.null_values:
            c = F.when(~c.isin(*o.null_values), c)
        if kind == "boolean":
            c = F.when(c.isin(*o.true_values), True).when(c.isin(*o.false_values), False)
        elif kind == "double":
            c = (F.translate(c, o.decimal_point, ".") if o.decimal_point != "." else c).try_cast("double")
        out.append(c.alias(n, metadata={"canonical": kind}))
    # a condition that always holds, but reads a column: Spark refuses to read the broken text alone
    read = F.coalesce(F.length(f"`{names[0]}`"), F.lit(0)) >= 0
    bad = df.where(F.col("_broken").isNotNull() & read).select(F.col("_broken").alias("unparsed_row"))
    rows = df.where(F.col("_broken").isNull() & read).select(*out)
    if o.include:
        if (missing := [n for n in o.include if n not in names]) and not o.include_missing:
            raise ValueError(f"no columns {missing} in {path}")
        rows = rows.select(*[F.col(n) if n in names else F.lit(None).cast("string").alias(n) for n in o.include])
    return Read(rows, bad)


# --- JSON lines ------------------------------------------------------------------------------------------


def json_type(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "double"
    if isinstance(value, str):
        return "timestamp" if _TIME.match(value) else "utf8"
    return "any"


def read_jsonl(spark: SparkSession, path: str, fields: list[tuple[str, str]] | None = None, unexpected: str = "infer", policy: str = "continue") -> Read:
    """Objects, one a line.  unexpected: 'infer' (to ``_rest``), 'ignore' or 'error'; policy for broken lines: 'continue' or 'fail'."""
    lines = spark.read.text(path).where("value != ''")
    if fields is None:
        first = lines.first()
        fields = [(k, json_type(v)) for k, v in sorted(json.loads(first.value).items())] if first else []
    rows = lines.withColumn("__m", F.from_json("value", "map<string,string>")).withColumn("__ok", F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"))
    known = F.array(*[F.lit(n) for n, _ in fields]).cast("array<string>")
    extra = F.map_filter("__m", lambda k, v: ~F.array_contains(known, k))
    out = []
    for n, kind in fields:
        c = F.col("__m")[n]
        c = F.try_to_timestamp(c) if kind == "timestamp" else c if kind in ("utf8", "any") else c.try_cast(SPARK_TYPES[kind])
        out.append(c.alias(n, metadata={"canonical": kind}))
    if unexpected == "infer":
        out.append(extra.alias("_rest", metadata={"canonical": "any"}))
    elif unexpected == "error":
        rows = rows.withColumn("__ok", F.when(F.col("__ok") & (F.size(extra) > 0), F.raise_error(F.concat(F.lit("unexpected fields: "), F.to_json(F.map_keys(extra)))).cast("boolean")).otherwise(F.col("__ok")))
    if policy == "fail":
        rows = rows.withColumn("__ok", F.when(F.col("__ok"), True).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), "value")).cast("boolean")))
    return Read(rows.where("__ok").select(*out), rows.where("NOT __ok").select(F.col("value").alias("unparsed_row")))


# --- others ----------------------------------------------------------------------------------------------


def read_parquet(spark: SparkSession, path: str, decimals_as_text: bool = True) -> Read:
    """Parquet with the transfer's types: long decimals as text, short ones as doubles."""
    df = spark.read.option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(path)
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) and decimals_as_text:
            c = c.cast("string" if f.dataType.precision > 8 else "double")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return Read(df.select(*out))


def read_lines(spark: SparkSession, path: str, name: str = "line") -> Read:
    return Read(spark.read.text(path).withColumnRenamed("value", name))


def nginx_pattern(log_format: str) -> tuple[str, list[str]]:
    """A regular expression of the format's literals and variables, and the variables' names, made unique."""
    pattern, names, at = "^", [], 0
    for m in re.finditer(r"\$(\w+)|\$\{(\w+)\}", log_format):
        pattern += re.escape(log_format[at : m.start()])
        name, stop = m[1] or m[2], log_format[m.end() : m.end() + 1]
        names.append(name if name not in names else f"{name}_{names.count(name) + 1}")
        pattern += f"([^{re.escape(stop)}]*)" if stop else "(.*)"
        at = m.end()
    return pattern + re.escape(log_format[at:]) + "$", names


def read_nginx(spark: SparkSession, path: str, log_format: str) -> Read:
    pattern, names = nginx_pattern(log_format)
    lines = spark.read.text(path).where("value != ''")
    fits = F.col("value").rlike(pattern)
    numbers = {"status": "int", "body_bytes_sent": "bigint", "bytes_sent": "bigint", "request_time": "double", "request_length": "bigint"}
    cols = [F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)]
    rows = lines.where(fits).select(*cols)
    rows = rows.select(*[F.col(n).try_cast(numbers[n]).alias(n) if n in numbers else (F.try_to_timestamp(n, F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias(n) if n == "time_local" else F.col(n)) for n in names])
    return Read(rows, lines.where(~fits).select(F.col("value").alias("unparsed_row")))


def estimate_rows(spark: SparkSession, path: str, files: int = 10) -> int:
    """Rows by the sizes of all files and the density of a few."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    total = listed.agg(F.sum("length")).first()[0] or 0
    some = listed.orderBy(F.desc("length")).limit(files).collect()
    if not some:
        return 0
    count = spark.read.text([r.path for r in some]).count()
    return round(count * total / sum(r.length for r in some))


READERS: dict[str, Callable[..., Read]] = {"csv": read_csv, "jsonl": read_jsonl, "parquet": read_parquet, "line": read_lines, "nginx": read_nginx}


# --- Delta tables ----------------------------------------------------------------------------------------


def read_delta(spark: SparkSession, path: str, version: int | None = None, timestamp_ms: int | None = None) -> DataFrame:
    """A Delta table's snapshot by its JSON log and checkpoints: the files that the last action adds.

    The log is read and reduced by Spark; the list of live files goes to the reader,
    as any file listing does.  A table's partition values come from the log.
    """
    actions = "add struct<path:string,partitionValues:map<string,string>>, remove struct<path:string>, metaData struct<schemaString:string,partitionColumns:array<string>>"
    numbered = lambda df, pattern: df.withColumn("version", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("bigint"))
    log = numbered(spark.read.option("pathGlobFilter", "*.json").schema(f"{actions}, commitInfo struct<timestamp:bigint>").json(f"{path}/_delta_log"), r"^(\d+)\.json$")
    if timestamp_ms is not None:
        version = log.where(F.col("commitInfo.timestamp") <= timestamp_ms).agg(F.max("version")).first()[0]
    if version is not None:
        log = log.where(F.col("version") <= version)
    points = spark.read.option("pathGlobFilter", "*.checkpoint*.parquet").schema(actions).parquet(f"{path}/_delta_log")
    points = numbered(points, r"^(\d+)\.checkpoint")
    if version is not None:
        points = points.where(F.col("version") <= version)
    if (point := points.agg(F.max("version")).first()[0]) is not None:  # all before it is in it
        log = points.where(F.col("version") == point).unionByName(log.where(F.col("version") > point).drop("commitInfo"))
    meta = log.where("metaData IS NOT NULL").orderBy(F.desc("version")).select("metaData").first()["metaData"]
    actions = log.where("add IS NOT NULL OR remove IS NOT NULL").select(F.coalesce("add.path", "remove.path").alias("path"), F.struct("version", F.col("add").isNotNull().alias("added")).alias("at"), F.col("add.partitionValues").alias("parts"))
    live = actions.groupBy("path").agg(F.max("at").alias("at"), F.max_by("parts", "at").alias("parts")).where("at.added").select("path", "parts").collect()
    schema = T.StructType.fromJson(json.loads(meta["schemaString"]))
    stored = T.StructType([f for f in schema if f.name not in (meta["partitionColumns"] or [])])
    if not live:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(stored).parquet(*[f"{path}/{r.path}" for r in live])
    if meta["partitionColumns"]:
        parts = F.broadcast(spark.createDataFrame([(r.path.split("/")[-1], r.parts) for r in live], "__f string, __p map<string,string>"))
        df = df.withColumn("__f", F.col("_metadata.file_name")).join(parts, "__f")
        df = df.select(*[F.col("__p")[f.name].cast(f.dataType).alias(f.name) if f.name in meta["partitionColumns"] else F.col(f.name) for f in schema])
    return df


# --- synthetic rows --------------------------------------------------------------------------------------

IOT = T.StructType([schema_field(n, t, key=n in ("event_id", "event_utc_ts"), required=True) for n, t in (("event_id", "utf8"), ("event_utc_ts", "timestamp"), ("event_type", "utf8"), ("device_id", "utf8"), ("device_type", "utf8"), ("metric_value", "double"), ("metric_type", "utf8"), ("location_id", "int64"), ("device_status", "utf8"), ("event_severity", "utf8"), ("event_source", "utf8"))])


def sample_iot(spark: SparkSession, rows: int, seed: int = 1, start: str = "2024-01-01 00:00:00", partitions: int | None = None) -> DataFrame:
    """Synthetic device events, the same for the same seed; each task makes a range of its own."""
    pick = lambda salt, *names: F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(names))).cast("int") + 1)
    number = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return base.select(
        F.sha1(F.concat_ws("|", F.lit(seed), "id")).alias("event_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("id")).alias("event_utc_ts"),
        pick(1, "reading", "alert", "heartbeat").alias("event_type"),
        F.concat(F.lit("device-"), number(2, 1000).cast("string")).alias("device_id"),
        pick(3, "sensor", "meter", "camera").alias("device_type"),
        (number(4, 100_000) / 100).alias("metric_value"),
        pick(5, "temperature", "humidity", "power").alias("metric_type"),
        number(6, 500).alias("location_id"),
        pick(7, "active", "idle", "offline").alias("device_status"),
        pick(8, "low", "medium", "high").alias("event_severity"),
        pick(9, "edge", "cloud").alias("event_source"),
    )


def sample_activities(spark: SparkSession, rows: int, seed: int = 1, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Synthetic user events."""
    pick = lambda salt, *names: F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(names))).cast("int") + 1)
    number = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    return spark.range(rows).select(
        F.sha1(F.concat_ws("|", F.lit(seed), "id")).alias("event_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("id")).alias("event_utc_ts"),
        pick(1, "view", "click", "purchase").alias("event_type"),
        F.concat(F.lit("d"), number(2, 5000).cast("string")).alias("device_id"),
        pick(3, "phone", "tablet", "desktop").alias("device_type"),
        pick(4, "android", "ios", "linux", "windows").alias("device_os"),
        pick(5, "France", "Spain", "Germany").alias("country_name"),
        pick(6, "Paris", "Madrid", "Berlin").alias("city_name"),
        F.when(number(7, 4) == 0, number(8, 10_000) / 100).alias("event_revenue"),
        pick(9, "search", "direct", "mail").alias("traffic_source"),
        number(10, 100_000).alias("user_id"),
        F.concat(F.lit("s"), number(11, 50_000).cast("string")).alias("session_id"),
        (number(12, 60_000) / 1000).alias("event_duration"),
    )
