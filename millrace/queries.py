"""The registered queries over the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import changelog as C
from millrace import schema as types

from millrace.operators import transforms as X
from millrace.operators.checksum import compare
from millrace.operators.selectors import Selector
from millrace.plans.chain import build, run_chain
from millrace.schema import TableId, with_keys
from millrace.sinks import serialize, tables
from millrace.sources import messages as M
from millrace.sources import parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows(t: X.Transform, df: DataFrame) -> DataFrame:
    return t.apply(df).rows


EVENTS = TableId("public", "events")
SALT = "salt-of-the-flagship"


def _hmac_sql(message: str, key: str) -> str:
    """HMAC-SHA256 in SQL: the pads are literal bytes."""
    pad = key.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in pad).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


# --- the synthetic changelog: inserts, then partial updates, deletes and changes of key --------------------

MOVED = 1_000_000_000


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event an insert; of every third an update of value; of every seventh a delete; of every eleventh else a new key."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    some = lambda c, step, kind, present, old, **new: e.where(c).select((F.col("event_id") * 10 + step).alias("_lsn"), F.lit(kind).alias("_kind"), *[new.get(n, F.col(n)).alias(n) for n in e.columns], present.alias("_present"), old.alias("_old"))
    none = F.lit(None).cast("array<string>")
    no_old = F.lit(None).cast("struct<event_id:bigint>")
    was = F.struct(F.col("event_id"))
    null = lambda t: F.lit(None).cast(t)
    i = F.col("event_id")
    log = some(F.lit(True), 0, "insert", none, no_old)
    log = log.unionByName(some(i % 3 == 0, 1, "update", F.array(F.lit("event_id"), F.lit("value")), was, user_id=null("bigint"), event_type=null("string"), value=F.col("value") * 2))
    log = log.unionByName(some(i % 7 == 0, 2, "delete", none, was, user_id=null("bigint"), event_type=null("string"), value=null("double")))
    log = log.unionByName(some((i % 11 == 0) & (i % 7 != 0), 3, "update", F.array(F.lit("event_id"), F.lit("user_id"), F.lit("event_type"), F.lit("value")), was, event_id=i + MOVED, value=F.when(i % 3 == 0, F.col("value") * 2).otherwise(F.col("value"))))
    meta = {"_tx_id": F.col("_lsn"), "_commit_ts_ns": F.col("_lsn") * 1000, "_counter": F.lit(0), "_schema": F.lit("public"), "_table": F.lit("events"), "_part_id": F.lit("")}
    return log.select(*[(meta[c] if c in meta else F.col(c)).cast(t).alias(c) for c, t in C.META.items()], *e.columns, "_present", "_old")


STATE_SQL = f"""
SELECT CASE WHEN event_id % 11 = 0 THEN event_id + {MOVED} ELSE event_id END AS event_id, user_id, event_type,
       CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value
FROM events WHERE event_id % 7 <> 0
"""


# --- transforms -------------------------------------------------------------------------------------------


@query(f"SELECT event_id, event_type, value, {_hmac_sql('user_id::VARCHAR', SALT)} AS user_id FROM events WHERE event_type = 'purchase' AND value > 100")
def flagship_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows filtered, columns chosen, the user masked."""
    chain = build([{"filter_rows": {"filter": 'event_type = "purchase" AND value > 100'}}, {"filter_columns": {"columns": Selector(include=["^event_id$", "^event_type$", "^value$", "^user_id$"])}}, {"mask_field": {"columns": ["user_id"], "salt": SALT}}])
    return run_chain(with_keys(read(spark, sf_dir, "events"), ["event_id"]), EVENTS, chain).rows


def _filtered(filters: list[str], table: str = "events") -> Callable:
    return lambda spark, sf_dir: rows(X.FilterRows(filters=filters), read(spark, sf_dir, table))


for _name, _filters, _where in (
    ("filter_rows_cmp", ["value >= 50.5 AND user_id < 100"], "value >= 50.5 AND user_id < 100"),
    ("filter_rows_in", ['event_type IN ("click", "view") AND user_id NOT IN (1, 2, 3)'], "event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)"),
    ("filter_rows_substring", ['event_type ~ "ur" AND props !~ "7"'], "contains(event_type, 'ur') AND NOT contains(props, '7')"),
    ("filter_rows_or_filters", ['event_type = "error"', "value > 200"], "event_type = 'error' OR value > 200"),
    ("filter_rows_null", ["value != NULL AND event_id >= 10"], "value IS NOT NULL AND event_id >= 10"),
    ("filter_rows_time", ["ts >= 2024-01-10T00:00:00Z"], "ts >= TIMESTAMP '2024-01-10'"),
):
    QUERIES[_name], ORACLE[_name] = _filtered(_filters), f"SELECT * FROM events WHERE {_where}"


@query("SELECT event_id, event_type FROM events")
def filter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(X.FilterColumns(columns=Selector(include=["^event_"])), read(spark, sf_dir, "events"))


@query(f"SELECT 'insert' AS kind, count(*) AS n FROM events UNION ALL SELECT 'update', count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 11 = 0 AND event_id % 7 <> 0) FROM events")
def skip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rows(X.SkipEvents(events=["delete"]), event_changes(spark, sf_dir))
    return kept.groupBy(F.col("_kind").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT * FROM customer WHERE starts_with(c_name, 'Customer#000000') OR starts_with(c_name, 'Customer#00000011')")
def filter_rows_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(X.FilterRowsByIds(columns=Selector(include=["^c_name$"]), ids=["Customer#000000", "Customer#00000011"]), read(spark, sf_dir, "customer"))


@query(f"SELECT event_id, {_hmac_sql('user_id::VARCHAR', 'pepper')} AS user_id, {_hmac_sql('event_type', 'pepper')} AS event_type FROM events")
def mask_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(X.MaskField(columns=["user_id", "event_type"], salt="pepper"), read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, coalesce(o_orderstatus, '<nil>') AS o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate FROM orders")
def to_string_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(X.ConvertToString(), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"))


@query("SELECT l_orderkey, to_timestamp(l_linenumber)::TIMESTAMP AS l_linenumber FROM lineitem")
def to_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(X.ConvertToDatetime(columns=Selector(include=["l_linenumber"])), read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber")))


@query("SELECT doc_id, regexp_replace(text, '([a-z]+)ing\\b', '<\\1>', 'g') AS text FROM documents")
def regex_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(X.RegexReplace(columns=Selector(include=["^text$"]), pattern=r"([a-z]+)ing\b", replacement="<${1}>"), read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT 'archive' AS schema_name, 'happenings' AS table_name, count(*) AS n FROM events")
def rename_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = rows(X.RenameTables(renames={("public", "events"): ("archive", "happenings")}), C.as_changelog(read(spark, sf_dir, "events"), "public", "events"))
    return moved.groupBy(F.col("_schema").alias("schema_name"), F.col("_table").alias("table_name")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, ts, event_type, value, props FROM events")
def replace_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(X.ReplacePrimaryKey(keys=["user_id", "event_id"]), with_keys(read(spark, sf_dir, "events"), ["event_id"]))


#: CRC-32 by its table, a byte at a time; the keys are ASCII.
CRC_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), keys AS (
  SELECT list_transform(string_split(event_id::VARCHAR || '.' || event_type, ''), lambda ch: ascii(ch)::BIGINT) AS bytes FROM events
), hashed AS (
  SELECT xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM keys, crc
)
SELECT (h % 16)::VARCHAR AS part, count(*) AS n FROM hashed GROUP BY 1
"""


@query(CRC_SQL)
def sharder_part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = rows(X.Sharder(columns=Selector(include=["^event_id$", "^event_type$"]), shards=16), read(spark, sf_dir, "events"))
    return sharded.groupBy(F.col("_part_id").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT 'events/' || event_type AS table_name, count(*) AS n FROM events GROUP BY 1")
def table_splitter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = rows(X.TableSplitter(columns=["event_type"]), C.as_changelog(read(spark, sf_dir, "events"), "public", "events"))
    return split.groupBy(F.col("_table").alias("table_name")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, '1970-01-01 00:00:00' AS etl_updated_at, event_id::VARCHAR || '|' || event_type AS doc_values FROM events")
def raw_doc_grouper(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = C.as_changelog(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "public", "events")
    out = rows(X.RawDocGrouper(keys=["event_id"], fields=["user_id"]), log)
    shown = F.concat_ws("|", F.get_json_object("doc", "$.event_id"), F.get_json_object("doc", "$.event_type"))
    return out.select("event_id", "user_id", F.date_format("etl_updated_at", "yyyy-MM-dd HH:mm:ss").alias("etl_updated_at"), shown.alias("doc_values"))


@query("SELECT event_id, false AS deleted_flg FROM events UNION ALL SELECT event_id, false FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, true FROM events WHERE event_id % 7 = 0 "
       f"UNION ALL SELECT event_id + {MOVED}, false FROM events WHERE event_id % 11 = 0 AND event_id % 7 <> 0")
def raw_cdc_doc_grouper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(X.RawCdcDocGrouper(fields=["event_id"]), event_changes(spark, sf_dir)).where("_kind = 'insert'").select("event_id", "deleted_flg")


@query("SELECT event_id, event_type, rank FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def sql_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = C.as_changelog(read(spark, sf_dir, "events"), "public", "events")
    inner = "SELECT event_id, event_type, rank FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM table) WHERE rank <= 3"
    return rows(X.Sql(query=inner.replace("FROM table", "FROM {table}"), keys=["event_id"]), log).select("event_id", "event_type", F.col("rank").cast("long").alias("rank"))


@query(f"""
SELECT event_id, event_type, 'insert' AS kind, rank
FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM ({STATE_SQL})) WHERE rank <= 3
UNION ALL SELECT event_id, NULL, 'delete', 0 FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0
""")
def sql_transform_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL step over inserts, partial updates, deletes and changes of key."""
    inner = "SELECT event_id, event_type, rank FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM {table}) WHERE rank <= 3"
    return rows(X.Sql(query=inner, keys=["event_id"]), event_changes(spark, sf_dir)).select("event_id", "event_type", F.col("_kind").alias("kind"), F.coalesce(F.col("rank").cast("long"), F.lit(0)).alias("rank"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 10 GROUP BY event_type")
def sql_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [("large", "SELECT * FROM source WHERE value > 10"), ("by_type", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM large GROUP BY event_type")]
    return rows(X.SqlModels(models=models), read(spark, sf_dir, "events"))


@query("SELECT event_id, props, (json_extract_string(props, '$.k'))::DOUBLE AS k FROM events")
def number_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "props", F.col("props").alias("floats", metadata={"canonical": "any"}))
    return rows(X.NumberToFloat(columns=Selector(include=["^floats$"])), e).select("event_id", "props", F.get_json_object("floats", "$.k").cast("double").alias("k"))


# --- change algebra ---------------------------------------------------------------------------------------


@query(f"""
SELECT event_id, 'delete' AS kind, NULL::DOUBLE AS value FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0
UNION ALL SELECT event_id, 'insert', CASE WHEN event_id % 11 = {MOVED} % 11 AND false THEN 0 WHEN base % 3 = 0 THEN value * 2 ELSE value END
FROM (SELECT CASE WHEN event_id % 11 = 0 THEN event_id + {MOVED} ELSE event_id END AS event_id, event_id AS base, value FROM events WHERE event_id % 7 <> 0)
""")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse(event_changes(spark, sf_dir), ["event_id"]).select("event_id", F.col("_kind").alias("kind"), "value")


@query(f"""
SELECT event_id, 'insert' AS kind, 0 AS counter FROM events UNION ALL SELECT event_id, 'update', 0 FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'delete', 0 FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'delete', 0 FROM events WHERE event_id % 11 = 0 AND event_id % 7 <> 0
UNION ALL SELECT event_id + {MOVED}, 'insert', 1 FROM events WHERE event_id % 11 = 0 AND event_id % 7 <> 0
""")
def split_pk_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_key_updates(event_changes(spark, sf_dir), ["event_id"]).select("event_id", F.col("_kind").alias("kind"), F.col("_counter").alias("counter"))


@query(STATE_SQL)
def upsert_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_changes(spark, sf_dir)
    return C.apply_changes(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), log.where(F.col("_lsn") % 10 != 0), ["event_id"])


@query(STATE_SQL)
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state through an append-only table with commit and delete times."""
    log = event_changes(spark, sf_dir)
    filled = C.fill_partial(log, read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"], upsert_absent=True)
    return tables.current_rows(tables.versioned_rows(filled, ["event_id"]), ["event_id"])


@query("SELECT event_id, user_id, event_type, value * 2 AS value FROM events WHERE event_id % 3 = 0")
def toast_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    partial = event_changes(spark, sf_dir).where(F.col("_lsn") % 10 == 1)
    return C.fill_partial(partial, e, ["event_id"]).select("event_id", "user_id", "event_type", "value")


@query("""
SELECT 'taken' AS fate, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT 'skipped', o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 2 <> 0
""")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(5).alias("version"))
    incoming = o.select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, 6).otherwise(5).alias("version"))
    taken, skipped = C.versioned_upsert(o, incoming, ["o_orderkey"], "version")
    return taken.select(F.lit("taken").alias("fate"), "o_orderkey", "o_totalprice").unionByName(skipped.select(F.lit("skipped").alias("fate"), "o_orderkey", "o_totalprice"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'log' WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 'log' ELSE 'chunk' END AS origin FROM events WHERE event_id % 11 <> 0 AND NOT (event_id % 3 = 0 AND event_id % 7 = 0) "
       "UNION ALL SELECT event_id, 'log' FROM events, range(2) WHERE event_id % 11 <> 0 AND event_id % 3 = 0 AND event_id % 7 = 0")
def dblog_chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_id % 11 != 0").select("event_id", "user_id", "event_type", "value")
    log = event_changes(spark, sf_dir).where((F.col("event_id") % 11 != 0) & (F.col("_lsn") % 10).isin(1, 2))
    merged = C.chunk_merge(e, log, ["event_id"], -1, 2**60)
    return merged.select("event_id", F.when(F.col("_table") == "", "chunk").otherwise("log").alias("origin"))


@query(f"""
SELECT event_id, 'chunk' AS origin FROM events WHERE event_id % 3 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0
UNION ALL SELECT event_id, 'log' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'log' FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id + {MOVED}, 'log' FROM events WHERE event_id % 11 = 0 AND event_id % 7 <> 0
""")
def dblog_chunk_merge_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunk and log, changes of key among them; the chunk holds moved rows under both keys, and both give way."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    moved = e.where("event_id % 11 = 0 AND event_id % 7 != 0").withColumn("event_id", F.col("event_id") + MOVED)
    log = event_changes(spark, sf_dir).where((F.col("_lsn") % 10).isin(1, 2, 3))
    merged = C.chunk_merge(e.unionByName(moved), log, ["event_id"], -1, 2**60)
    return merged.select("event_id", F.when(F.col("_table") == "", "chunk").otherwise("log").alias("origin"))


@query("SELECT event_id, '[' || event_id::VARCHAR || ',\"' || event_type || '\"]' AS key FROM events")
def key_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = C.as_changelog(read(spark, sf_dir, "events"), "public", "events")
    return log.select("event_id", C.key_string(log, ["event_type", "event_id"]).alias("key"))


@query("SELECT event_id AS tx_id, 1 + (event_id % 3 = 0)::BIGINT + (event_id % 7 = 0)::BIGINT + (event_id % 11 = 0 AND event_id % 7 <> 0)::BIGINT AS events FROM events")
def transaction_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event and what follows on it are one transaction."""
    log = event_changes(spark, sf_dir).withColumn("_tx_id", F.floor(F.col("_lsn") / 10))
    return C.transactions(log).select(F.col("_tx_id").alias("tx_id"), "events")


@query("SELECT e.event_type AS topic, e.event_id AS \"offset\" FROM events e LEFT JOIN (SELECT event_type, max(event_id) AS done FROM events WHERE event_id < 300 AND event_type <> 'error' GROUP BY event_type) w USING (event_type) WHERE done IS NULL OR e.event_id > done")
def log_after_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log table takes the messages beyond what it holds of their partition; of one topic it holds none."""
    m = read(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"))
    return tables.after_offset(m, m.where("offset < 300 AND topic != 'error'")).select("topic", "offset")


@query("SELECT 'o_orderkey' AS \"column\", count(*) FILTER (o_orderkey NOT BETWEEN -128 AND 127) AS violations FROM orders UNION ALL SELECT 'o_custkey', count(*) FILTER (o_custkey NOT BETWEEN 0 AND 65535) FROM orders")
def strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.strictness(read(spark, sf_dir, "orders"), {"o_orderkey": "int8", "o_custkey": "uint16"})


@query("SELECT event_id, value * 2 AS value FROM events WHERE event_type <> 'click'")
def lambda_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function that drops rows and changes values."""
    step = X.Lambda(function=lambda b: b[b.event_type != "click"].assign(value=lambda x: x.value * 2)[["event_id", "value"]], schema="event_id bigint, value double")
    return rows(step, read(spark, sf_dir, "events"))


@query("SELECT event_id, NOT coalesce(value > 10, false) AS problem FROM events")
def problem_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass a check, and those that are put aside."""
    got = X.ProblemItemDetector(check="value > 10").apply(read(spark, sf_dir, "events"))
    return got.rows.select("event_id", F.lit(False).alias("problem")).unionByName(got.errors.select("event_id", F.lit(True).alias("problem")))


# --- parsers ----------------------------------------------------------------------------------------------


def _json_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines a message: the event, and a broken line for every tenth."""
    e = read(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value", F.struct("user_id").alias("who"), F.lit("x").alias("extra")))
    text = F.concat(line, F.lit("\n"), F.when(F.col("event_id") % 10 == 0, F.lit("{broken\n")).otherwise(F.lit("\n")))
    return M.as_messages(e, "topic", text)


FIELDS = [M.FieldSpec("event_id", "int64", key=True), M.FieldSpec("event_type", "utf8"), M.FieldSpec("value", "double"), M.FieldSpec("user_id", "int64", path="who.user_id")]


@query("SELECT event_id, event_type, value, user_id, 'x' AS extra, 1 AS idx FROM events")
def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.GenericParser(FIELDS, rest=True).parse(_json_messages(spark, sf_dir)).rows
    return got.select("event_id", "event_type", "value", "user_id", F.col("_rest")["extra"].alias("extra"), F.col("_idx").alias("idx"))


@query("SELECT '{broken' AS unparsed_row, 2 AS idx, count(*) AS n FROM events WHERE event_id % 10 = 0")
def jsonl_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = M.GenericParser(FIELDS).parse(_json_messages(spark, sf_dir)).unparsed
    return bad.groupBy("unparsed_row", F.col("_idx").alias("idx")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type || chr(9) || 'x' AS event_type, user_id FROM events")
def tskv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    line = F.concat(F.lit("tskv\tevent_id="), "event_id", F.lit("\tevent_type="), "event_type", F.lit("\\tx\tuser_id="), "user_id")
    fields = [M.FieldSpec("event_id", "int64", key=True), M.FieldSpec("event_type"), M.FieldSpec("user_id", "uint32")]
    return M.GenericParser(fields, format="tskv", unescape=True).parse(M.as_messages(e, "topic", line)).rows.select("event_id", "event_type", "user_id")


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'value is configured as JSON, but it isn''t valid JSON' ELSE '' END AS reason, count(*) AS n FROM events GROUP BY 1")
def raw_to_table_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    got = M.RawToTable().parse(M.as_messages(e, "topic", F.when(F.col("event_id") % 5 == 0, F.lit("{")).otherwise(F.col("props"))))
    good = got.rows.select(F.lit("").alias("reason"))
    return good.unionByName(got.unparsed.select(F.col("failure_reason").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT props AS raw, count(*) AS n FROM events GROUP BY props")
def blank_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.Blank().parse(M.as_messages(read(spark, sf_dir, "events"), "t", F.col("props"))).rows
    return got.groupBy(F.col("raw_message").cast("string").alias("raw")).agg(F.count("*").alias("n"))


@query("SELECT op, count(*) AS n FROM (SELECT 'c' AS op FROM events UNION ALL SELECT 'u' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT unnest(['d', 'tombstone']) FROM events WHERE event_id % 7 = 0 "
       "UNION ALL SELECT unnest(['d', 'tombstone', 'c']) FROM events WHERE event_id % 11 = 0 AND event_id % 7 <> 0) GROUP BY op")
def debezium_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serialize.debezium(event_changes(spark, sf_dir), ["event_id"])
    return out.groupBy(F.coalesce(F.get_json_object("value", "$.op"), F.lit("tombstone")).alias("op")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, value, 'insert' AS kind FROM events")
def debezium_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    sent = serialize.debezium(C.as_changelog(e, "public", "events"), ["event_id"])
    back = M.Debezium(e.schema, ["event_id"]).parse(M.as_messages(sent, "t", F.col("value"), F.col("key"))).rows
    return back.select("event_id", "event_type", "value", F.col("_kind").alias("kind"))


#: Envelopes of orders as text: the schema block, then the values in Connect's forms.
_ORDER_FIELDS = ('{"type":"int64","optional":false,"field":"o_orderkey"},{"type":"string","optional":true,"field":"o_orderstatus"},'
                 '{"type":"bytes","name":"org.apache.kafka.connect.data.Decimal","version":1,"parameters":{"scale":"2","connect.decimal.precision":"15"},"optional":true,"field":"price"},'
                 '{"type":"int32","name":"io.debezium.time.Date","version":1,"optional":true,"field":"day"}')
_ORDER_SCHEMA = ('{"type":"struct","fields":[' + "".join(f'{{"type":"struct","fields":[{_ORDER_FIELDS}],"optional":true,"name":"o.Value","field":"{side}"}},' for side in ("before", "after"))
                 + '{"type":"struct","fields":[' + ",".join(f'{{"type":"{t}","optional":true,"field":"{n}"}}' for n, t in (("lsn", "int64"), ("txId", "int64"), ("schema", "string"), ("table", "string")))
                 + '],"optional":false,"name":"o.Source","field":"source"},{"type":"string","optional":false,"field":"op"},{"type":"int64","optional":true,"field":"ts_ms"}],"optional":false,"name":"o.Envelope"}')


@query(rf"""
WITH cents AS (SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS day, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * round(o_totalprice * 100))::BIGINT AS n FROM orders),
digits AS (SELECT *, CASE WHEN n < 0 THEN regexp_replace(hex(n), '^(FF)+([89A-F])', '\2') ELSE regexp_replace(lpad(hex(n), 16, '0'), '^(00)+([0-7])', '\2') END AS h FROM cents)
SELECT '{{"schema":{{"type":"struct","fields":[{{"type":"int64","optional":false,"field":"o_orderkey"}}],"optional":false,"name":"o.Key"}},"payload":{{"o_orderkey":' || o_orderkey || '}}}}' AS key,
       '{{"schema":{_ORDER_SCHEMA},"payload":{{"before":null,"after":{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","price":"' || base64(unhex(h))
       || '","day":' || date_diff('day', DATE '1970-01-01', day) || '}},"source":{{"lsn":0,"txId":0,"schema":"public","table":"orders"}},"op":"r","ts_ms":0}}}}' AS value
FROM digits
""")
def debezium_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole keys and envelopes with their schema blocks."""
    price = F.round(F.col("o_totalprice") * 100).cast("decimal(15,0)") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (price / 100).cast("decimal(15,2)").alias("price"), F.col("o_orderdate").cast("date").alias("day"))
    sent = serialize.debezium(C.as_changelog(o, "public", "orders"), ["o_orderkey"], snapshot=True, forms=serialize.ConnectForms(), name="o")
    return sent.select("key", "value")


@query("SELECT event_id, event_type, value FROM events")
def native_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = C.as_changelog(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "public", "events")
    return M.Native(log.schema).parse(M.as_messages(serialize.native(log), "t", F.col("value"))).rows.select("event_id", "event_type", "value")


@query("SELECT event_id, event_type FROM events")
def schema_registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.unhex(F.lit("0000000007")), F.to_json(F.struct("event_id", "event_type")).cast("binary"))
    got = M.SchemaRegistryJson({7: "event_id bigint, event_type string"}).parse(M.as_messages(read(spark, sf_dir, "events"), "t", body))
    return got[7].rows.select("event_id", "event_type")


@query(
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'row' WHEN 1 THEN 'the body is no JSON object' WHEN 2 THEN 'unknown schema 9'
                     ELSE 'no head of a zero byte and a schema''s number' END AS reason FROM events
    """
)
def schema_registry_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good messages, and those with a broken body, an unknown schema and no head: each is a row or unparsed, none is lost."""
    json_body = F.to_json(F.struct("event_id"))
    head = F.when(F.col("event_id") % 4 == 2, F.unhex(F.lit("0000000009"))).when(F.col("event_id") % 4 == 3, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("0000000007")))
    text = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("{"), json_body)).otherwise(json_body)
    got = M.SchemaRegistryJson({7: "event_id bigint"}).parse(M.as_messages(read(spark, sf_dir, "events"), "t", F.concat(head, text.cast("binary"))))
    number = F.regexp_extract(F.decode("value", "ISO-8859-1"), r'event_id":(\d+)', 1).cast("bigint").alias("event_id")
    bad = got[7].unparsed.unionByName(got[None].unparsed).select(number, "reason")
    return got[7].rows.select("event_id", F.lit("row").alias("reason")).unionByName(bad)


# --- snapshots, samples, checks ---------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= (SELECT max(o_orderdate) FROM orders)")
def incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.incremental_window(read(spark, sf_dir, "orders"), parts.Cursor("o_orderdate", "timestamp", "1996-01-01 00:00:00"))[0]


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def shard_union_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cut = None
    for where in parts.key_ranges(o, "o_orderkey", 8):
        cut = o.where(where) if cut is None else cut.unionByName(o.where(where))
    return cut.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT abs(o_orderkey % 7)::INTEGER AS shard, count(*) AS n FROM orders GROUP BY 1")
def hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.hash_shard(read(spark, sf_dir, "orders"), ["o_orderkey"], 7).groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("n"))


@query("(SELECT * FROM customer ORDER BY c_custkey LIMIT 100) UNION ALL (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 100)")
def top_bottom_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a sample of so many rows from either end."""
    return parts.top_bottom(read(spark, sf_dir, "customer"), ["c_custkey"], 100)


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def sample_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return parts.by_keys(read(spark, sf_dir, "orders"), wanted, ["o_custkey"]).select(*read(spark, sf_dir, "orders").columns)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'missing right' ELSE 'values' END AS difference FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0")
def checksum_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    other = o.where("o_orderkey % 97 != 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") * (1 + 1e-15)))
    return compare(o, other, ["o_orderkey"]).differences.select("o_orderkey", "difference")


# --- sinks ------------------------------------------------------------------------------------------------


@query("SELECT strftime(ts, '%Y/%m/%d') AS bucket, count(*) AS n FROM events GROUP BY 1")
def s3_layout_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialize.time_bucket(read(spark, sf_dir, "events"), "day", "ts").groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT 'events/' || strftime(date_trunc('month', ts) + to_days(((day(ts) - 1) - (day(ts) - 1) % 5)::INTEGER), '%Y-%m-%d') AS name, count(*) AS n FROM events GROUP BY 1")
def rotator_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = serialize.rotated_table(F.lit("events"), F.col("ts"), "d", 5)
    return read(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, coalesce(n_name, '') AS n_name FROM nation")
def csv_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialize.for_csv(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') || 'Z"}' AS value FROM events""")
def jsonl_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialize.to_jsonl(read(spark, sf_dir, "events").select("event_id", "event_type", "ts"))


@query("SELECT p_partkey, p_retailprice FROM part")
def parquet_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles go out as text and come back unchanged."""
    out = serialize.for_parquet(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"))
    return out.select("p_partkey", F.col("p_retailprice").cast("double").alias("p_retailprice"))


# --- relational operators, Spark's own ----------------------------------------------------------------------


def _sql(name: str, sql: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if f" {t}" in sql:
                read(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    QUERIES[name], ORACLE[name] = run, oracle or sql


_sql("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("join_full", "SELECT coalesce(s_suppkey, c_custkey) AS k, s_suppkey IS NULL AS no_supplier FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey")
_sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("join_theta", "SELECT a.n_nationkey AS a_key, b.r_regionkey AS b_key FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey")
_sql("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("agg_distinct", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
_sql("window_rank", "SELECT o_orderkey, o_custkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders")
_sql("window_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events")
_sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.streaming.replicate import windowed_counts

    return windowed_counts(read(spark, sf_dir, "events"), "ts", "1 hour", by=["event_type"], value=F.col("value")).withColumn("total", F.round("total", 4))
