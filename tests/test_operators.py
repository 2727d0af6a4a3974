"""Exact semantics of the transforms, the filter notation, the change algebra and the writers."""

import datetime
import hashlib
import hmac
import zlib

import pytest
from pyspark.sql import functions as F

from millrace import changelog as C
from millrace.functions.text import fnv32a, go_template, hmac_sha256, plain_number, rfc3339, unescape_tskv
from millrace.operators import transforms as X
from millrace.operators.checksum import compare, sampled_compare
from millrace.operators.predicate import Term, Unsuitable, compile_filters, parse
from millrace.operators.selectors import Selector
from millrace.plans.chain import build, run_chain
from millrace.plans.transfer import Table, Transfer
from millrace.schema import SPARK_TYPES, TableId, field, schema_hash, strictify, strictness, try_strictify, with_keys
from millrace.sinks import serialize
from millrace.sinks.tables import KeyedTable, after_offset, append_only_guard
from millrace.sources import files, messages, parts

T1 = TableId("public", "t")


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def log(spark, rows):
    """rows: (lsn, kind, i1, i2, t, present, old)"""
    df = spark.createDataFrame(rows, "_lsn bigint, _kind string, i1 int, i2 int, t string, _present array<string>, _old struct<i1:int,i2:int,t:string>")
    return df.withColumn("_counter", F.lit(0)).withColumn("_commit_ts_ns", F.col("_lsn"))


# --- functions


@pytest.mark.parametrize("x,shown", [(1.0, "1"), (0.5, "0.5"), (1e7, "10000000"), (1.5e7, "15000000"), (123456789.25, "123456789.25"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-4, "0.0001"), (1e-5, "1e-05"), (-2.5e-7, "-2.5e-07"), (1.25e100, "1.25e+100"), (0.0, "0"), (float("nan"), "NaN")])
def test_plain_number(spark, x, shown):
    assert values(spark.createDataFrame([(x,)], "x double"), plain_number(F.col("x"))) == [shown]


def test_rfc3339(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05.120' AS t UNION ALL SELECT timestamp'2024-01-02 03:04:00'")
    assert sorted(values(df, rfc3339(F.col("t")))) == ["2024-01-02T03:04:00Z", "2024-01-02T03:04:05.12Z"]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_hmac(spark, key):
    got = values(spark.createDataFrame([("message",)], "m string"), hmac_sha256(F.col("m"), key))
    assert got == [hmac.new(key, b"message", hashlib.sha256).hexdigest()]


def test_fnv_and_escapes(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string")
    assert values(df, fnv32a(F.col("s"))) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    df = spark.createDataFrame([(r"a\tb\\n\=",), (r"bad\q\t",)], "s string")
    assert values(df, unescape_tskv(F.col("s"))) == ["a\tb\\n=", r"bad\q\t"]
    assert go_template("<${1}$2>") == "<$1$2>" and go_template("$1x") == ""


def test_types(spark):
    df = spark.createDataFrame([("1",), ("300",), ("x",), (None,), ("1.5",)], "s string")
    assert values(df, try_strictify(F.col("s"), "uint8")) == [1, None, None, None, None] or values(df, try_strictify(F.col("s"), "uint8"))[:2] == [1, None]
    assert {r["column"]: r["violations"] for r in strictness(df, {"s": "int16"}).collect()}["s"] >= 1
    with pytest.raises(Exception, match="not a value of int8"):
        df.where("s = '300'").select(strictify(F.col("s"), "int8")).collect()
    assert schema_hash(df.schema) == schema_hash(df.schema) and SPARK_TYPES["uint64"].precision == 20
    assert TableId("", "*").includes(T1) and TableId("a", 'b"c').quoted() == '"a"."b""c"'


# --- filters


def test_filter_notation():
    assert parse('a = 1 AND b != "x AND y" and c IN (1, 2) AND d ~ \'q\' AND e != NULL') == [Term("a", "=", 1), Term("b", "!=", "x AND y"), Term("c", "IN", [1, 2]), Term("d", "~", "q"), Term("e", "!=", None)]
    assert parse("t >= 2024-01-01T00:00:00Z")[0].value == datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    for bad in ("a =", "a = 1 AND", "a = 1 b = 2"):
        with pytest.raises(ValueError):
            parse(bad)


def test_filter_rows(spark):
    df = spark.createDataFrame([(1, "str", None), (2, "str", None), (3, None, 32), (4, None, None)], "column1 int, column2 string, column3 int")
    assert values(X.FilterRows(filter="column1 > 1 AND column2 != NULL AND column3 = NULL").apply(df).rows, "column1") == [2]
    assert values(X.FilterRows(filters=["column3 = 0"]).apply(df).rows, "column1") == [1, 2, 4]  # a null is 0 beside a number
    got = X.FilterRows(filters=['column2 = "str"']).apply(df)
    assert values(got.rows, "column1") == [1, 2] and values(got.errors, "column1") == [3, 4]
    assert not X.FilterRows(filter="nope = 1").suits(T1, df.schema) and not X.FilterRows(filter="column1 = true").suits(T1, df.schema)
    with pytest.raises(ValueError):
        X.FilterRows(filter="a = 1", filters=["b = 1"])
    with pytest.raises(Unsuitable):
        compile_filters(["column1 < NULL"], df.schema)


def test_filter_rows_kinds(spark):
    df = log(spark, [(1, "insert", 1, 1, "a", None, None), (2, "update", 1, 1, "b", None, None), (3, "insert", 5, 1, "c", None, None), (4, "truncate", None, None, None, None, None)])
    got = X.FilterRows(filter="i1 > 3").apply(df)
    assert sorted(values(got.rows, "_lsn")) == [3, 4] and values(got.errors, "_lsn") == [2]


def test_filter_numbers(spark):
    df = spark.createDataFrame([(10.09,), (10.1,), (15.0,), (15.3,)], "f double")
    assert values(X.FilterRows(filter="f >= 10.1 AND f < 15.3").apply(df).rows, "f") == [10.1, 15.0]
    assert values(X.FilterRows(filter="f IN (15, 10)").apply(df).rows, "f") == [15.0]
    big = spark.sql("SELECT cast(18446744073709551615 AS decimal(20,0)) AS u")
    assert X.FilterRows(filter="u > 5").apply(big).errors.count() == 1


def test_pushdown(spark):
    plan = X.FilterRows(filter="event_id > 5").apply(spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id"))
    shown = plan.rows._jdf.queryExecution().toString()
    assert "PushedFilters" in shown


# --- transforms


def test_columns_and_keys(spark):
    df = with_keys(spark.createDataFrame([(1, "a", 2)], "id int, name string, other int"), ["id"])
    assert X.FilterColumns(columns=Selector(include=["^id$", "name"])).apply(df).rows.columns == ["id", "name"]
    assert not X.FilterColumns(columns=Selector(exclude=["^id$"])).suits(T1, df.schema)
    out = X.ReplacePrimaryKey(keys=["other", "name"]).apply(df).rows
    assert out.columns == ["other", "name", "id"] and out.schema["other"].metadata["key"] and "key" not in out.schema["id"].metadata
    with pytest.raises(ValueError):
        X.ReplacePrimaryKey(keys=["a", "a"])


def test_text_transforms(spark):
    df = spark.createDataFrame([(1, "abc", None, b"x"), (2, None, 1.5, None)], "id int, s string, f double, b binary")
    got = X.ConvertToString().apply(df).rows.orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "abc", "<nil>", "x"), ("2", "<nil>", "1.5", "<nil>")]
    masked = values(X.MaskField(columns=["s"], salt="s").apply(df).rows.orderBy("id"), "s")
    assert masked == [hmac.new(b"s", m, hashlib.sha256).hexdigest() for m in (b"abc", b"<nil>")]
    assert values(X.RegexReplace(columns=Selector(include=["s"]), pattern="(b)(c)", replacement="$2$1").apply(df).rows.orderBy("id"), "s") == ["acb", None]
    assert values(X.Sharder(columns=Selector(include=["^id$", "^s$"]), shards=7).apply(df).rows.orderBy("id"), "_part_id") == [str(zlib.crc32(m) % 7) for m in (b"1.abc", b"2.<nil>")]
    assert values(X.ConvertToDatetime(columns=Selector(include=["id"])).apply(df).rows.orderBy("id"), F.unix_timestamp("id")) == [1, 2]
    for n in (0, 1):
        got = X.FilterRowsByIds(columns=Selector(include=["^s$"]), ids=["ab", "q"], join_from=n * 1000).apply(df).rows
        assert values(got, "id") == [1]


def test_ids_keep_control_events(spark):
    """Both branches keep a changelog's control events, one that starts with an id just once."""
    df = spark.createDataFrame([(1, "insert", "abc"), (2, "update", "xyz"), (3, "commit", None), (4, "commit", "abz"), (5, "delete", "q"), (6, None, "xyz"), (7, None, "abc")], "id int, _kind string, s string")
    for join_from in (0, 1000):
        got = X.FilterRowsByIds(columns=Selector(include=["^s$"]), ids=["ab", "q"], join_from=join_from).apply(df).rows
        assert sorted(values(got, "id")) == [1, 3, 4, 5, 7] and got.columns == df.columns


def test_documents(spark):
    df = C.as_changelog(spark.sql("SELECT 1 AS id, 'a' AS v, map('k', 'w') AS _rest"), "s", "t")
    doc = values(X.RawDocGrouper(keys=["id"]).apply(df).rows, "doc")[0]
    assert doc == '{"id":1,"v":"a","k":"w"}'
    out = X.NumberToFloat().apply(spark.createDataFrame([('{"a":[1,{"b":2}],"c":true}',)], "j string").select(F.col("j").alias("j", metadata={"canonical": "any"}))).rows
    assert values(out, "j") == ['{"a":[1.0,{"b":2.0}],"c":true}']
    assert values(X.Composites().apply(spark.sql("SELECT array(struct('a' AS k, 1 AS v)) AS d, array(1) AS l")).rows, "d") == ['{"a":1}']
    ext = X.MongoKeyExtender(discriminators={"s": "one"})
    there = ext.apply(C.as_changelog(spark.sql("SELECT 'x' AS _id"), "s", "t")).rows
    assert values(X.MongoKeyExtender(expand=False).apply(there).rows, "_id") == ["x"]


def test_chain_and_transfer(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    got = run_chain(df, T1, build([{"filter_rows": {"filter": "id > 1"}}, {"filter_rows": {"filter": "missing = 1"}}, {"rename_tables": {"renames": {}, "tables": Selector(include=["other"])}}]))
    assert values(got.rows, "id") == [2]
    with pytest.raises(ValueError):
        build([{"no_such": {}}])
    seen = {}
    t = Transfer.from_text('{"transforms": [{"filter_rows": {"filter": "s = \\"a\\""}}], "errors": "sink"}', [Table(T1, lambda s: df, "id < 9")])
    t.activate(spark, lambda table, rows: seen.__setitem__(table.name, rows.count()))
    assert seen["t"] == 1
    with pytest.raises(ValueError):
        Transfer.from_text('{"nope": 1}', [])


def test_sql_transform(spark):
    df = with_keys(C.as_changelog(spark.createDataFrame([(1, 5), (2, 7)], "id int, v int"), "s", "t"), ["id"])
    got = X.Sql(query="SELECT id, v * 2 AS v FROM {table} UNION ALL SELECT 9, 9").apply(df)
    assert sorted(values(got.rows, "v")) == [10, 14] and values(got.errors, "id") == [9]
    with pytest.raises(Unsuitable):
        X.Sql(query="SELECT v FROM {table}").apply(df)


def test_sql_transform_collapses(spark):
    """Several events of a key are one row of the view; control events pass and join nothing."""
    rows = [(1, "insert", 1, 5, "a", None, None), (2, "update", 1, 6, "b", None, None), (3, "update", 1, 7, "c", None, None), (4, "insert", 2, 8, "d", None, None), (5, "delete", None, None, None, None, (2, None, None)), (6, "commit", None, None, None, None, None), (7, "commit", None, None, None, None, None)]
    got = X.Sql(query="SELECT i1, i2 + 1 AS i2 FROM {table}", keys=["i1"]).apply(log(spark, rows))
    assert sorted(((r._lsn, r._kind, r.i1, r.i2) for r in got.rows.collect()), key=str) == [(3, "insert", 1, 8), (5, "delete", 2, None), (6, "commit", None, None), (7, "commit", None, None)]
    assert got.errors.count() == 0


# --- change algebra

OLD = lambda i, j: (i, j, None)


def test_collapse_cases(spark):
    first = log(spark, [(1, "insert", 2, 2, "b", None, None), (2, "update", 2, 2, "c", None, OLD(2, 2)), (3, "delete", None, None, None, None, OLD(2, 2))])
    assert [(r._kind, r.i1, r.i2) for r in C.collapse(first, ["i1", "i2"]).collect()] == [("delete", 2, 2)]
    moved = log(spark, [(1, "insert", 1, 1, "a", None, None), (2, "update", 1, 1, "b", None, OLD(1, 1)), (3, "update", 2, 2, "b", None, OLD(1, 1)), (4, "update", 2, 2, "c", None, OLD(2, 2))])
    assert {(r._kind, r.i1, r.i2, r.t) for r in C.collapse(moved, ["i1", "i2"]).collect()} == {("delete", 1, 1, None), ("insert", 2, 2, "c")}
    plain = log(spark, [(1, "insert", 1, 1, "a", None, None), (2, "insert", 1, 1, "b", None, None)])
    assert C.collapse(plain, ["i1", "i2"]).count() == 2
    partial = log(spark, [(1, "update", 1, 1, None, ["i1", "i2"], None), (2, "update", 1, 1, None, ["i1", "i2", "t"], None)])
    got = C.collapse(partial, ["i1", "i2"]).collect()[0]
    assert got._kind == "update" and sorted(got._present) == ["i1", "i2", "t"] and got.t is None
    again = C.collapse(first.unionByName(moved), ["i1", "i2"])
    assert sorted(map(str, C.collapse(again, ["i1", "i2"]).select("_kind", "i1", "i2", "t").collect())) == sorted(map(str, again.select("_kind", "i1", "i2", "t").collect()))
    assert C.collapse(first.limit(0), ["i1", "i2"]).count() == 0


def test_apply_and_versions(spark, tmp_path):
    now = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c")], "i1 int, i2 int, t string")
    changes = log(spark, [(1, "update", 1, 1, None, ["i1", "i2"], None), (2, "delete", None, None, None, None, OLD(2, 2)), (3, "insert", 4, 4, "d", None, None), (4, "update", 5, 5, "c", None, OLD(3, 3))])
    got = C.apply_changes(now, changes, ["i1", "i2"])
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a"), (4, 4, "d"), (5, 5, "c")]
    table = KeyedTable(spark, str(tmp_path / "t"), ["i1", "i2"])
    table.replace(now)
    table.upsert(changes, "batch-1")
    table.upsert(changes, "batch-1")
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, got.collect())) and table.version() == 1
    skipped = table.upsert_versioned(spark.createDataFrame([(1, 1, "Z"), (4, 4, "a")], "i1 int, i2 int, t string"), "t")
    assert values(skipped, "t") == ["Z", "a"] or values(skipped, "__stored_version") is not None
    with pytest.raises(Exception, match="append-only"):
        append_only_guard(changes).collect()


def test_partial_needs_row(spark):
    now = spark.createDataFrame([(1, 1, "a")], "i1 int, i2 int, t string")
    changes = log(spark, [(1, "update", 9, 9, None, ["i1", "i2"], None)])
    with pytest.raises(Exception, match="no stored row"):
        C.fill_partial(changes, now, ["i1", "i2"]).collect()
    assert C.fill_partial(changes, now, ["i1", "i2"], upsert_absent=True).count() == 1


# --- parsers, files


def test_generic_parser(spark):
    lines = '{"id": 1, "n": "7", "a": {"b": "{\\"c\\": 5}"}, "x": 1}\n\n{"n": 300}\nnope\n{"id": 18446744073709551615, "n": 3}'
    df = messages.as_messages(spark.createDataFrame([(lines,)], "v string"), "t", F.col("v"))
    spec = [messages.FieldSpec("id", "uint64", key=True), messages.FieldSpec("n", "uint8"), messages.FieldSpec("c", "int32", path="a.b.c")]
    got = messages.GenericParser(spec, rest=True).parse(df)
    rows = got.rows.orderBy("id").collect()
    assert [(int(r.id), r.n, r.c) for r in rows] == [(1, 7, 5), (18446744073709551615, 3, None)] and rows[0]._rest["x"] == "1" and rows[0]._idx == 1
    assert sorted((r._idx, r.reason) for r in got.unparsed.collect()) == [(2, "no value for id"), (3, "not a valid line")]


def test_protobuf(spark):
    from millrace.sources import protobuf as P

    event = b"\x0a\x02id\x12\x01s\x22\x01t" + b"\x2a\x0d\x0a\x07subject\x12\x02\x1a\x00" + b'\x3a\x02{}'
    plain = b"\x08\x96\x01\x10\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01\x1a\x02\x01\x02\x25\x00\x00\x80\x3f"
    fields = (P.ProtoField(1, "a", "uint64"), P.ProtoField(2, "b", "int32"), P.ProtoField(3, "c", "uint32", repeated=True), P.ProtoField(4, "f", "float"))
    rows = [(1, plain), (2, plain[:-1]), (3, len(plain).to_bytes(4, "little") + plain + P.SEQUENCE_MARK), (4, event)]
    df = messages.as_messages(spark.createDataFrame(rows, "k int, v binary"), "t", F.col("v")).withColumn("k", F.monotonically_increasing_id())
    at = lambda i: messages.as_messages(spark.createDataFrame([rows[i]], "k int, v binary"), "t", F.col("v"))
    got = P.Protobuf(fields).parse(at(0).unionByName(at(1)))
    assert [(int(r.a), r.b, r.c, r.f) for r in got.rows.collect()] == [(150, -1, "[1, 2]", 1.0)] and got.unparsed.count() == 1
    assert P.Protobuf(fields, framing="sequence").parse(at(2)).rows.count() == 1 and df.count() == 4
    r = P.CloudEvents().parse(at(3)).rows.collect()[0]
    assert (r.id, r.source, r.type, r.payload) == ("id", "s", "t", "{}")


def test_cloud_log(spark):
    line = '{"timestamp": "2024-01-01T00:00:00Z", "uid": "u", "resource": {"id": 1}, "level": "INFO"}'
    got = messages.cloud_log().parse(messages.as_messages(spark.createDataFrame([(line + "\n{}",)], "v string"), "t", F.col("v")))
    assert values(got.rows, "level") == ["INFO"] and got.unparsed.count() == 1


def test_raw_to_table(spark):
    df = spark.createDataFrame([("t", 0, 1, bytearray(b"k"), bytearray(b"{}")), ("t", 0, 2, bytearray(b"\xff"), bytearray(b"{"))], "topic string, partition int, offset long, key binary, value binary").withColumn("timestamp", F.current_timestamp())
    got = messages.RawToTable().parse(df)
    assert values(got.rows, "offset") == [1] and values(got.unparsed, "failure_reason")[0].count("|") == 1
    assert values(after_offset(df, df.where("offset = 1")), "offset") == [2]


def test_debezium_tombstones(spark):
    df = log(spark, [(1, "insert", 1, 1, "a", None, None), (2, "update", 2, 2, "a", None, OLD(1, 1)), (3, "delete", None, None, None, None, OLD(2, 2))])
    for c in ("_tx_id", "_schema", "_table"):
        df = df.withColumn(c, F.lit(1).cast("long") if c == "_tx_id" else F.lit("x"))
    got = serialize.debezium(df, ["i1", "i2"]).orderBy("_lsn", "seq").select(F.get_json_object("value", "$.op")).collect()
    assert [r[0] for r in got] == ["c", "d", None, "c", "d", None]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,flag,js\n1,x,true,"{""a"": 1}"\n2,,false,\n')
    got = files.read_csv(spark, str(tmp_path / "a.csv"), files.CsvOptions(escape='"')).rows
    assert dict(got.dtypes) == {"id": "double", "name": "string", "flag": "boolean", "js": "string"} and values(got, "id") == [1.0, 2.0]
    (tmp_path / "b.jsonl").write_text('{"b": 1, "a": "2024-01-01T00:00:00Z", "o": {"x": 1}}\n{"b": 2, "new": 5}\nbroken\n')
    got = files.read_jsonl(spark, str(tmp_path / "b.jsonl"))
    assert dict(got.rows.dtypes)["a"] == "timestamp" and got.unparsed.count() == 1 and got.rows.where("_rest['new'] = '5'").count() == 1
    (tmp_path / "c.log").write_text('1.2.3.4 - - [10/Jan/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 5\nbad\n')
    got = files.read_nginx(spark, str(tmp_path / "c.log"), '$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent')
    assert values(got.rows, "status") == [200] and got.unparsed.count() == 1
    assert files.estimate_rows(spark, str(tmp_path / "b.jsonl")) == 3
    assert files.with_file_columns(spark.read.text(str(tmp_path / "b.jsonl")), True).agg(F.max("__row_index")).first()[0] == 3
    assert files.sample_iot(spark, 10).count() == 10 and files.sample_activities(spark, 5).count() == 5


def test_delta(spark, tmp_path):
    d = tmp_path / "d"
    for k in (0, 1):
        spark.createDataFrame([(k,)], "id int").coalesce(1).write.mode("append").parquet(str(d))
    names = sorted(p.name for p in d.glob("*.parquet"))
    (d / "_delta_log").mkdir()
    schema = '{\\"type\\":\\"struct\\",\\"fields\\":[{\\"name\\":\\"id\\",\\"type\\":\\"integer\\",\\"nullable\\":true,\\"metadata\\":{}}]}'
    (d / "_delta_log" / "00000000000000000000.json").write_text('{"metaData":{"schemaString":"%s","partitionColumns":[]}}\n' % schema + "".join('{"add":{"path":"%s","partitionValues":{}}}\n' % n for n in names))
    (d / "_delta_log" / "00000000000000000001.json").write_text('{"remove":{"path":"%s"}}\n' % names[0])
    assert files.read_delta(spark, str(d)).count() == 1 and files.read_delta(spark, str(d), version=0).count() == 2
    point = spark.sql(f"SELECT struct('{names[1]}' AS path, map('', '') AS partitionValues) AS add, CAST(NULL AS struct<path:string>) AS remove, struct('{schema}' AS schemaString, CAST(array() AS array<string>) AS partitionColumns) AS metaData")
    point.coalesce(1).write.parquet(str(tmp_path / "cp"))
    next((tmp_path / "cp").glob("*.parquet")).rename(d / "_delta_log" / "00000000000000000001.checkpoint.parquet")
    (d / "_delta_log" / "00000000000000000000.json").unlink()
    assert files.read_delta(spark, str(d)).count() == 1


def test_parts(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    ranges = parts.key_ranges(df, "k", 4)
    assert len(ranges) == 4 and sum(df.where(r).count() for r in ranges) == 100
    window, cursor = parts.incremental_window(df, parts.Cursor("k", "bigint", "89"))
    assert window.count() == 10 and cursor.value == "99" and parts.incremental_window(df, cursor)[0].count() == 0
    parts.save_cursors(spark, str(tmp_path / "c"), {"t": cursor})
    assert parts.load_cursors(spark, str(tmp_path / "c")) == {"t": cursor}
    assert parts.hash_shard(df, ["k"], 3).select("__shard").distinct().count() == 3


def test_checksum(spark):
    a = spark.createDataFrame([(1, 1.0, '{"a": 1}'), (2, 2.0, "x"), (3, None, None)], "id int, f double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-15, '{"a":1}'), (2, 2.1, "x"), (4, None, None)], "id int, f double, s string")
    got = {r.id: (r.difference, r.columns) for r in compare(a, b, ["id"]).differences.collect()}
    assert got == {2: ("values", ["f"]), 3: ("missing right", None), 4: ("missing left", None)}
    assert sampled_compare(a, a, ["id"]).differences.count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, b"\x01", 0.5)], "id int, s string, b binary, f double")
    for form in ("csv", "jsonl", "parquet"):
        serialize.write_files(df, str(tmp_path / form), form)
    assert spark.read.text(str(tmp_path / "jsonl")).first()[0] == '{"id":1,"s":null,"b":"AQ==","f":0.5}'
    assert dict(spark.read.parquet(str(tmp_path / "parquet")).dtypes)["f"] == "string"
    serialize.write_files(df, str(tmp_path / "by"), "jsonl", by=["id"])
    assert (tmp_path / "by" / "id=1").exists()
    m = spark.createDataFrame([("t", 0, 7), ("t", 0, 12)], "topic string, partition int, offset long")
    assert values(serialize.queue_files(m, 5), "file") == ["t/partition=0/t+0+5", "t/partition=0/t+0+10"]
    t = spark.sql("SELECT timestamp'2024-05-31 17:20:00' AS t")
    name = lambda unit, size: values(t, serialize.rotated_table(F.lit("x"), F.col("t"), unit, size))[0]
    assert (name("h", 5), name("d", 7), name("m", 4)) == ("x/2024-05-31T15:00:00", "x/2024-05-29", "x/2024-05")


# --- nothing is lost


def test_schema_registry_keeps_bad_messages(spark):
    frames = [b"\0\0\0\0\x07" + b'{"a": 1}', b"\0\0\0\0\x07" + b'{"a": ', b"\0\0\0\0\x09" + b"{}", b"abc", b"\x01\0\0\0\x07{}", None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "id long, v binary")
    sent = df.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit(None).cast("binary").alias("key"), F.col("v").alias("value"), F.current_timestamp().alias("timestamp"))
    got = messages.SchemaRegistryJson({7: "a int"}).parse(sent)
    assert [(r.offset, r.a) for r in got[7].rows.collect()] == [(0, 1)]
    assert values(got[7].unparsed, "offset") == [1] and sorted(values(got[None].unparsed, "offset")) == [2, 3, 4, 5]


def test_csv_skips_each_files_first_lines_only(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.csv").write_text(f"junk\nx,y\n1,{n}\njunk,junk\nx,y\n")
    got = files.read_csv(spark, str(tmp_path), files.CsvOptions(skip_rows=1, names=["x", "y"]))
    assert got.rows.count() == 8
    headed = files.read_csv(spark, str(tmp_path), files.CsvOptions(skip_rows=1))
    assert sorted(map(str, (r.y for r in headed.rows.collect()))) == ["a", "b", "junk", "junk", "y", "y"]


def test_csv_broken_lines_can_be_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n2,c,d\n")
    got = files.read_csv(spark, str(tmp_path))
    assert [r.unparsed_row for r in got.unparsed.collect()] == ["2,c,d"] and got.rows.count() == 1


def test_chunk_merge_keeps_presence(spark):
    chunk = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    log = C.as_changelog(spark.createDataFrame([(1, "z", None)], "id int, v string, w string"), "", "").withColumn("_kind", F.lit("update")).withColumn("_lsn", F.lit(5).cast("bigint"))
    log = log.withColumn("_present", F.array(F.lit("id"), F.lit("v"))).withColumn("_old", F.lit(None).cast("struct<id:int>"))
    got = {r.id: r for r in C.chunk_merge(chunk, log, ["id"], 0, 9).collect()}
    assert got[1]._present == ["id", "v"] and got[1].v == "z" and got[2]._present is None and got[2].w == "y"


def test_sql_may_start_with_with(spark):
    df = spark.createDataFrame([(1, 2)], "id int, v int")
    assert [tuple(r) for r in X.Sql(query="WITH t AS (SELECT id, v + 1 AS v FROM table) SELECT * FROM t").apply(df).rows.collect()] == [(1, 3)]


def test_text_edges(spark):
    row = spark.range(1).select(unescape_tskv(F.lit("a\u0001\\\\n\\n\\\\")).alias("t")).first()
    assert row.t == "a\u0001\\n\n\\"
    with pytest.raises(Exception, match="not a value of int32"):
        spark.createDataFrame([(1.5,)], "x double").select(strictify(F.col("x"), "int32")).collect()


def test_debezium_schema_and_types(spark):
    """Envelopes with a schema block: decimals against Python's bytes, and there and back in each form."""
    import base64
    import datetime
    import decimal
    import json

    from millrace.sources import messages as M

    whole = [0, 1, -1, 127, 128, -128, -129, 255, 256, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 2**64, -(2**64), 10**38 - 1, 1 - 10**38, None]
    rows = []
    for i, v in enumerate(whole):
        d = None if v is None else decimal.Decimal(v).scaleb(-2, decimal.Context(prec=40))
        t = None if i == 4 else datetime.datetime(1969 + i, 3, 10, 2, 30, 0, i * 1000)
        rows.append((i, d, t, datetime.date(1960 + i, 1, 1), bytes([0, 255, i]), i / 3, [i, None], "a\"'\n"))
    df = spark.createDataFrame(rows, "id bigint, d decimal(38,2), t timestamp_ntz, day date, b binary, x double, `a-b` array<int>, s string")
    for forms in (serialize.ConnectForms(), serialize.ConnectForms("string", "connect", "hex")):
        sent = serialize.debezium(C.as_changelog(df, "public", "t"), ["id"], forms=forms, name="srv.public.t")
        found = {json.loads(r.key)["payload"]["id"]: json.loads(r.value) for r in sent.collect()}
        assert {f["field"] for f in found[0]["schema"]["fields"]} == set(found[0]["payload"])
        assert [f["field"] for f in found[0]["schema"]["fields"][1]["fields"]] == df.columns == list(found[0]["payload"]["after"])
        if forms.decimals == "precise":
            for i, v in enumerate(whole):
                if v is not None:
                    size = ((v if v >= 0 else ~v).bit_length() + 8) // 8
                    assert base64.b64decode(found[i]["payload"]["after"]["d"]) == v.to_bytes(size, "big", signed=True)
        back = M.Debezium(df.schema, ["id"], forms).parse(M.as_messages(sent, "t", F.col("value"), F.col("key")))
        assert back.unparsed.count() == 0
        assert back.rows.select(*[f"`{c}`" for c in df.columns]).orderBy("id").collect() == df.orderBy("id").collect()
    with pytest.raises(ValueError):
        serialize.ConnectForms(decimals="float")
