"""The same transfers as streams of files."""

from pyspark.sql import functions as F

from millrace import changelog as C
from millrace.plans.chain import build
from millrace.schema import TableId
from millrace.sinks.tables import KeyedTable
from millrace.streaming import replicate as R


def test_upsert_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "insert", 1, "a"), (2, "insert", 2, "b"), (3, "delete", 1, None)], "_lsn bigint, _kind string, id int, v string")
    meta = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in C.META.items()], "id", "v").withColumn("_counter", F.lit(0))
    meta.write.parquet(str(tmp_path / "in"))
    stream = R.file_stream(spark, str(tmp_path / "in"), meta.schema)
    target = KeyedTable(spark, str(tmp_path / "out"), ["id"])
    R.upsert_stream(stream, TableId("s", "t"), build([]), target, str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in target.read().collect()] == [(2, "b")]


def test_windows(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'u' AS who UNION ALL SELECT timestamp'2024-01-01 00:04:00', 'u' UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'u'")
    assert [r.events for r in R.windowed_counts(events, "ts", "5 minutes").orderBy("window_start").collect()] == [2, 1]
    assert [r.events for r in R.sessions(events, "ts", "10 minutes", "who").orderBy("session_start").collect()] == [2, 1]
    events.write.parquet(str(tmp_path / "e"))
    stream = R.file_stream(spark, str(tmp_path / "e"), events.schema)
    q = R.windowed_counts(stream, "ts", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == 2
