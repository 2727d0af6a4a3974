"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of a hashed membership map: 2 MB whatever the input, so it may be broadcast.
SLOT_BITS = 24


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset a local-mode session gets a folder of its own; on a
    cluster a machine-local folder would lose rows, so that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Removes the shuffle files of a query when it ends, where this version of Spark has it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation; the shuffle
    files that made the table go when it is written.  :func:`release` deletes it once its
    successors are written, else the end of the session does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing will read again, and those that a frame was made from (``_parts``)."""
    for df in frames:
        release(*vars(df).get("_parts", ()))
        if path := getattr(df, "_stashed", None):
            spark = df.sparkSession
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slot_map(hashes: DataFrame, column: str, bits: int = SLOT_BITS) -> np.ndarray:
    """Bytes of a 2**bits bit map with the slot of every 64-bit hash set.

    Its size is fixed by ``bits`` (2 MB), not by the input: words of 48 bits are
    OR-ed on the executors and at most 2**bits / 48 rows reach the driver.  It
    only saves work: a full map lets every row through, and an exact join follows.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        hashes.select((slot / 48).cast("int").alias("word"), (slot % 48).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        .toPandas()
    )
    out = np.zeros((1 << bits) // 48 + 1, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def in_slots(words: np.ndarray, hashes: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    """Which of the uint64 hashes have their slot set in a ``slot_map``."""
    slot = hashes & np.uint64((1 << bits) - 1)
    return (words[(slot // np.uint64(48)).astype(np.int64)] >> (slot % np.uint64(48))) & np.uint64(1) == 1


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v long): rows (node, root), root the least node.

    Alternating stars, after Kiveris et al.: first every larger neighbour of a node is tied to the
    least node in its neighbourhood, then every smaller one and the node itself.  Paths shrink
    exponentially, so the rounds grow with the logarithm of a component's width, and a chain in the order of its names
    takes no longer.  Each half is a grouped minimum with map-side combining and an
    equi-join, so a hub of any degree is pre-aggregated or split; nothing is collected, and
    a round's table goes when the next one is written.  Nodes without an edge don't appear; an empty input
    gives no rows.
    """
    edges = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while (now := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != mark and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(least, "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges, mark = edges, stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), now
        release(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
