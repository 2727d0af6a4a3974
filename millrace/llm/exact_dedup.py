"""Exact deduplication by a tree merge of sorted digest runs.

Every scan partition sorts its (digest, identifier) entries into a run with one
entry a text.  Runs then meet in binomial rounds: in round ``r`` the runs whose
numbers agree above ``r * fan_bits`` bits go to one place, where Spark's external
merge sort puts them in digest order and one streaming pass folds equal entries,
keeping the identifier that stays, the number of rows and the number of rows
that carry that identifier.  The digest space is cut into slices, each a tree of
its own, so even the last round runs on all cores.  A group of copies shrinks to
one entry a run before the first shuffle, however large it is.

An entry is *verified* at every level: two entries are folded only if SHA-256,
the byte length and an independent 64-bit hash of the text all agree; otherwise
both stay apart.

Defined cases: a null text counts as empty and all empty texts are one group;
a null ``doc_id`` loses to any other and stays only in a group without
identifiers; rows that repeat text *and* ``doc_id`` are one document - all of
them are marked kept, and :func:`deduplicate` leaves one of them; an empty table
gives an empty result; very long texts count as one digest each; further columns are ignored here and carried through by
:func:`deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shuffle_partitions

KEY = ["digest", "check", "n_bytes"]
ENTRY = "slice int, run int, digest binary, check long, n_bytes long, rank_id long, group_size long, ties long"
LOWEST = -(2**63)


def digest_columns(text: str = "text") -> dict[str, Column]:
    """SHA-256, byte length and a second hash of a text column; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {"digest": F.unhex(F.sha2(t, 256)), "check": F.xxhash64(t), "n_bytes": F.octet_length(t).cast("long")}


def _fold_table(t: pa.Table) -> pa.Table:
    """Fold adjacent rows of one (slice, run, key); the rows come in order, larger rank_id last."""
    n = t.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for name in ("slice", "run", *KEY):
        c = t.column(name).combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n) - 1
    ids = t.column("rank_id").to_numpy()
    group = np.cumsum(new) - 1
    best = ids[ends][group] == ids
    out = t.take(pa.array(ends))
    sizes = np.add.reduceat(t.column("group_size").to_numpy(), starts)
    ties = np.add.reduceat(np.where(best, t.column("ties").to_numpy(), 0), starts)
    out = out.set_column(out.schema.get_field_index("group_size"), "group_size", pa.array(sizes, pa.int64()))
    return out.set_column(out.schema.get_field_index("ties"), "ties", pa.array(ties, pa.int64()))


def fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted entries and keep one a key; only the last entry is held back between batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = _fold_table(t if held is None else pa.concat_tables([held, t.cast(held.schema)]))
        held = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def winners(docs: DataFrame, keep: str = "min", fan_bits: int = 4, rounds: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a distinct text: digest, check, n_bytes, keep_id, group_size, ties.

    ``keep``: 'min' or 'max' - which identifier of a group stays.  2**(fan_bits *
    rounds) run numbers exist; more scan partitions share them as further runs.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    slices = 8 * n
    rank = F.col(id_column).cast("long") if keep == "max" else -F.col(id_column).cast("long")
    entries = docs.select(*[c.alias(k) for k, c in digest_columns(text_column).items()], F.coalesce(rank, F.lit(LOWEST)).alias("rank_id"))
    entries = entries.select(
        F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int").alias("slice"),
        F.pmod(F.spark_partition_id(), F.lit(1 << (fan_bits * rounds))).cast("int").alias("run"),
        *KEY, "rank_id", F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("ties"),
    )
    order = ["slice", "run", *KEY, "rank_id"]
    runs = entries.sortWithinPartitions(*order).mapInArrow(fold_runs, ENTRY)
    for _ in range(rounds):
        runs = runs.withColumn("run", F.shiftright("run", fan_bits))
        runs = runs.repartition(n, "slice", "run").sortWithinPartitions(*order).mapInArrow(fold_runs, ENTRY)
    rank_id = F.when(F.col("rank_id") != LOWEST, F.col("rank_id") if keep == "max" else -F.col("rank_id"))
    return runs.select(*KEY, rank_id.alias("keep_id"), "group_size", "ties")


def exact_groups(docs: DataFrame, keep: str = "min", id_column: str = "doc_id", text_column: str = "text", **tree: int) -> DataFrame:
    """One row an input row: its identifier, keep_id, group_size, kept, text_sha256, ties.

    The rows meet the winners in an equi-join on the digest; a large group is a
    hot key there, which adaptive execution splits, as nothing above needs it whole.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *[c.alias(k) for k, c in digest_columns(text_column).items()])
    joined = rows.join(winners(docs, keep, id_column=id_column, text_column=text_column, **tree), KEY)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "ties")


def deduplicate(docs: DataFrame, keep: str = "min", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input rows that stay, with their columns as they came; one row a distinct text."""
    keys = [f"__{k}" for k in KEY]
    rows = docs.select("*", *[c.alias(f"__{k}") for k, c in digest_columns(text_column).items()])
    won = winners(docs, keep, id_column=id_column, text_column=text_column).select(*[F.col(k).alias(f"__w_{k}") for k in KEY], F.col("keep_id").alias("__keep"), F.col("ties").alias("__ties"))
    same = [F.col(f"__{k}") == F.col(f"__w_{k}") for k in KEY]
    kept = rows.join(won, [*same, F.col(id_column).cast("long").eqNullSafe(F.col("__keep"))])
    repeated = kept.where("__ties > 1").dropDuplicates(keys)
    return kept.where("__ties = 1").unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
