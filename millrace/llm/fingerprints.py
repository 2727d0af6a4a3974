"""Document fingerprints: a canonical exact digest.

A text's canonical form is its NFKC normal form, case-folded, with runs of white space
as one space.  Its fingerprint is the 128-bit XXH3 of that.  Documents with the same
hash are a bucket, and inside a bucket of several the canonical bytes are compared:
least and greatest must be the same string.  Both aggregates combine on the map side, so a
bucket with a third of all rows is a row a task.  A bucket that holds different
bytes gives each its own fingerprint, the hash and the SHA-256 of the bytes; so equal
fingerprints mean equal canonical texts, and the likeness of two is 1 or 0.

:func:`edited_pairs` puts every document beside the one before it in descending order of
ids and needs one shuffle of the texts: ids are cut into ranges at approximate
quantiles, each range is a partition, and the first document of a range also goes to
the range that needs it.

Defined cases: a null text counts as empty; a null id sorts last; rows that repeat an id
are ordered by a hash of their texts; a lone document is its own next one; an empty
table stays empty; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_slots, shuffle_partitions, slot_map, stash

LOWEST = -(2**63)


def canonical(text: str | None) -> bytes:
    t = text or ""
    t = t.lower() if t.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split()).encode()


def wide_hash(data: bytes, bits: int = 128) -> int:
    return xxhash.xxh3_128_intdigest(data) >> (128 - bits)


def _low(h: int) -> int:
    """The lower half as a signed long."""
    return ((h & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)) - (1 << 63)


def hash_text(h: int) -> str:
    return f"{h:032x}"


def _hashes(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_hash(canonical(t.as_py()), bits) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"low": pa.array(map(_low, found), pa.int64()), "fingerprint": pa.array(map(hash_text, found), pa.string())})

    return run


def _suspects(bits: int, slots) -> Callable:
    """(fingerprint, canonical bytes) of the documents whose hash may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = slots.value
        for batch in batches:
            forms = [canonical(t.as_py()) for t in batch.column(0)]
            found = [wide_hash(c, bits) for c in forms]
            keep = in_slots(words, np.array(list(map(_low, found)), np.int64).view(np.uint64)).tolist()
            yield pa.RecordBatch.from_pydict({"fingerprint": pa.array([hash_text(h) for h, k in zip(found, keep, strict=True) if k], pa.string()), "form": pa.array([c for c, k in zip(forms, keep, strict=True) if k], pa.binary())})

    return run


def collisions(docs: DataFrame, bits: int = 128, text_column: str = "text") -> DataFrame:
    """The hashes (fingerprint) under which different canonical texts meet; none to be expected at 128 bits."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text_column).alias("text"))
    repeated = texts.mapInArrow(_hashes(bits), "low long, fingerprint string").groupBy("fingerprint").agg(F.first("low").alias("low"), F.count("*").alias("n")).where("n > 1").select("low")
    slots = sc.broadcast(slot_map(repeated, "low"))
    forms = texts.mapInArrow(_suspects(bits, slots), "fingerprint string, form binary")
    return stash(forms.groupBy("fingerprint").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a != b").select("fingerprint"), "collisions")


def _resolve(rows: DataFrame, clashes: DataFrame, column: str, form: str) -> DataFrame:
    c = clashes.select(F.col("fingerprint").alias("__clash"))
    own = F.when(F.col("__clash").isNull(), F.col(column)).otherwise(F.concat_ws("-", column, form))
    return rows.join(c, F.col(column) == F.col("__clash"), "left").withColumn(column, own).drop("__clash")


def fingerprints(docs: DataFrame, bits: int = 128, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hash_text(wide_hash(c, bits)) for c in forms], pa.string()), pa.array([hashlib.sha256(c).hexdigest() for c in forms], pa.string())], names=["doc_id", "fingerprint", "form"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_column]}, fingerprint string, form string")
    clashes = collisions(docs, bits, text_column)
    if not clashes.isEmpty():
        rows = _resolve(rows, clashes, "fingerprint", "form")
    return rows.select("doc_id", "fingerprint")


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tail) in descending order of ids, a partition a range of ids.

    The last row of a partition has tail set: it is the first document of the range below
    (after the last range: of the first), there to follow the document before it.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("k"))
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] or [] if n > 1 else []
    cuts = sorted(set(cuts))
    above = F.lit(0)
    if cuts:
        above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("k")))
    rows = rows.withColumn("range", above)
    firsts = {r["range"]: r["k"] for r in rows.groupBy("range").agg(F.max("k").alias("k")).collect()}  # n rows at most
    order = sorted(firsts)
    goes_to = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    ranges = range(len(cuts) + 1)
    at = F.col("range") + 1
    first = F.element_at(F.array(*[F.lit(firsts.get(r)).cast("long") for r in ranges]), at)
    target = F.element_at(F.array(*[F.lit(goes_to.get(r)).cast("int") for r in ranges]), at)
    place = lambda r, tail: F.struct(r.cast("int").alias("range"), F.lit(tail).alias("tail"))
    places = F.when(F.col("k") == first, F.array(place(F.col("range"), 0), place(target, 1))).otherwise(F.array(place(F.col("range"), 0)))
    dealt = rows.select("doc_id", "text", "k", F.explode(places).alias("p")).select("doc_id", "text", "k", "p.range", "p.tail")
    dealt = dealt.repartitionById(len(ranges), F.col("range"))
    return dealt.sortWithinPartitions("tail", F.desc("k"), F.xxhash64("text")).select("doc_id", "text", "tail")


PAIRS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, form string, edited_form string"


def _edited(bits: int) -> Callable:
    names = ["doc_id", *[f.split()[0] for f in PAIRS.split(", ")]]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the document whose next one is to come: id, text, canonical form
        over = False
        for batch in batches:
            ids, rows = [], []
            for k, text, tail in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if over:
                    break
                text = text.as_py() or ""
                form = canonical(text)
                if before:
                    k0, t0, c0 = before
                    cut = len(t0) // 3
                    edited = t0[: len(t0) - cut] + text[:cut]
                    c1 = canonical(edited)
                    ids.append(k0)
                    rows.append((len(t0), hashlib.sha256(edited.encode()).hexdigest(), hash_text(wide_hash(c0, bits)), hash_text(wide_hash(c1, bits)), float(c0 == c1), float(c0 == form), hashlib.sha256(c0).hexdigest(), hashlib.sha256(c1).hexdigest()))
                before, over = (k, text, form), bool(tail)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in ids], batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=names)

    return run


def edited_pairs(docs: DataFrame, bits: int = 128, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last third replaced by the next document's start), and their likeness."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    clashes = collisions(docs, bits)
    rows = beside_next(docs).mapInArrow(_edited(bits), f"doc_id long, {PAIRS}")
    if not clashes.isEmpty():
        rows = _resolve(_resolve(rows, clashes, "fingerprint", "form"), clashes, "edited_fingerprint", "edited_form")
    return rows.drop("form", "edited_form")
