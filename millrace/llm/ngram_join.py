"""Exact Jaccard self-join on word n-grams as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns the distinct n-grams of words.
Two documents link when their sets' Jaccard similarity reaches ``percent``.  The
product of the matrix with its transpose is formed only where that can happen:

* Equal rows are one class (a third of all rows may be copies of one text).
* Columns are ordered by their frequency over all documents, rare ones first.  Two
  rows that link share a column among the first ``n - ceil(p n) + 1`` of each; only
  those entries are laid out, and only columns with two classes stay.
* A column is a block of the product.  Small blocks are multiplied out.  A larger one first pairs
  its rows with one of it, its centre; linked rows are contracted into
  components, and a block within one component has nothing left to
  tell.  In what is left all rows of different components are paired, a block's rows
  cut into pieces that each meet all of it, so that no task has a whole large block.
* Pairs are discarded where a bound on the overlap is below what is needed: from the sizes,
  from the place of a shared column, then from the number of first columns they share,
  as all other common columns come after the first ones of one of the two.  In larger
  blocks also from each row's reach: of its columns, those that several components hold, as
  no other can be common.  The row of most reach is a block's centre: in a group of near
  copies it is what they are copies of.  So such a group costs about its size,
  not its square: a row that is too far from the centre to link has too little reach
  for most others, and no link between components is lost.  For
  what is left the overlap is counted over the whole rows; a join on the documents'
  names fetches the texts of those alone.

Texts are read three times: for classes and frequencies, for first columns, and for the rows of
pairs.  All tables are shuffled by equi-joins and grouped minima, at every size alike; their sizes grow
with the input and none but the frequency table is broadcast.  That has 2**LEAST_BITS to
2**FREQUENCY_BITS hashed slots of a byte, one for every four n-grams of the input within these
bounds; any order gives the same links, so a shared slot can only make a block larger.
A table is deleted when its successors are written.

N-grams are 64-bit hashes of words.  A class is named by half of a 128-bit hash of its row;
where rows with the same half differ in the other, they are named by that.

Defined cases: null or empty texts and those of white space have no n-grams, link
with nothing and are their own component; with fewer words than the width the whole sequence
is the one n-gram; very long texts are hashed in blocks cut at white space; rows that repeat a ``doc_id`` are each
put out, and repeated rows are copies of one text; a null ``doc_id``
is never a component's name unless it has no other; an empty table stays empty; further columns are
ignored, and carried through by :func:`one_of_each`.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, release, shuffle_partitions, stash

WIDTH, PERCENT = 5, 80
#: Binary logarithm of the frequency table's slots: as counted (at most), and at least; slots of a part.
FREQUENCY_BITS, LEAST_BITS, PART_BITS = 26, 20, 16
#: Slots that a task gathers before it packs them.
GATHERED = 4_000_000
#: Blocks of so many rows are multiplied out at once; larger ones in pieces of so many.
SMALL_BLOCK, PIECE = 8, 512
#: Bytes of text that are hashed at once, at least.
BLOCK = 1 << 17
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_BASE = 0xD6E8FEB86659FD93


# --- words and n-grams, an Arrow batch at a time ----------------------------------------------------------


@functools.cache
def _byte_values() -> np.ndarray:
    """A random odd number a byte; capitals have that of their small letters, white space has 0."""
    values = np.array([xxhash.xxh3_64_intdigest(bytes([b])) | 1 for b in range(256)], np.uint64)
    values[65:91] = values[97:123]
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64."""
    power = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    return power(_BASE), power(pow(_BASE, -1, 1 << 64))


def _hash_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of bytes, and where they start; none goes over a text's first byte.

    A word's hash is a polynomial of its bytes' values, taken from running sums, then mixed.
    """
    up, down = _powers(max(BLOCK, 1 << int(len(data) - 1).bit_length()) if len(data) else BLOCK)
    values = _byte_values()[data]
    letter = np.concatenate([[False], values != 0, [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[firsts[firsts <= len(data)]] = True
    starts = np.flatnonzero(letter[1:] & ~(letter[:-1] & ~cut))
    ends = np.flatnonzero(letter[:-1] & ~(letter[1:] & ~cut))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(data)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ h >> _SHIFT, starts


def _long_text(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in blocks, cut at white space."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            spaces = np.flatnonzero(_byte_values()[data[at:end]] == 0)
            while not len(spaces) and end < len(data):
                spaces = np.flatnonzero(_byte_values()[data[end : end + BLOCK]] == 0) + (end - at)
                end += BLOCK
            end = at + int(spaces[-1]) + 1 if len(spaces) else len(data)
        yield data[at:end]
        at = end


def words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts in groups of about BLOCK bytes: the first one's place, each one's number of words, and the words' hashes."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    none = np.zeros(0, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        if offsets[j] - offsets[i] > BLOCK:
            found = [_hash_words(block, none)[0] for block in _long_text(data[offsets[i] : offsets[j]])]
            h = np.concatenate(found)
            yield i, np.array([len(h)]), h
        else:
            first = offsets[i : j + 1] - offsets[i]
            h, starts = _hash_words(data[offsets[i] : offsets[j]], first)
            yield i, np.diff(np.searchsorted(starts, first)), h
        i = j


def ngrams(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As :func:`words`, with each text's number of distinct n-grams and their hashes, sorted within a text."""
    for i, counts, h in words(texts):
        n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(np.cumsum(counts) - counts - bounds[:-1], n) + np.arange(bounds[-1])
        wide = np.repeat(np.minimum(counts, width), n)
        out = wide.astype(np.uint64)
        for k in range(width):
            if (short := counts[n > 0] <= k).any() if k else False:
                there = np.flatnonzero(wide > k)
                x = (out[there] ^ h[at[there] + k]) * _MIX
                out[there] = x ^ x >> _SHIFT
            else:
                out = (out ^ h[at + k]) * _MIX
                out ^= out >> _SHIFT
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                out[a:b].sort()
        new = np.ones(len(out) + 1, bool)
        new[1:-1] = out[1:] != out[:-1]
        new[bounds] = True
        new = new[:-1]
        upto = np.concatenate([[0], np.cumsum(new)])[bounds]
        yield i, np.diff(upto), out[new]


def _slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))


def row_key(grams: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two signed 64-bit halves of a hash of the whole set, the first cut to ``bits``."""
    d = xxhash.xxh3_128_digest(grams.data)
    return int.from_bytes(d[:8], "little", signed=True) >> (64 - bits), int.from_bytes(d[8:], "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (-(-percent * n // 100)) + 1


# --- one pass: classes and frequencies -------------------------------------------------------------------


def _pack_counts(slots: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """The parts that the slots lie in, and each one's slots and counts, compressed."""
    at, counts = np.unique(np.concatenate(slots), return_counts=True)
    parts, first = np.unique(at >> PART_BITS, return_index=True)
    cut = [*first.tolist(), len(at)]
    pack = lambda a, b: zlib.compress(at[a:b].astype("<u2").tobytes() + counts[a:b].astype("<u4").tobytes(), 1)
    return parts.tolist(), [pack(a, b) for a, b in zip(cut, cut[1:], strict=False)]


FACTS = "doc_id long, key long, key2 long, n long, part int, counts binary"


def _facts(width: int, bits: int) -> Callable:
    names = [f.split()[0] for f in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << FREQUENCY_BITS) - 1)
        slots: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            parts, data = _pack_counts(slots)
            slots.clear()
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=names)

        for batch in batches:
            keys: list[tuple] = []
            sizes: list[np.ndarray] = []
            for _, n, grams in ngrams(batch.column(1), width):
                keys += [row_key(grams[a:b], bits) if b > a else (None, None) for a, b in _slices(n)]
                sizes.append(n)
                slots.append((grams & mask).astype(np.uint32))
                if sum(map(len, slots)) > GATHERED:
                    yield packed()
            cols = [batch.column(0), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())], names=names)
        if slots:
            yield packed()

    return run


def _sum_counts(parts: int) -> Callable:
    """Parts of the frequency table, folded onto so many: the rounded binary logarithm of each slot's count, times 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(data)
                n = len(raw) // 6
                sums.setdefault(part % parts, np.zeros(1 << PART_BITS, np.uint32))[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n)
        for part, total in sums.items():
            level = np.minimum(np.log2(total + 1.0) * 4, 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    return run


def frequency_levels(facts: DataFrame) -> np.ndarray:
    """The whole table: a byte for every four n-grams, from 2**LEAST_BITS to 2**FREQUENCY_BITS."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    bits = min(max((total // 4).bit_length(), LEAST_BITS), FREQUENCY_BITS)
    parts = 1 << (bits - PART_BITS)
    n = min(shuffle_partitions(facts.sparkSession), parts)
    rows = facts.where("part IS NOT NULL").select("part", "counts").repartition(n, F.col("part") % parts).mapInArrow(_sum_counts(parts), "part int, levels binary")
    out = np.zeros((parts, 1 << PART_BITS), np.uint8)
    for row in rows.collect():  # 2**FREQUENCY_BITS bytes at most
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


# --- entries of the incidence matrix ---------------------------------------------------------------------


ENTRY = "token long, key long, n long, pos long"


def _named(keys: tuple[int, int], clashes: frozenset[int]) -> int:
    return keys[1] if keys[0] in clashes else keys[0]


def _entries(width: int, percent: int, levels, bits: int, clashes: frozenset[int]) -> Callable:
    """(token, key, n, pos) of each row's first columns, once a task.  A token is a column's level and hash, so tokens are in the columns' order."""
    names = [f.split()[0] for f in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        mask, seen = np.uint64(len(level) - 1), set()
        for batch in batches:
            for _, n, grams in ngrams(batch.column(0), width):
                tokens = level[(grams & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8)
                firsts, keys, sizes = [], [], []
                for a, b in _slices(n):
                    if b == a or (key := _named(row_key(grams[a:b], bits), clashes)) in seen:
                        continue
                    seen.add(key)
                    tokens[a:b].sort()
                    firsts.append(tokens[a : a + prefix_length(b - a, percent)])
                    keys.append(key)
                    sizes.append(b - a)
                if keys:
                    count = [len(f) for f in firsts]
                    cols = np.concatenate(firsts).view(np.int64), np.repeat(np.array(keys, np.int64), count), np.repeat(sizes, count), np.concatenate([np.arange(c) for c in count])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def _rows(width: int, bits: int, clashes: frozenset[int]) -> Callable:
    """(key, grams) of (key, text) where the text has that key, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for i, n, grams in ngrams(batch.column(1), width):
                keys, rows = [], []
                for k, (a, b) in enumerate(_slices(n), i):
                    if b > a and wanted[k] not in seen and _named(row_key(grams[a:b], bits), clashes) == wanted[k]:
                        seen.add(wanted[k])
                        keys.append(wanted[k])
                        rows.append(grams[a:b].tobytes())
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], names=["key", "grams"])

    return run


# --- pairs ------------------------------------------------------------------------------------------------


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Rows of different components whose sizes, reach, and the places of the column they share (the first one, in pairs that link), allow the overlap needed."""
    need = F.ceil(F.lit(percent) * (a["n"] + b["n"]) / (100 + percent))
    sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
    return (a["comp"] != b["comp"]) & sizes & (F.least(a["n"] - a["pos"], b["n"] - b["pos"], a["reach"], b["reach"]) >= need)


ROW = ("reach", "key", "n", "pos", "comp")


def _pairs(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs of a block's rows that are in different components and may link: each piece of the block with all of it."""
    pieces = postings.groupBy("token").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    row = F.struct(*ROW)
    cut = postings.hint("merge").join(pieces, "token").select("token", row.alias("row"), "pieces")
    a = cut.select("token", F.pmod(F.xxhash64("row.key"), F.col("pieces")).alias("piece"), F.col("row").alias("a"))
    b = cut.select(F.col("token").alias("t"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("p"), F.col("row").alias("b"))
    both = a.hint("merge").join(b, (F.col("token") == F.col("t")) & (F.col("piece") == F.col("p")) & (F.col("a.key") < F.col("b.key")) & _may_link(F.col("a"), F.col("b"), percent))
    return both.select(F.col("a.key").alias("u"), F.col("b.key").alias("v")).distinct()


def _small_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """As :func:`_pairs`, for blocks of SMALL_BLOCK rows at most."""
    row = F.struct(*ROW)
    a, b = postings.select("token", row.alias("a")), postings.select(F.col("token").alias("t"), row.alias("b"))
    both = a.join(b, (F.col("token") == F.col("t")) & (F.col("a.key") < F.col("b.key")) & _may_link(F.col("a"), F.col("b"), percent))
    return both.select(F.col("a.key").alias("u"), F.col("b.key").alias("v")).distinct()


def _centred(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of each row of a block with its centre that are in different components and may link."""
    centres = postings.groupBy("token").agg(F.max(F.struct(*ROW)).alias("b"))
    both = postings.hint("merge").select("token", F.struct(*ROW).alias("a")).join(centres, "token").where(_may_link(F.col("a"), F.col("b"), percent))
    return both.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v")).distinct()


def _overlaps(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = batch.column(0), batch.column(1)
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([us.filter(k := pa.array(keep, pa.bool_())), vs.filter(k)], names=["u", "v"])

    return run


def _plausible(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Pairs that share so many first columns that the rest may make up what is needed."""
    side = lambda key, x: firsts.select(F.col("key").alias(key), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    rest = lambda n: F.ceil(F.col(n) * percent / 100) - 1  # noqa: E731  what comes after the first columns
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    return both.where(F.size(F.array_intersect("ta", "tb")) + F.greatest(rest("na"), rest("nb")) >= need).select("u", "v")


def _links(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    a = rows.select(F.col("key").alias("u"), F.col("grams").alias("x"))
    b = rows.select(F.col("key").alias("v"), F.col("grams").alias("y"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(_overlaps(percent), "u long, v long")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, comp, grams) to one row a column: (key, comp, gram)."""
    for batch in batches:
        rows = [np.frombuffer(g.as_buffer(), np.int64) for g in batch.column(2)]
        if rows:
            sizes = [len(r) for r in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in (0, 1)), pa.array(np.concatenate(rows))], names=["key", "comp", "gram"])


def _several(table: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that rows of several components hold."""
    return table.groupBy(column).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select(column)


def _open(postings: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings of the columns that hold several components, with each row's component and reach."""
    joined = postings.join(components(links).select(F.col("node").alias("key"), "root"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    mixed = stash(joined.hint("merge").join(_several(joined, "token"), "token"), "mixed")
    spread = mixed.select("key", "comp").distinct().join(rows, "key").select("key", "comp", "grams").mapInArrow(_spread, "key long, comp long, gram long")
    reach = spread.hint("merge").join(_several(spread, "gram"), "gram").groupBy("key").agg(F.count("*").alias("reach"))
    out = stash(mixed.join(reach, "key"), "open")
    release(mixed)
    return out


def link_classes(docs: DataFrame, facts: DataFrame, width: int = WIDTH, percent: int = PERCENT, bits: int = 64, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """Components (node, root) of the classes of equal rows that have a link to another class."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(facts))
    entries = stash(docs.select("text").mapInArrow(_entries(width, percent, levels, bits, clashes), ENTRY), "entries")
    levels.destroy()
    shared = entries.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi").select("token")
    shared = stash(shared, "columns")
    postings = stash(entries.hint("merge").join(shared, "token").distinct(), "postings")
    release(entries, shared)
    firsts = stash(postings.groupBy("key").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")), "firsts")
    sized = postings.hint("merge").join(postings.groupBy("token").agg(F.count("*").alias("size")), "token")
    sized = stash(sized.withColumn("large", F.col("size") > SMALL_BLOCK).drop("size"), "sized")
    release(postings)
    small = sized.where("NOT large").withColumn("comp", F.col("key")).withColumn("reach", F.col("n"))
    large = sized.where("large").drop("large")
    pairs = stash(_plausible(_small_pairs(small, percent), firsts, percent), "pairs")
    # all that is still to be tested lies in large blocks, so one more pass gives every row
    ends = pairs.select(F.explode(F.array("u", "v")).alias("key")).unionByName(large.select("key")).distinct()
    named = facts.where("part IS NULL").groupBy("key").agg(F.min("doc_id").alias("named")).join(ends, "key").hint("shuffle_hash")
    texts = docs.join(named, F.col("doc_id").eqNullSafe(F.col("named"))).select("key", "text")
    rows = stash(texts.mapInArrow(_rows(width, bits, clashes), "key long, grams binary"), "rows")
    links = stash(_links(pairs, rows, percent), "links")
    if not large.isEmpty():
        for choose in (_centred, _pairs):
            opened = _open(large, links, rows)
            found = choose(opened, percent).join(pairs, ["u", "v"], "left_anti")
            found = stash(_plausible(found, firsts, percent), "pairs")
            release(opened)
            pairs = pairs.unionByName(found)
            links = links.unionByName(stash(_links(found, rows, percent), "links"))
    release(firsts, sized, rows)
    return components(links)


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text", bits: int = 64) -> DataFrame:
    """One row an input row: doc_id, n_shingles (size of its set), component_id (least doc_id it is linked with, directly or not).  ``bits``: of a class's name, before names that clash give way."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    facts = stash(docs.mapInArrow(_facts(width, bits), FACTS), "facts")
    rows = facts.where("part IS NULL")
    # names that two sets share: none to be expected below some 10**9 sets, and a few beyond
    clashes = frozenset(r["key"] for r in rows.groupBy("key").agg(F.min("key2").alias("lo"), F.max("key2").alias("hi")).where("lo != hi").select("key").toLocalIterator())
    if clashes:
        facts = facts.withColumn("key", F.when(F.col("key").isin(*clashes), F.col("key2")).otherwise(F.col("key")))
        rows = facts.where("part IS NULL")
    comps = link_classes(docs, facts, width, percent, bits, clashes)
    least = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = least.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = stash(named.groupBy("root").agg(F.min("least").alias("name")), "names")
    classes = named.join(names, "root").select("key", "name")
    out = rows.where("key IS NOT NULL").join(classes, "key").select("doc_id", F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))
    alone = rows.where("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input rows that stay: of each component the one with the least id; rows without an id stay too."""
    found = ngram_components(docs, width, percent, id_column, text_column)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_column).cast("long") == F.col("__gone"), "left_anti")
