"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the characters of an expression (a run of
letters, lower-cased), one learnt from toxic and one from ordinary documents.
Both back off to the *same* continuation counts of all training expressions, so a
character that neither class has evidence for cancels out of the comparison: a rare
expression is judged by the longest context that was seen often enough.  Counts
are document counts of distinct expressions, over *all* labelled documents that are not held
out, and every expression counts, single ones too; the absolute discount is large,
so what one or two documents happen to say carries no weight.

Counting, continuation counts and smoothing are grouped aggregations and joins of
tables of grams, which grow with the vocabulary.  Scoring needs the log ratio of the two models
for each gram, or for its context where the gram has no counts of its own.  All of these are kept.  Up to
``MODEL`` of each are broadcast, 12 bytes each, as sorted arrays (:class:`Model`).  Of more, those seen in most documents are broadcast
and the rest stay a table (:class:`Tables`): a word that may have grams of the rest is settled by a join with it, once
however often it comes, and then joined to the documents that hold it.  Both ways give the same features.

A document is scored by the length-normalised log-likelihoods of all its
expressions under both models, and by the *evidence* it holds: how far its expressions' log
ratios exceed ``MARGIN``, per word.  A run of more than ``LONGEST`` letters is words without spaces
between them: each of its stretches of rising log ratio is judged as an expression, and it
counts as a word for every ``ORDER`` letters.  A logistic curve maps both to (0, 1); it is fitted to at most
``MAX_TOXIC`` and ``MAX_ORDINARY`` of the training documents, drawn by a hash of their ids.
Labels, language, source and ids are no inputs of a score.

Defined cases: null or empty texts have no expressions and get the curve's value
at no evidence; very long texts are scored whole; rows that repeat an id or a text are each scored, and
each counts as a document where labelled; a document with both labels counts once for each; null labels are left out; with no training document of a class
every score is 1 or 0, as the other class has it, 0 without any; an empty table stays empty; further columns are
ignored, and carried through by :func:`reject`, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import in_slots, release, slot_map, stash

#: Labelled documents that the curve is fitted to, at most.
MAX_TOXIC, MAX_ORDINARY = 3000, 6000
#: Characters a gram has, absolute discounts of the classes and of the shared counts.
ORDER, DISCOUNT, SHARED_DISCOUNT = 7, 3.0, 0.75
#: Grams, and contexts, that are broadcast at most; the rest is joined.  Binary logarithm of the slots of the map (11 MB) that tells which words need the join.
MODEL, REST_BITS = 1 << 20, 26
#: Log ratio from which an expression is evidence; words added to a length.
MARGIN, LENGTH_PRIOR = 2.5, 5.0
#: Letters from which an expression is taken for several joined words, and the alphabet's assumed size.
LONGEST, ALPHABET = 40, 200
#: Labels up to which they are broadcast to the documents; beyond, the two are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Bytes of text that are scored at once, at least; grams that a task sums before it hands them on.
BLOCK, GATHERED = 1 << 19, 300_000

LETTERS = re.compile(r"[^\W\d_]+")


def expressions(text: str) -> list[str]:
    """Runs of letters of a lower-cased text."""
    return LETTERS.findall(text)


def grams(expression: str) -> Iterator[str]:
    """The grams that predict each character: all characters before it, ORDER at most, with ^ and $ as ends."""
    s = f"^{expression}$"
    for i in range(1, len(s)):
        yield s[max(0, i - ORDER + 1) : i + 1]


# --- grams as numbers, many expressions at a time --------------------------------------------------------


@functools.cache
def _letter_table() -> np.ndarray:
    """Whether a code point is a letter in the sense of LETTERS."""
    return np.array([(c := chr(i)).isalnum() and not c.isdecimal() for i in range(0x110000)])


@functools.cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 62, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _windows(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the ORDER characters up to each one, and for those without it; zeros stand apart, as sums have no part of them."""
    m, n = _multipliers(), len(chars)
    context = np.zeros(n, np.uint64)
    chars = chars.astype(np.uint64)
    for k in range(1, ORDER):
        context[k:] += chars[: n - k] * m[k]
    return context + chars * m[0], context


def numbers_of(names: list[str], contexts: bool = False) -> np.ndarray:
    """Of each gram, or of each context of one, its number as :func:`_windows` has it."""
    if not names:
        return np.zeros(0, np.uint64)
    tail = "\0" if contexts else ""
    ends = np.cumsum([len(t) + len(tail) + ORDER for t in names], dtype=np.int64) - ORDER - 1
    return _windows(code_points(("\0" * ORDER).join(t + tail for t in names)))[contexts][ends]


class Model(NamedTuple):
    """Sorted numbers of grams and of contexts with the log ratio, log P(toxic) - log P(ordinary), of each; the curve's weights."""

    grams: np.ndarray
    gram_ratios: np.ndarray
    contexts: np.ndarray
    context_ratios: np.ndarray
    weights: tuple[float, float, float]


class Tables(NamedTuple):
    """A model of more grams or contexts than are broadcast: those seen most, the others as rows (kind, number, ratio), kind 0 for grams and 1 for contexts, and the slots of their numbers."""

    common: Model
    rest: DataFrame
    slots: np.ndarray
    weights: tuple[float, float, float]


def _look_up(numbers: np.ndarray, keys: np.ndarray, values: np.ndarray, absent: np.ndarray | float) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(absent, len(numbers)).astype(np.float64)
    at = np.minimum(np.searchsorted(keys, numbers), len(keys) - 1)
    return np.where(keys[at] == numbers, values[at], absent)


def make_model(ratios: dict[str, float], contexts: dict[str, float], weights: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Model:
    """A model of tables that are at hand."""
    tables = []
    for k, table in enumerate((ratios, contexts)):
        numbers = numbers_of(list(table), bool(k))
        order = np.argsort(numbers)
        tables += [numbers[order], np.array(list(table.values()), np.float32)[order]]
    return Model(*tables, weights)


def stretches(ratios: list[float]) -> list[float]:
    """Sums of the disjoint stretches in which the running sum rises by more than MARGIN in LONGEST letters; a fall by MARGIN, or to nothing, ends one."""
    out, s, best = [], 0.0, 0.0
    for r in ratios:
        s += r - MARGIN / LONGEST
        if s > best:
            best = s
        elif s <= max(best - MARGIN, 0.0):
            out.append(best)
            s = best = 0.0
    return [*out, best]


class Expressions(NamedTuple):
    """Expressions of some words: letters' code points, where each starts, letters and word of each, how many words each *word* counts for."""

    chars: np.ndarray
    starts: np.ndarray
    size: np.ndarray
    word: np.ndarray
    n_words: np.ndarray


def find_expressions(words: list[str]) -> Expressions:
    """Of words (letters and marks without white space)."""
    chars = code_points("\0".join(words))
    letter = np.concatenate([[False], _letter_table()[chars], [False]])
    starts, ends = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(letter[:-1] & ~letter[1:])
    size = ends - starts
    word = np.searchsorted(np.cumsum([0, *[len(w) + 1 for w in words]]), starts, "right") - 1
    n_words = np.array([w != "" for w in words], float) + np.bincount(word, np.where(size > LONGEST, size // ORDER, 0), len(words))
    return Expressions(chars, starts, size, word, n_words)


def _numbered(found: Expressions) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the gram and of the context at each place: every letter of each expression, and its end."""
    if not len(found.starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # every expression as ORDER zeros, ^, its letters, $
    size = found.size
    place = np.cumsum(size + ORDER + 2) - size - 1
    laid = np.zeros(int(place[-1] + size[-1] + 1), np.uint32)
    laid[place - 1], laid[place + size] = ord("^"), ord("$")
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    laid[np.repeat(place, size) + within] = found.chars[np.repeat(found.starts, size) + within]
    gram, context = _windows(laid)
    n = size + 1
    at = np.repeat(place, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return gram[at], context[at]


def _no_context(found: Expressions) -> np.ndarray:
    """Places where words may meet: there a gram without counts says nothing."""
    return np.repeat(found.size > LONGEST, found.size + 1)


def _judged(found: Expressions, ratios: np.ndarray) -> np.ndarray:
    """Of each word: log ratio, evidence and how many words it counts for; of the ratios at each place."""
    out = np.zeros((len(found.n_words), 3))
    out[:, 2] = found.n_words
    if not len(found.starts):
        return out
    n = found.size + 1
    begin = np.cumsum(n) - n
    total = np.add.reduceat(ratios, begin)
    evidence = np.maximum(total - MARGIN, 0.0)
    for k in np.flatnonzero(found.size > LONGEST).tolist():
        evidence[k] = sum(r - MARGIN for r in stretches(ratios[begin[k] : begin[k] + n[k]].tolist()) if r > MARGIN)
    for k, x in enumerate((total, evidence)):
        out[:, k] = np.bincount(found.word, x, len(out))
    return out


def word_features(words: list[str], model: Model) -> np.ndarray:
    """Of each word (letters and marks without white space): log ratio, evidence and how many words it counts for."""
    found = find_expressions(words)
    gram, context = _numbered(found)
    absent = np.where(_no_context(found), 0.0, _look_up(context, model.contexts, model.context_ratios, 0.0))
    return _judged(found, _look_up(gram, model.grams, model.gram_ratios, absent))


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, which of them comes at each place, and how many places each text has."""
    cut = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(table: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text the sum of its words' rows of ``table``."""
    upto = np.concatenate([np.zeros((1, 3)), np.cumsum(table[codes], axis=0)]) if len(codes) else np.zeros((1, 3))
    ends = np.cumsum(sizes)
    return np.where((sizes > 0)[:, None], upto[ends] - upto[ends - sizes], 0.0)


def text_features(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its words, mean log ratio and evidence; each different word is looked at once."""
    different, codes, sizes = _cut(texts)
    sums = _sums(word_features(different.to_pylist(), model), codes, sizes)
    words = np.rint(sums[:, 2]).astype(np.int64)
    return words, *(sums[:, k] / (words + LENGTH_PRIOR) for k in (0, 1))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK bytes."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK, "right")))
        yield a, b
        a = b


def _batch_features(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For the batches' texts (last column): the columns before it, then FEATURES.  model: a broadcast one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                found = text_features(part.column(part.num_columns - 1), model.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, found)], names=[*part.schema.names[:-1], *FEATURES])

    return run


FEATURES = {"n_words": T.LongType(), "log_ratio": T.DoubleType(), "evidence": T.DoubleType()}


def features(docs: DataFrame, model: Model | Tables) -> DataFrame:
    """For the texts (last column): the columns before it, then words, mean log ratio and evidence; rows stay as they are."""
    before = [T.StructField(f.name, f.dataType) for f in docs.schema.fields[:-1]]
    if isinstance(model, Tables):
        return _joined_features(docs, model, before)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_batch_features(sent), T.StructType([*before, *(T.StructField(n, t) for n, t in FEATURES.items())]))


# --- features by joins, where the model is too large to broadcast ----------------------------------------


class Places(NamedTuple):
    """Of each place: its word, its ratio as far as the common grams and contexts give it, the numbers of gram and context, and whether the rest may have them and they would count."""

    word: np.ndarray
    ratios: np.ndarray
    numbers: tuple[np.ndarray, np.ndarray]
    unsettled: tuple[np.ndarray, np.ndarray]


def _places(found: Expressions, common: Model, slots: np.ndarray) -> Places:
    gram, context = _numbered(found)
    own, behind = _look_up(gram, common.grams, common.gram_ratios, np.nan), _look_up(context, common.contexts, common.context_ratios, np.nan)
    no_own, no_context = np.isnan(own), _no_context(found)
    unsettled = no_own & in_slots(slots, gram, REST_BITS), no_own & np.isnan(behind) & ~no_context & in_slots(slots, context, REST_BITS)
    ratios = np.where(no_own, np.where(no_context, 0.0, np.nan_to_num(behind)), own)
    return Places(np.repeat(found.word, found.size + 1), ratios, (gram, context), unsettled)


def _sum_settled(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (row, ..., text) one each with the sums over words that need no join, and one for each different other word: (row, ..., n_words, total, strong, word, times).  sent: broadcast common model and slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names[:-1], "n_words", "total", "strong", "word", "times"]
            for a, b in _slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                n, before = len(part), part.columns[:-1]
                different, codes, sizes = _cut(part.column(part.num_columns - 1))
                found = find_expressions(different.to_pylist())
                places = _places(found, *sent.value)
                table = _judged(found, places.ratios)
                joined = np.zeros(len(different), bool)
                joined[places.word[places.unsettled[0] | places.unsettled[1]]] = True
                table[joined, :2] = 0.0
                sums = _sums(table, codes, sizes)
                own = [pa.array(np.rint(sums[:, 2]).astype(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
                yield pa.RecordBatch.from_arrays([*before, *own, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
                left = np.flatnonzero(joined[codes])
                pairs, times = np.unique(np.repeat(np.arange(n), sizes)[left] * len(different) + codes[left], return_counts=True)
                if m := len(pairs):
                    row, word = before[0].take(pa.array(pairs // len(different))), different.take(pa.array(pairs % len(different))).cast(pa.string())
                    empty = [pa.nulls(m, c.type) for c in (*before[1:], *own)]
                    yield pa.RecordBatch.from_arrays([row, *empty, word, pa.array(times.astype(np.int64))], names=names)

    return run


def _unsettled_places(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, at, kind, number): what to look up at which places of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                words = batch.column(0).slice(a, b - a)
                places = _places(find_expressions(words.to_pylist()), *sent.value)
                first = np.searchsorted(places.word, np.arange(len(words)))
                for kind in (0, 1):
                    at = np.flatnonzero(places.unsettled[kind])
                    word, numbers = places.word[at], places.numbers[kind][at].view(np.int64)
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), pa.array(at - first[word]), pa.array(np.full(len(at), kind, np.int32)), pa.array(numbers)], names=["word", "at", "kind", "number"])

    return run


def _settle(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, word_total, word_strong) of rows (word, found: list of (at, kind, ratio))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                words, lists = (c.slice(a, b - a) for c in batch.columns)
                found = find_expressions(words.to_pylist())
                places = _places(found, *sent.value)
                first = np.searchsorted(places.word, np.arange(len(words)))
                at, kind, ratio = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
                at = at + np.repeat(first, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                for k in (1, 0):  # a gram's own ratio goes over its context's
                    places.ratios[at[kind == k]] = ratio[kind == k]
                table = _judged(found, places.ratios)
                yield pa.RecordBatch.from_arrays([words, pa.array(table[:, 0]), pa.array(table[:, 1])], names=["word", "word_total", "word_strong"])

    return run


def _joined_features(docs: DataFrame, model: Tables, before: list[T.StructField]) -> DataFrame:
    """:func:`features` where some words need the table of the rest.

    Rows are told apart by a number of their own, so ids and texts may come again.  The tables to release once the result is written are its ``_parts``.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.common, model.slots))
    names = [f"c{k}" for k in range(len(before))]
    rows = docs.toDF(*names, "text").select(F.monotonically_increasing_id().alias("row"), "*")
    schema = T.StructType([T.StructField("row", T.LongType()), *(T.StructField(n, f.dataType) for n, f in zip(names, before, strict=True))])
    schema = schema.add("n_words", "long").add("total", "double").add("strong", "double").add("word", "string").add("times", "long")
    parts = stash(rows.mapInArrow(_sum_settled(sent), schema), "toxicity-sums")
    uses = parts.where("word IS NOT NULL").select("row", "word", "times")
    words = stash(uses.select("word").distinct(), "toxicity-words")
    found = words.mapInArrow(_unsettled_places(sent), "word string, at long, kind int, number long").join(model.rest, ["kind", "number"]).select("word", F.struct("at", "kind", "ratio").alias("x"))
    found = words.select("word", F.lit(None).cast(found.schema["x"].dataType).alias("x")).unionByName(found).groupBy("word").agg(F.collect_list("x").alias("x"))
    settled = stash(found.mapInArrow(_settle(sent), "word string, word_total double, word_strong double"), "toxicity-word-sums")
    release(words)
    sums = [F.sum(F.col("times") * F.col(f"word_{c}")).alias(f"rest_{c}") for c in ("total", "strong")]
    mean = lambda c: (F.col(c) + F.coalesce(f"rest_{c}", F.lit(0.0))) / (F.col("n_words") + LENGTH_PRIOR)
    out = parts.where("word IS NULL").join(uses.join(settled, "word").groupBy("row").agg(*sums), "row", "left")
    out = out.select(*(F.col(n).alias(f.name) for n, f in zip(names, before, strict=True)), "n_words", mean("total").alias("log_ratio"), mean("strong").alias("evidence"))
    out._parts = [parts, settled]
    return out


# --- counts and smoothing --------------------------------------------------------------------------------


def _counted(table: dict[str, list[int]], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: list(table), "toxic": [s[0] for s in table.values()], "ordinary": [s[1] for s in table.values()]}, pa.schema([(name, pa.string()), ("toxic", pa.int64()), ("ordinary", pa.int64())]))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, ordinary): of some documents at a time in how many each expression is."""
    for batch in batches:
        for a, b in _slices(batch.column(0)):
            part = batch.slice(a, b - a)
            sums: dict[str, list[int]] = {}
            for text, toxic in zip(pc.utf8_lower(part.column(0)).to_pylist(), part.column(1).to_pylist(), strict=True):
                for w in set(expressions(text or "")):
                    sums.setdefault(w, [0, 0])[1 - toxic] += 1
            yield _counted(sums, "word")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of (word, toxic, ordinary) rows, summed as far as memory goes."""
    sums: dict[str, list[int]] = {}
    for batch in batches:
        for word, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for g in dict.fromkeys(grams(word)):
                if (s := sums.get(g)) is None:
                    sums[g] = [a, b]
                else:
                    s[0] += a
                    s[1] += b
            if len(sums) > GATHERED:
                yield _counted(sums, "gram")
                sums = {}
    if sums:
        yield _counted(sums, "gram")


def gram_counts(texts: DataFrame) -> DataFrame:
    """Rows (gram, toxic, ordinary): in how many documents' distinct expressions each gram is; of rows (text, toxic)."""
    words = texts.select("text", "toxic").mapInArrow(_distinct_words, "word string, toxic long, ordinary long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    table = words.mapInArrow(_count_grams, "gram string, toxic long, ordinary long")
    return table.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def shared_probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (t, p): the shared Kneser-Ney probability of the last character of each wanted ``t`` after those before it.

    The count of a shorter gram is its number of left neighbours over both classes.
    """
    n = F.length("gram")
    tails = counts.select(F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("gram", i, n))).alias("s")).distinct()
    left = tails.groupBy(F.expr("substring(s, 2)").alias("t")).agg(F.count("*").alias("left"))
    head = F.expr("substring(t, 1, length(t) - 1)")
    follow = left.groupBy(head.alias("h")).agg(F.sum("left").alias("follow"), F.count("*").alias("kinds"))
    known = left.withColumn("h", head).join(follow, "h").select(F.col("t").alias("part"), F.struct(F.length("t").alias("size"), "left", "follow", "kinds").alias("x"))
    size = F.length("t")
    chain = wanted.select("t", F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("t", i, size))).alias("part")).join(known, "part")
    back = lambda p, x: (F.greatest(x["left"] - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * x["kinds"] * p) / x["follow"]
    return chain.groupBy("t").agg(F.aggregate(F.array_sort(F.collect_list("x")), F.lit(1 / ALPHABET), back).alias("p"))  # ORDER rows a group at most


def log_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (gram, ratio, seen) of grams with more counts than the discount, and (context, ratio, seen) of contexts whose ratio is not 0; seen: in so many documents.  Then the tables to release after these."""
    head = F.expr("substring(gram, 1, length(gram) - 1)")
    rest = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))
    sums = counts.groupBy(head.alias("context")).agg(F.sum("toxic").alias("wa"), F.sum("ordinary").alias("wb"), rest("toxic").alias("ra"), rest("ordinary").alias("rb"))
    kept = lambda k: F.when(F.col(f"w{k}") > 0, F.col(f"r{k}") / F.col(f"w{k}")).otherwise(1.0)
    ratio = F.log(kept("a") / kept("b"))
    sums = stash(sums.select("*", F.when(F.abs(ratio) > 1e-3, ratio).otherwise(0.0).alias("ratio")), "toxicity-contexts")
    own = stash(counts.where(F.greatest("toxic", "ordinary") > DISCOUNT).withColumn("context", head).withColumn("t", F.expr("substring(gram, 2)")), "toxicity-own")
    shared = shared_probabilities(counts, own.select("t").distinct())
    p = lambda c, k: F.when(F.col(f"w{k}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"w{k}")).otherwise(0.0) + kept(k) * F.col("p")
    both = own.join(sums, "context").join(shared, "t")
    of_gram = both.select("gram", F.log(p("toxic", "a") / p("ordinary", "b")).alias("ratio"), (F.col("toxic") + F.col("ordinary")).alias("seen"))
    return of_gram, sums.where("ratio != 0").select("context", "ratio", (F.col("wa") + F.col("wb")).alias("seen")), [sums, own]


def _number_rows(contexts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = numbers_of(batch.column(0).to_pylist(), contexts).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), contexts, np.int32)), pa.array(numbers), *batch.columns[1:]], names=["kind", "number", "ratio", "bin"])

    return run


def _least_bin(sizes: dict[int, int], size: int) -> int:
    """From which bin on there are ``size`` rows at most."""
    above, least = 0, 1 << 30
    for bin_, n in sorted(sizes.items(), reverse=True):
        if (above := above + n) > size:
            break
        least = bin_
    return least


def whole_model(of_gram: DataFrame, of_context: DataFrame, size: int) -> Model | Tables:
    """All rows (name, ratio, seen): as sorted arrays those seen most, up to ``size`` of each by a histogram of seen's logarithm; the others, if any, as a table."""
    binned = [t.select(t.columns[0], F.col("ratio").cast("float"), F.floor(F.log2("seen") * 64).cast("int").alias("bin")) for t in (of_gram, of_context)]
    numbered = [t.mapInArrow(_number_rows(bool(k)), "kind int, number long, ratio float, bin int") for k, t in enumerate(binned)]
    table = stash(numbered[0].unionByName(numbered[1]), "toxicity-ratios")
    sizes = [{}, {}]
    for r in table.groupBy("kind", "bin").agg(F.count("*").alias("n")).collect():  # 64 rows a binary order of magnitude at most
        sizes[r["kind"]][r["bin"]] = r["n"]
    least = [_least_bin(s, size) for s in sizes]
    arrays = []
    for k in (0, 1):
        kept = table.where((F.col("kind") == k) & (F.col("bin") >= least[k])).select("number", "ratio").toArrow()
        numbers = kept.column("number").to_numpy().view(np.uint64)
        order = np.argsort(numbers)
        arrays += [numbers[order], kept.column("ratio").to_numpy()[order]]
    common = Model(*arrays, (0.0, 0.0, 0.0))
    if all(b >= low for s, low in zip(sizes, least, strict=True) for b in s):
        release(table)
        return common
    rest = table.where(F.col("bin") < F.when(F.col("kind") == 0, least[0]).otherwise(least[1])).select("kind", "number", "ratio")
    return Tables(common, rest, slot_map(rest, "number", REST_BITS), common.weights)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of y on the evidence and the mean log ratio, by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), np.sqrt(x[:, 0]) * 10, np.clip(x[:, 1], -0.5, 0.5)])
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step * min(1, 2 / (np.abs(step).max() + 1e-9))
    return tuple(map(float, w))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, size: int = MODEL) -> Model | Tables:
    """Learn from all labelled documents that are not held out; fit the curve to at most so many of each class; ``size`` grams and contexts each are broadcast, the rest is joined."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    usable = stash(usable, "toxicity-labels")
    if usable.count() <= BROADCAST_LABELS:
        usable = F.broadcast(usable)
    texts = stash(docs.select("doc_id", "text").join(usable, "doc_id").select("doc_id", "toxic", "text"), "toxicity-texts")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        release(texts)
        return make_model({}, {}, (30.0 if sizes.get(1) else -30.0, 0.0, 0.0))
    counts = stash(gram_counts(texts), "toxicity-grams")
    of_gram, of_context, parts = log_ratios(counts)
    model = whole_model(of_gram, of_context, size)
    drawn = lambda toxic, most: texts.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = stash(drawn(1, max_toxic).unionByName(drawn(0, max_ordinary)).select("toxic", "text"), "toxicity-sample")
    judged = features(sample, model)
    found = judged.toPandas()
    release(texts, counts, sample, judged, *parts)
    return model._replace(weights=_fit_curve(found[["evidence", "log_ratio"]].to_numpy(), found["toxic"].to_numpy(float)))


def _score(model: Model | Tables, log_ratio: Column, evidence: Column) -> Column:
    a, b, c = model.weights
    return 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.sqrt(evidence) * 10 + F.lit(c) * F.greatest(F.least(log_ratio, F.lit(0.5)), F.lit(-0.5)))))


def score(docs: DataFrame, model: Model | Tables) -> DataFrame:
    """Rows (doc_id, n_words, log_ratio, evidence, score)."""
    rows = features(docs.select(F.col("doc_id"), F.col("text")), model)
    return rows.withColumn("score", _score(model, F.col("log_ratio"), F.col("evidence")))


def reject(docs: DataFrame, model: Model | Tables, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns; :func:`release` of the result deletes what it was made from."""
    rows = features(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text")), model)
    out = rows.where(_score(model, F.col("log_ratio"), F.col("evidence")) < threshold).select("row.*")
    out._parts = getattr(rows, "_parts", [])
    return out
