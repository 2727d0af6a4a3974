"""Mixing sources to target weights by Poisson replication.

A source with share ``w`` of the mix and ``c`` of ``total`` characters is repeated
at the mean rate ``w * budget / c``.  Each document draws its number of copies by
inverting the Poisson distribution at a uniform number seeded by a hash of its
identifier, so reruns and lost executors give the same copies.  Documents are
exploded by their counts and dealt out by a hash of (identifier, copy), then
sorted by it within partitions: a global shuffle in one exchange.

Rates above ``PART`` are cut into equal parts with a draw of their own each, since a
sum of Poisson variables is Poisson; ``exp(-rate)`` never underflows and no count is
capped.

Defined cases: a null source is a source of its own; a null text counts as empty;
a null identifier draws as the text 'null'; rows that repeat an identifier draw
alike; a source without characters has rate 0, as has one whose target is 0; a
target for an absent source is left out and the others are scaled up; an empty
table stays empty; very long texts travel as they are; further columns are carried through, whatever their
names: only a ``mix_copy`` or ``mix_order`` of the input gives way to the one that is made, and not with ``places``
off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shuffle_partitions, stash

#: Largest mean that one draw inverts.
PART = 16
#: Number of sources up to which their rates are broadcast; beyond, they are joined.
BROADCAST_SOURCES = 100_000
#: Hex digits of the digest that make a uniform number: 48 bits, exact in a double.
DIGITS = 12


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts joined by '|'."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("double")
    return (bits + 0.5) / float(16**DIGITS)


def poisson_quantile(rate: Column, u: Column) -> Column:
    """Least k with P(X <= k) > u for X ~ Poisson(rate), rate <= PART.

    The sum of terms ends where it can't grow in double arithmetic: at rate 16
    the terms beyond k = 100 are below 1e-45.
    """
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(s: Column, _: Column) -> Column:
        p = s["p"] * rate / (s["k"] + 1)
        return F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + F.when(s["cdf"] <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, step, lambda s: s["n"])


def source_rates(docs: DataFrame, targets: dict[str | None, float] | None, budget: float | None, source: str = "source", text: str = "text") -> DataFrame:
    """Rows (source, n_chars, rate).  targets None: every source has the same weight.  budget None: as many characters as there are."""
    sizes = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("__chars"))
    sizes = stash(sizes, "source-sizes")
    if targets is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("__weight", F.when(F.col("__chars") > 0, weight).otherwise(0.0))
    total = sizes.agg(F.sum("__chars").alias("chars"), F.sum("__weight").alias("weight")).first()
    whole, weights = float(budget if budget is not None else total["chars"] or 0), float(total["weight"] or 0)
    rate = F.when(F.col("__weight") > 0, F.col("__weight") * F.lit(whole) / F.lit(weights or 1.0) / F.col("__chars")).otherwise(0.0)
    return sizes.select("__source", "__chars", rate.alias("__rate"))


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, budget: float | None = None, seed: int = 7, doc_id: str = "doc_id", source: str = "source", text: str = "text", places: bool = True) -> DataFrame:
    """The mixed documents: the input columns, then, with ``places``, ``mix_copy`` (from 0) and ``mix_order`` (long, the place in the shuffle)."""
    spark = docs.sparkSession
    rates = stash(source_rates(docs, targets, budget, source, text), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("ident"), F.col(source).alias("source"))
    rows = rows.join(rates, F.col("source").eqNullSafe(F.col("__source")))
    parts = F.greatest(F.ceil(F.col("__rate") / PART), F.lit(1))
    draw = lambda i: poisson_quantile(F.col("__rate") / parts, uniform(F.lit(str(seed)), F.col("ident"), i.cast("string")))
    count = F.aggregate(F.sequence(F.lit(0).cast("bigint"), parts - 1), F.lit(0), lambda n, i: n + draw(i))
    rows = rows.withColumn("__n", count).where("__n > 0")
    rows = rows.select("row", "ident", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("mix_copy"))
    rows = rows.withColumn("mix_order", F.xxhash64(F.lit(seed), "ident", "mix_copy"))
    rows = rows.repartition(shuffle_partitions(spark), "mix_order").sortWithinPartitions("mix_order", "mix_copy")
    made = ["mix_copy", "mix_order"] if places else []
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made], *made)
