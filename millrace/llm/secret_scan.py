"""Secret scans: fixed forms, and a battery of randomness tests.

*Base* spans are matches of three fixed forms (an assignment to a telling name, an access
key, a long hexadecimal run).  *Random* spans are other unbroken strings of at least
``MIN_LENGTH`` characters of a text encoding whose characters look drawn at random.
Each candidate's encoding (decimal, hexadecimal, base 32, digits with letters of one or of both
cases, base 64) is inferred from the characters it has, and tested against a uniform
draw from that alphabet: a chi-squared test of the counts, a runs test about
the alphabet's middle and a test of the serial correlation at lag 1.  Fisher's method
joins the three p-values.

A candidate is dismissed as text where the battery rejects randomness; the
rejections' false-discovery rate is held at ``RATE`` by Benjamini and Hochberg's
procedure over all candidates of the corpus, apart for each class of lengths, as
a short string's test has less power.  What is too short for its alphabet
to carry ``MIN_BITS`` bits, or has no digit, is no candidate: a run of letters alone is a word or a name.
The procedure works on a histogram of the p-values, ``BINS`` a class, so its state has a
fixed size; texts are read once and never shuffled.

All of it is SQL functions.  Defined cases: a null text counts as empty and has
no span; random spans that overlap a base span are left out; an empty table stays
empty; rows repeat as they come; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stash
from millrace.llm.spans import matches

# The base forms, each with the group whose length counts and its least length.
BASE = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", None, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", None, 24),
]
MIN_LENGTH, MIN_BITS, RATE = 20, 90, 0.01
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
#: Alphabets by what a candidate may consist of, the first that fits; their characters in order.
ALPHABETS = [
    (r"^[0-9]+$", "0123456789"),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/"),
]
#: Histogram bins of -log10(p), four to a power of ten.
BINS = 240


def base_spans(text: Column) -> Column:
    """Array of (start, end, rank, kind), in the order of the forms."""
    likely = {"assign": text.contains("=") | text.contains(":"), "access": text.contains("AKIA")}

    def of(rank: int, kind: str, pattern: str, group: int | None, least: int) -> Column:
        found = F.filter(matches(text, pattern, group, likely.get(kind)), lambda m: F.length(m["part"]) >= least)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))

    return F.concat(*[of(rank, *form) for rank, form in enumerate(BASE)])


def alphabet_of(value: Column) -> Column:
    out = F.lit(ALPHABETS[-1][1])
    for pattern, letters in reversed(ALPHABETS[:-1]):
        out = F.when(value.rlike(pattern), F.lit(letters)).otherwise(out)
    return out


def upper_tail(z: Column) -> Column:
    """P(Z > z), by the Abramowitz and Stegun formula 26.2.17 (error below 1e-7), by its tail's expansion beyond 6."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    near = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    far = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) / F.greatest(a, F.lit(1.0))
    p = F.when(a < 6, near).otherwise(far)
    return F.when(z >= 0, p).otherwise(1 - p)


def battery(rows: DataFrame) -> DataFrame:
    """Adds ``p`` (Fisher's joint p-value of the three tests) and ``bits`` to rows with a column ``value``."""
    rows = rows.withColumn("__alphabet", alphabet_of(F.col("value"))).withColumn("__k", F.length("__alphabet").cast("double")).withColumn("__n", F.length("value").cast("double"))
    rows = rows.withColumn("__x", F.expr("transform(filter(split(value, ''), c -> c != ''), c -> cast(instr(__alphabet, c) as double))"))
    n, k, x = F.col("__n"), F.col("__k"), F.col("__x")
    squares = F.expr("aggregate(transform(array_distinct(__x), a -> pow(size(filter(__x, b -> b = a)), 2)), 0D, (s, v) -> s + v)")
    chi, df = k / n * squares - n, k - 1
    z_chi = (F.pow(F.greatest(chi / df, F.lit(1e-9)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    rows = rows.withColumn("__high", F.expr("transform(__x, v -> v > __k / 2)"))
    up = F.expr("cast(size(filter(__high, h -> h)) as double)")
    runs = F.expr("1D + size(filter(sequence(1, size(__high) - 1), i -> __high[i] != __high[i - 1]))")
    mean_runs = 2 * up * (n - up) / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    z_runs = F.when(var_runs > 1e-9, (runs - mean_runs) / F.sqrt(F.greatest(var_runs, F.lit(1e-9)))).otherwise(F.sqrt(n))
    mean = F.expr("aggregate(__x, 0D, (s, v) -> s + v) / __n")
    rows = rows.withColumn("__m", mean)
    cross = F.expr("aggregate(sequence(1, size(__x) - 1), 0D, (s, i) -> s + (__x[i] - __m) * (__x[i - 1] - __m))")
    spread = F.expr("aggregate(__x, 0D, (s, v) -> s + (v - __m) * (v - __m))")
    z_serial = F.when(spread > 1e-9, (cross / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    log_p = F.lit(0.0)
    for p in (upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial))):
        log_p += F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-100)))
    rows = rows.withColumn("__half", -log_p)  # half of Fisher's statistic, chi-squared with 6 degrees of freedom
    half = F.col("__half")
    joint = F.exp(-half) * (1 + half + half * half / 2)
    return rows.withColumn("p", F.greatest(joint, F.lit(1e-60))).withColumn("bits", n * F.log2(k)).drop("__alphabet", "__k", "__n", "__x", "__high", "__m", "__half")


def length_class(value: Column) -> Column:
    """Classes that double in length; from 20, 28, 40, 56, 80, ... characters."""
    return F.floor(2 * F.log2(F.length(value) / MIN_LENGTH)).cast("int")


def candidates(rows: DataFrame) -> DataFrame:
    """One row a candidate of rows (__row, base, found): __row, start, end, value, p, bits, class, and whether it is clear of base spans."""
    found = rows.select("__row", "base", F.explode("found").alias("m")).select("__row", "base", "m.start", "m.end", "m.value")
    found = found.where(F.col("value").rlike("[0-9]"))
    clear = ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    found = battery(found.withColumn("clear", clear).drop("base")).where(F.col("bits") >= MIN_BITS)
    return found.withColumn("class", length_class(F.col("value")))


def p_bin(p: Column) -> Column:
    return F.least(F.floor(-4 * F.log10(p)), F.lit(BINS - 1)).cast("int")


def thresholds(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per class of lengths the least p-value bin from which candidates are rejected as text.

    Benjamini and Hochberg: the largest p with p <= rate * (candidates up to p) / (all candidates).
    A bin's least p stands for it, so the rate is kept.
    """
    counts: dict[int, dict[int, int]] = {}
    for r in found.groupBy("class", p_bin(F.col("p")).alias("bin")).count().collect():  # BINS rows a class at most
        counts.setdefault(r["class"], {})[r["bin"]] = r["count"]
    out = {}
    for c, bins in counts.items():
        total, upto = sum(bins.values()), 0
        cut = BINS
        for b in sorted(bins, reverse=True):
            upto += bins[b]
            if 10 ** (-b / 4) <= rate * upto / total:
                cut = b
        out[c] = cut
    return out


def scan(docs: DataFrame, rate: float = RATE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, base, random): arrays of (start, end, rank, kind), sorted by start and kind."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.array_sort(base_spans(text)).alias("base"), matches(text, CANDIDATE).alias("found"), F.monotonically_increasing_id().alias("__row"))
    rows = stash(rows, "secret-spans")
    found = stash(candidates(rows), "secret-candidates")
    cut = F.lit(BINS)
    for c, least in thresholds(found, rate).items():
        cut = F.when(F.col("class") == c, F.lit(least)).otherwise(cut)
    span = F.struct("start", "end", F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind"))
    random = found.where(F.col("clear") & (p_bin(F.col("p")) < cut)).groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("random"))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")
    return rows.join(random, "__row", "left").select("doc_id", "base", F.coalesce("random", none).alias("random"))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas, by start and kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"].alias("rank"), s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
