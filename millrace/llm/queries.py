"""The registered queries over the operators of this folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, exact_dedup, fingerprints, license_scan, mixing, ngram_join, pii, secret_scan, toxicity, url_filter
from millrace.llm.common import stash


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path and piece pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, then the thousand that the id is in."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return license_scan.scan(read(spark, sf_dir, "documents").withColumn("path", path))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="max").drop("ties")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), *tokenizer()).drop("whole")


#: Stands for a key that would come from a secret store.
PSEUDONYM_KEY = "example-key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(pii.found_values(text)).cast("long").alias("n_replaced"), pii.pseudonym_text(text, PSEUDONYM_KEY).alias("text"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))


#: Words, sets of 5-word shingles, linked pairs, and the least document that each one reaches.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.other = l.u
)
SELECT doc_id, len(s) AS n_shingles, least_id AS component_id
FROM sets JOIN (SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id) USING (doc_id)
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    counts = [secret_scan.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.concat("base", "random")).alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source gets the same share of as many characters as there are.  The mixed documents are written whole; the rows name them."""
    mixed = stash(mixing.mix(read(spark, sf_dir, "documents")), "mixed")
    return mixed.select("doc_id", "source", F.col("mix_copy").cast("long").alias("copy"))


OP9_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE * (SELECT sum(chars) FROM sizes)
         / (SELECT count(*)::DOUBLE FROM sizes WHERE chars > 0) / chars AS rate
  FROM sizes WHERE chars > 0
), cut AS (
  SELECT source, greatest(ceil(rate / 16), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 16), 1) AS rate FROM rates
), terms AS (
  SELECT source, parts, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM cut
  UNION ALL
  SELECT source, parts, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM terms WHERE k < 99
), steps AS (
  SELECT source, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY source
), draws AS (
  SELECT d.doc_id, d.source, s.cdfs,
         unnest(list_transform(range(s.parts), lambda i:
           (('0x' || substr(md5('7|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || i::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5)
           / 281474976710656.0)) AS u
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
), counts AS (
  SELECT doc_id, source, sum(len(list_filter(cdfs, lambda c: c <= u)))::BIGINT AS n FROM draws GROUP BY doc_id, source
)
SELECT doc_id, source, unnest(range(n)) AS copy FROM counts WHERE n > 0
"""

#: The rules of the URL query: host and path, and the verdict.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES, url_filter.train(spark)).drop("score")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_fingerprints": op2_fingerprints,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_pii": op6_pii,
    "op7_ngram_join": op7_ngram_join,
    "op8_secret_scan": op8_secret_scan,
    "op9_mixing": op9_mixing,
    "op10_url_filter": op10_url_filter,
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op7_ngram_join": OP7_SQL, "op9_mixing": OP9_SQL}
