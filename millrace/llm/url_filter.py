"""URL filters: host and path rules, then a logistic regression on hashed character n-grams.

Rules come first: the longest one that fits decides.  Every other URL is judged by
a logistic regression over the hashed character n-grams of its host and path,
trained from a small labelled table of URLs.  All of it is DataFrame operations.

Defined cases: a URL that is null or has no ``://`` has an empty host and path,
fits no rule and is judged on these; of rules of equal length the first in the
alphabet decides; rows repeat as they come; an empty table stays empty; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES, SHORTEST, LONGEST = 1 << 14, 3, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Names that the training table is made from.
UNWANTED = "casino poker bets betting jackpot slots win-money lottery pills pharma viagra cheap-meds adult xxx porn sex-cams escort dating-hot spam spam-links link-farm seo-farm ads adserver ad-track tracker clicks popunder banner-ads free-money free-gifts get-rich loans-fast crack-keys warez torrent-free fake-shop replica-watch".split()
WANTED = (
    "news weather library school garden kitchen travel museum science history sports music photo radio bank post city river forest market health doctor family culture letters archive journal lecture council theatre bridge island harvest village station planet physics grammar dictionary wiki docs manual open-data "
    "the that than this there these their them then thing think other another where which while with within about after again before being between both could every first from great have here house into just know large last little long made make many more most never night only other over own part people place right same should small some state still such take tell time under until water well what when will woman work world would write year young"
).split()
MARKS = "www. m. blog. shop.".split()
ENDS = "example.com example.net example.org".split()
PATHS = ["/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2"]


def training_urls() -> list[tuple[str, int]]:
    """The labelled table: every name under some host forms and paths."""
    out = []
    for label, names in ((1, UNWANTED), (0, WANTED)):
        for i, name in enumerate(names):
            for j, form in enumerate(("{m}{n}.{e}", "{n}.{e}", "{m}{n}-{i}.{e}")):
                host = form.format(m=MARKS[(i + j) % 4], n=name, e=ENDS[(i + j) % 3], i=(i * 37 + j) % 90)
                out.append((f"https://{host}{PATHS[(i + 2 * j) % 5].format((i * 911 + j * 57) % 9000)}", label))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (rule, verdict) that fits a host or a domain above it and starts the path; nulls without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rule = verdict = F.lit(None).cast("string")
    for text, what in reversed(ordered):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def character_ngrams(host: Column, path: Column) -> Column:
    """n-grams of ^host$ and of the path, which carry a mark of where they are from."""
    h, p = F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("|"), path)
    cut = lambda s, n: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: s.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    of_host = F.concat(*[cut(h, n) for n in range(SHORTEST, LONGEST + 1)])
    of_path = F.concat(*[cut(p, n) for n in range(SHORTEST, LONGEST + 1)])
    return F.concat(of_host, F.transform(of_path, lambda g: F.concat(F.lit("/"), g)))


def _features(rows: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    return rows.withColumn("host", host).withColumn("path", path).withColumn("ngrams", character_ngrams(F.col("host"), F.col("path")))


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> PipelineModel:
    """Fit to a table of (url, 1 for unwanted), which is small by its making."""
    rows = spark.createDataFrame(labelled or training_urls(), "url string, label int").coalesce(1)
    stages = [HashingTF(inputCol="ngrams", outputCol="features", numFeatures=FEATURES, binary=True), LogisticRegression(maxIter=40, regParam=0.003)]
    return Pipeline(stages=stages).fit(_features(rows, "url"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: PipelineModel, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score): the rule's verdict, else block where the score is over one half."""
    rows = _features(pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")), "url")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = model.transform(rows.withColumn("rule", rule).withColumn("__verdict", verdict))
    score = F.element_at(vector_to_array("probability"), 2)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("__verdict", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
