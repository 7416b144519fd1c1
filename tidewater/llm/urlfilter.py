"""URL filters: rules first, then gradient-boosted trees on lexical features.

The trees are Spark's own GBTClassifier, fitted on a bounded sample of labelled URLs
(``train_rows``, drawn by a hash of the URL and the row's id, so a URL that many pages share stays bounded too); every URL is judged.
Where no labelled URLs are given, those that a rule fits are labelled with its verdict; the rules look at the path's
language, which no feature holds, so such trees can be worse than to allow all: give ``labelled`` for a filter of use. Features are lengths, depths,
digit ratio, host entropy, parameter counts, and for host and file suffixes the smoothed share of
blocked URLs among all labelled URLs; the planner picks the join by a table's size. Everything runs as DataFrame functions inside the JVM.

Ties: of rules of equal length the later one in the list wins; a probability of one half is block.

Defined results: a URL of any length is judged whole; a null URL, or one without ``://``, has an empty host and path, fits no rule and
is judged by the trees on its features as they are; repeated rows are judged alike; labels of one
class only, or none, make the trees a constant (allow if there is none); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import stage

#: (rule, verdict): host, then path; the longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SUFFIXES = ("tld", "domain", "site", "extension")
NUMBERS = ("url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "host_digits", "hyphens", "host_entropy", "n_params", "has_fragment", "is_https")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits a character, over letters, digits, dots and hyphens."""
    n = F.greatest(F.length(text), F.lit(1))
    total = F.lit(0.0)
    for c in _LOWER + "0123456789.-":
        p = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / n
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def features(urls: DataFrame, url_col: str) -> DataFrame:
    """Add the columns of NUMBERS and SUFFIXES to a table that has ``host`` and ``path``."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    query, n = F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.greatest(F.length(url), F.lit(1))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    many = lambda c, x: F.length(c) - F.length(F.translate(c, x, ""))
    made = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "host_depth": many(host, "."), "path_depth": many(path, "/"), "digit_ratio": digits(url) / n, "host_digits": digits(host), "hyphens": many(host, "-"), "host_entropy": _entropy(host),
        "n_params": F.when(F.length(query) > 0, many(query, "&") + 1).otherwise(0), "has_fragment": url.contains("#").cast("int"), "is_https": url.startswith("https").cast("int"),
    }
    out = urls.withColumns({k: v.cast("double") for k, v in made.items()})
    return out.withColumns({"tld": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2), "site": F.substring_index(host, ".", -3), "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)})


def label(ruled: Column) -> Column:
    """1 blocked, 0 allowed, null unlabelled: the rule's verdict."""
    return F.when(ruled["verdict"] == "block", 1).when(ruled["verdict"] == "allow", 0)


def _with_statistics(rows: DataFrame, tables: dict[str, DataFrame], prior: float) -> DataFrame:
    for name, statistics in tables.items():
        rows = rows.join(statistics, name, "left").withColumn(f"{name}_share", F.coalesce(f"{name}_share", F.lit(prior)))
    return rows


def suffix_shares(known: DataFrame, url_col: str, prior: float) -> dict[str, DataFrame]:
    """For each of SUFFIXES the smoothed share of blocked URLs over all of ``known``, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("kind"), F.col(s).alias("suffix")) for s in SUFFIXES))).alias("_p")
    sums = features(known, url_col).select(pairs, "label").groupBy("_p.kind", "_p.suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    sums = stage(sums.select("kind", "suffix", ((F.col("blocked") + 5 * prior) / (F.col("n") + 5)).alias("share")), "suffixes")
    # Each table is staged alone, so that its size is known to the planner.
    return {s: stage(sums.filter(F.col("kind") == s).select(F.col("suffix").alias(s), F.col("share").alias(f"{s}_share")), s) for s in SUFFIXES}


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, train_rows: int = 20_000, seed: int = 7, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: id, host, path, rule, verdict, and the trees' probability of block.

    ``labelled`` is (url, label) with 1 for block; without it, the pages that a rule fits are the labelled URLs.
    """
    ruled = lambda df, u: df.withColumn("host", host_of(F.col(u))).withColumn("path", path_of(F.col(u))).withColumn("_ruled", match_rules(F.col("host"), F.col("path"), rules))
    slim = pages.select(pages[id_col].alias("_id"), pages[url_col].cast("string").alias("_url"))
    every = ruled(slim, "_url")
    if labelled is None:
        known = every.withColumn("label", label(F.col("_ruled")).cast("double"))
    else:
        known = ruled(labelled.select(F.lit(None).alias("_id"), F.col("url").alias("_url"), F.col("label").cast("double").alias("label")).distinct(), "_url")
    known = known.filter("label is not null").select("_id", "_url", "host", "path", "label")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        constant = F.lit(next(iter(counts), 0.0))
        judged = every.withColumn("block_probability", constant)
    else:
        total = sum(counts.values())
        sample = known.filter(F.pmod(F.xxhash64("_url", "_id", F.lit(seed)), F.lit(total)) < train_rows)
        sample = stage(features(sample, "_url"), "labelled")
        prior = counts.get(1.0, 0) / total
        tables = suffix_shares(known, "_url", prior)
        inputs = [*NUMBERS, *(f"{s}_share" for s in SUFFIXES)]
        to_vector = VectorAssembler(inputCols=inputs, outputCol="_features")
        train = stage(_with_statistics(sample, tables, prior).select("label", *inputs).repartition(4, *inputs), "training")
        model = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=16, maxDepth=4, stepSize=0.3, maxBins=32, seed=seed).fit(to_vector.transform(train))
        judged = model.transform(to_vector.transform(_with_statistics(features(every, "_url"), tables, prior))).withColumn("block_probability", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_ruled.verdict"), F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_ruled.rule").alias("rule"), verdict.alias("verdict"), "block_probability")
