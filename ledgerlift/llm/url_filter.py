"""URL filters: explicit rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep_others, table
from ledgerlift.session import stored

#: Most rows that the trees are fitted on, drawn by a hash of the url.
SAMPLE_ROWS = 20_000
#: verdict, host, path; the longest that fits wins.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "path_depth", "host_labels", "digit_ratio",
    "host_digit_ratio", "punctuation_ratio", "host_entropy", "path_entropy", "parameters", "has_fragment", "has_port",
    "secure", "longest_label", "suffix_rate", "suffix_share", "extension",
]


def host_and_path(url: str = "url") -> dict[str, Column]:
    """host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: from there up to ? or #."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": lower, "path": path}


def fits(host: str, path: str) -> Column:
    """True for the rule's host and its subdomains where the path starts with the rule's."""
    here = (F.col("host") == host) | F.col("host").endswith("." + host)
    return here & F.col("path").startswith(path)


def by_rules(rules=RULES) -> dict[str, Column]:
    """rule (such as net/) and its verdict, null where no rule fits."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: reduce(lambda other, r: F.when(fits(r[1], r[2]), value(r)).otherwise(other), longest[::-1], F.lit(None).cast("string"))
    return {"rule": pick(lambda r: F.lit(r[1] + r[2])), "rule_verdict": pick(lambda r: F.lit(r[0]))}


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    bits = F.aggregate(counts, F.lit(0.0), lambda s, k: s + F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """The features that need no statistics, beside the columns of `df` (which has host and path)."""
    link = F.coalesce(F.col(url), F.lit(""))
    n = lambda c: F.length(c).cast("double")
    share = lambda c, pattern: F.when(F.length(c) > 0, F.regexp_count(c, F.lit(pattern)) / F.length(c)).otherwise(0.0)
    query = F.regexp_extract(link, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return df.withColumns({
        "url_length": n(link), "host_length": n(F.col("host")), "path_length": n(F.col("path")), "query_length": n(query),
        "path_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "digit_ratio": share(link, "[0-9]"), "host_digit_ratio": share(F.col("host"), "[0-9]"),
        "punctuation_ratio": share(link, r"[^0-9A-Za-z/.:]"),
        "host_entropy": entropy(F.col("host")), "path_entropy": entropy(F.col("path")),
        "parameters": F.regexp_count(query, F.lit("[^&=]+=")).cast("double"),
        "has_fragment": F.locate("#", link).cast("boolean").cast("double"),
        "has_port": F.col("host").rlike(":[0-9]+$").cast("double"),
        "secure": F.startswith(link, F.lit("https:")).cast("double"),
        "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "suffix": F.regexp_extract("host", r"([^.:]*)(:[0-9]*)?$", 1),
    })


class UrlFilter:
    """Fitted trees and the suffix statistics (suffix, suffix_rate, suffix_share) that two of their features come from."""

    def __init__(self, model: GBTClassificationModel | None, suffixes: DataFrame | None, rate: float):
        self.model, self.suffixes, self.rate = model, suffixes, rate

    def features(self, df: DataFrame) -> DataFrame:
        rows = df.drop("suffix_rate", "suffix_share").join(self.suffixes, "suffix", "left")
        rows = rows.fillna({"suffix_rate": self.rate, "suffix_share": 0.0})
        return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)

    def judge(self, df: DataFrame) -> DataFrame:
        """Adds blocked_score (0 to 1) to rows with lexical features."""
        if self.model is None:
            return df.withColumn("blocked_score", F.lit(self.rate))
        out = self.model.transform(self.features(df))
        from pyspark.ml.functions import vector_to_array

        return out.withColumn("blocked_score", vector_to_array("probability")[1])


def fit(rows: DataFrame, label: str = "label", url: str = "url", rounds: int = 12, depth: int = 4) -> UrlFilter:
    """Trees for `label` (1: block, null: not known) from rows with host, path and lexical features.

    The trees are fitted on at most about SAMPLE_ROWS labelled rows, drawn by a hash of the url. Suffix
    statistics are the smoothed share of blocked urls among all labelled ones and the share of all urls,
    counted over all rows for every suffix (the last label of the host). With no labelled rows, or one
    label alone, there are no trees and every url gets that label's rate.
    """
    labelled = rows.where(F.col(label).isNotNull())
    total, n, rate = rows.agg(F.count(F.lit(1)), F.count(label), F.avg(label)).first()
    if not n:
        return UrlFilter(None, None, 0.0)
    if rate in (0.0, 1.0):
        return UrlFilter(None, None, float(rate))
    chance = min(1.0, SAMPLE_ROWS / n)
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("url"), url), F.lit(1 << 30)) < int(chance * (1 << 30)))
    blocked = F.coalesce(F.sum(label), F.lit(0.0)) + 10 * rate
    stats = rows.groupBy("suffix").agg(
        (blocked / (F.count(label) + 10)).alias("suffix_rate"), (F.count(F.lit(1)) / total).alias("suffix_share")
    )
    # written, so that a join knows its size
    stats = stored(stats, "suffixes")
    empty = UrlFilter(None, stats, float(rate))
    trees = GBTClassifier(
        labelCol=label, featuresCol="_features", maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=64, seed=5
    )
    train = empty.features(sample).select("_features", F.col(label).cast("double").alias(label)).cache()
    try:
        return UrlFilter(trees.fit(train), stats, float(rate))
    finally:
        train.unpersist()


def filter_urls(df: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Rows of `df` with host, path, rule, verdict (allow or block) and blocked_score added.

    A url that a rule fits gets the longest rule's verdict; these urls are also the labelled ones that the
    trees are fitted on, and the trees judge all others, blocking at a score of one half or more. A null url
    and one without :// have an empty host and path, fit no rule and are judged like any other by their
    features (lengths of 0). Repeated urls get equal verdicts. Input columns with the names of the added
    ones are replaced; an empty table gives no rows.
    """
    added = ["host", "path", "rule", "verdict", "blocked_score"]
    rest = keep_others(df, added + FEATURES + ["rule_verdict", "suffix", "_features", "rawPrediction", "probability", "prediction"])
    rows = df.select(*rest).withColumns(host_and_path(url)).withColumns(by_rules(rules))
    rows = lexical(rows, url)
    # null where no rule fits
    labels = rows.withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    scored = fit(labels, url=url).judge(rows)
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked_score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*rest, *added)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "blocked_score"
    )
