"""URL verdicts by rules and gradient-boosted trees (operator 3, DataFrame functions only).

Rules decide what they cover; the longest one that fits wins. The URLs they cover are also
the labelled examples from which boosted trees learn lexical features of the rest: lengths,
depth, digit ratio, entropy, parameter counts and statistics of host suffixes and of the path's first
segment. All features
are Spark expressions, suffix statistics come from grouped counts, and the trees are Spark
ML's, trained on at most about ``rows`` labelled URLs. The statistics count all labelled URLs.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
judged by the trees as an empty string would be; rows are judged one by one, so repeated rows
and null ids need no care; an empty table gives an empty result; with no labelled URL, or labels
of one kind only, there are no trees and what no rule covers is allowed or gets that
one kind; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.store import table

#: At most about this many labelled URLs train the trees, chosen by a hash of the URL.
LABELLED_ROWS = 20_000
#: Suffix statistics are kept for suffixes with at least this many labelled URLs.
LEAST_SUFFIX = 5
SEED, FOLD_SEED = 17, 19
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)
_UPPER = "".join(map(chr, range(65, 91)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, allow), else null."""
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.allow).alias("allow"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the characters of ``text``."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars)
    # In sorted characters the runs are the counts: count log count is summed run by run.
    start = F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("char"), F.lit(0.0).alias("run"))
    xlogx = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    folded = F.aggregate(
        chars,
        start,
        lambda s, c: F.when(c == s["char"], F.struct(s["sum"].alias("sum"), c.alias("char"), (s["run"] + 1.0).alias("run"))).otherwise(F.struct((s["sum"] + xlogx(s["run"])).alias("sum"), c.alias("char"), F.lit(1.0).alias("run"))),
        lambda s: s["sum"] + xlogx(s["run"]),
    )
    return F.when(n > 0, F.log2(n.cast("double")) - folded / n).otherwise(0.0)


def lexical(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the lexical features of columns ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    count = lambda text, chars: F.length(text) - F.length(F.regexp_replace(text, chars, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    made = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": count(F.col("path"), "/"),
        "labels": count(F.col("host"), r"\."),
        "digit_ratio": count(url, "[^0-9]").cast("double") * -1 / F.greatest(F.length(url), F.lit(1)) + 1,
        "host_digits": count(F.col("host"), "[0-9]"),
        "hyphens": count(F.col("host"), "-"),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "has_fragment": url.contains("#").cast("int"),
        "secure": url.startswith("https:").cast("int"),
        "file_like": url.rlike(r"\.\w{2,5}$").cast("int"),
        "trailing_slash": F.col("path").endswith("/").cast("int"),
        "host_entropy": entropy(F.col("host")),
        "path_entropy": entropy(F.col("path")),
    }
    return urls.withColumns({k: v.cast("double") for k, v in made.items()}), list(made)


def suffixes(host: Column) -> Column:
    """The last one, two and three labels of a host, and the host without its first label's name."""
    return F.array(*(F.substring_index(host, ".", -n) for n in (1, 2, 3)))


def segment(path: Column) -> Column:
    """The first segment of a path, with its slash: statistics keep it apart from hosts by that."""
    return F.concat(F.lit("/"), F.regexp_extract(path, r"^/([^/]*)", 1))


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(FOLD_SEED), host), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """suffix (or first segment of the path), and for all hosts and without each fold of hosts the smoothed share of blocked URLs, 0.5 if fewer than ``LEAST_SUFFIX`` are left."""
    each = labelled.select("label", fold_of(F.col("host")).alias("fold"), F.explode(F.array_distinct(F.concat(suffixes(F.col("host")), F.array(segment(F.col("path")))))).alias("suffix"))
    counted = each.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("b"), *(x for f in range(FOLDS) for x in (F.count_if(F.col("fold") == f).alias(f"n{f}"), F.sum(F.when(F.col("fold") == f, F.col("label")).otherwise(0.0)).alias(f"b{f}"))))
    share = lambda n, b: F.when(n >= LEAST_SUFFIX, (b + 1) / (n + 2)).otherwise(0.5)
    without = F.array(*(share(F.col("n") - F.col(f"n{f}"), F.col("b") - F.col(f"b{f}")) for f in range(FOLDS)))
    return counted.where(F.col("n") >= LEAST_SUFFIX).select("suffix", share(F.col("n"), F.col("b")).alias("share"), without.alias("without"))


SUFFIX_NAMES = ["suffix1", "suffix2", "suffix3"]


def host_shares(hosts: DataFrame, shares: DataFrame) -> DataFrame:
    """host and the shares of its suffixes, for each distinct host: of all URLs, and (``known_``) of those outside its own fold.

    The second kind describes labelled URLs to the trees, so that no label is part of its own feature. 0.5 for suffixes without statistics.
    """
    out = hosts.select("host").distinct()
    for i, name in enumerate(SUFFIX_NAMES):
        named = shares.select("suffix", F.col("share").alias(name), F.col("without").alias(f"known_{name}"))
        out = out.withColumn("suffix", suffixes(F.col("host"))[i]).join(named, "suffix", "left").drop("suffix")
    half = F.lit(0.5)
    return out.select("host", *(F.coalesce(name, half).alias(name) for name in SUFFIX_NAMES), *(F.coalesce(F.col(f"known_{name}")[fold_of(F.col("host"))], half).alias(f"known_{name}") for name in SUFFIX_NAMES))


def with_shares(urls: DataFrame, by_host: DataFrame, shares: DataFrame, known: bool = False) -> tuple[DataFrame, list[str]]:
    """Adds the shares of the host's suffixes and of the path's first segment, ``known`` those without the host's own fold.

    Few hosts or segments are broadcast, else the adaptive skew join splits those of many URLs.
    """
    out = urls.join(by_host.select("host", *(F.col(f"known_{x}" if known else x).alias(x) for x in SUFFIX_NAMES)), "host", "left")
    share = F.col("_without")[fold_of(F.col("host"))] if known else F.col("_share")
    out = out.withColumn("_segment", segment(F.col("path"))).join(shares.select(F.col("suffix").alias("_segment"), F.col("share").alias("_share"), F.col("without").alias("_without")), "_segment", "left")
    return out.withColumn("segment_share", F.coalesce(share, F.lit(0.5))).drop("_segment", "_share", "_without"), [*SUFFIX_NAMES, "segment_share"]


def fit(labelled: DataFrame, inputs: list[str], trees: int = 20, depth: int = 4) -> GBTClassificationModel:
    """Boosted trees on ``inputs`` for the 0/1 ``label``."""
    made = VectorAssembler(inputCols=inputs, outputCol="features").transform(labelled).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=32, subsamplingRate=0.8, seed=SEED, cacheNodeIds=False).fit(made)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = LABELLED_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and, for URLs judged by the trees, the probability of a block."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.when(F.col("r.allow"), "allow").when(~F.col("r.allow"), "block")
    labelled = urls.where("r is not null").select("url", "host", "path", (~F.col("r.allow")).cast("double").alias("label"))
    n = labelled.count()
    h = F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(1_000_000))
    ruled_urls, labelled = labelled, labelled.where(h < int(min(1.0, rows / max(n, 1)) * 1_000_000))
    kinds = sorted(r[0] for r in labelled.select("label").distinct().limit(2).collect())
    if len(kinds) < 2:
        default = "block" if kinds == [1.0] else "allow"
        return urls.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(ruled, F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    shares = table(suffix_statistics(ruled_urls), "suffix-shares")
    by_host = table(host_shares(urls, shares), "host-shares")
    known, inputs = lexical(labelled)
    known, more = with_shares(known, by_host, shares, known=True)
    model = fit(known, inputs + more)
    asked, _ = lexical(urls)
    asked, _ = with_shares(asked, by_host, shares)
    judged = model.transform(VectorAssembler(inputCols=inputs + more, outputCol="features").transform(asked))
    probability = vector_to_array("probability")[1]
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce(ruled, F.when(F.col("prediction") > 0, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("r").isNull(), probability).alias("block_probability"),
    )
