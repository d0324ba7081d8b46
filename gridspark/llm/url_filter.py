"""URL filters: rules by host and path, else the host's reputation (empirical Bayes).

Labelled page outcomes (good or bad) are counted by host. A beta-binomial prior shrinks every level towards
the one above it: host to registered domain to public suffix to the whole corpus. The strength of each level's
prior is estimated from the counts by moments. A page is blocked when the upper posterior bound of its host's
share of good pages, a quantile of the beta posterior, is below a stated part of the whole corpus' share.

Only DataFrame functions are used. The counts have one row for each host; hot hosts are counted with partial
aggregates, and the join back to the pages is an ordinary equi-join whose large partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many become one expression; more are joined by host.
MAX_INLINE_RULES = 256
#: Public suffixes of two labels; all others are the last label.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.pl",
    "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.br", "org.nz", "org.uk", "org.za",
)
#: Prior strength where a level has nothing to estimate it from, and the bounds of the intra-class correlation.
DEFAULT_RHO, MIN_RHO, MAX_RHO = 0.1, 0.0001, 0.5


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix. A suffix is the last label, or one of ``suffixes`` (like ``co.uk``)."""
    labels = F.split(host, "\\.")
    last2, last3 = (F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.lit(n))) for n in (2, 3))
    last1 = F.element_at(labels, -1)
    if not suffixes:
        return last2, last1
    long = last2.isin(*suffixes)
    return F.when(long, last3).otherwise(last2), F.when(long, last2).otherwise(last1)


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def match_rules(pages: DataFrame, rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: of the (rule, verdict) pairs that fit, the longest; ties to the smaller rule, then to block.

    A rule ``host/path`` fits its host and all subdomains where the page's path starts with the rule's.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r[0]), r[0], r[1] != "block"))
    if len(ranked) <= MAX_INLINE_RULES:
        fits = lambda r: ((F.col(host) == r[0]) | F.col(host).endswith("." + r[0])) & F.col(path).startswith(r[1])
        pick = lambda k: F.coalesce(*[F.when(fits(_split(r[0])), F.lit(r[k])) for r in ranked], F.lit(None).cast("string"))
        return pages.withColumns({"rule": pick(0), "rule_verdict": pick(1)})
    spark = pages.sparkSession
    table = spark.createDataFrame([(k, *_split(r), r, v) for k, (r, v) in enumerate(ranked)], "_rank long, _rule_host string, _rule_path string, _rule string, _verdict string")
    urls = pages.select(host, path).distinct()
    labels = F.split(F.col(host), "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    hits = urls.withColumn("_rule_host", F.explode(F.array_distinct(ends))).join(table, "_rule_host").where(F.col(path).startswith(F.col("_rule_path")))
    best = hits.groupBy(host, path).agg(F.min(F.struct("_rank", "_rule", "_verdict")).alias("_best"))
    best = best.select(host, path, F.col("_best._rule").alias("rule"), F.col("_best._verdict").alias("rule_verdict"))
    return pages.join(best, [host, path], "left")


def _rho(groups: DataFrame, key: str, parent: str) -> Column:
    """Intra-class correlation of a level's groups about their parents' rates, by moments: one row, read as a scalar."""
    rate = F.col(f"{parent}_k") / F.col(f"{parent}_n")
    spread = rate * (1 - rate)
    seen = groups.where(F.col(f"{key}_n") > 0)
    excess = F.sum(F.col(f"{key}_n") * (F.col(f"{key}_k") / F.col(f"{key}_n") - rate) * (F.col(f"{key}_k") / F.col(f"{key}_n") - rate)) - F.sum(spread)
    pairs = F.sum((F.col(f"{key}_n") - 1) * spread)
    rho = F.when(pairs > 0, F.least(F.lit(MAX_RHO), F.greatest(F.lit(MIN_RHO), excess / pairs))).otherwise(F.lit(DEFAULT_RHO))
    return seen.agg(F.coalesce(rho, F.lit(DEFAULT_RHO)).alias("rho")).scalar()


#: Steps of the grid that posteriors are integrated on.
STEPS = 256


def beta_quantile(a: Column, b: Column, q: float) -> Column:
    """The q-quantile of a beta distribution, always between 0 and 1, by the trapezoid rule over the log-odds (the density there is smooth
    with exponential tails): right to about a thousandth of a deviation."""
    mean = a / (a + b)
    wide = F.sqrt(1 / a + 1 / b) * 8
    low, high = F.ln(a / b) - F.greatest(wide, 16 / a), F.ln(a / b) + F.greatest(wide, 16 / b)
    fixed = F.array(F.struct(a.alias("a"), b.alias("b"), F.ln(mean).alias("la"), F.ln(1 - mean).alias("lb"), low.alias("low"), ((high - low) / STEPS).alias("step")))

    def bound(g: Column) -> Column:
        at = lambda i: g["low"] + g["step"] * i
        height = lambda i: F.exp(g["a"] * (-F.log1p(F.exp(-at(i))) - g["la"]) + g["b"] * (-F.log1p(F.exp(at(i))) - g["lb"]))
        heights = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), height)
        parts = F.zip_with(F.slice(heights, 1, STEPS), F.slice(heights, 2, STEPS), lambda x, y: (x + y) / 2)
        return _crossing(parts, q, g["low"], g["step"])

    return F.element_at(F.transform(fixed, bound), 1)


def _crossing(parts: Column, q: float, low: Column, step: Column) -> Column:
    """Where the running sum of ``parts`` reaches q of its end, between grid points, from log-odds to a share."""
    zero = F.lit(0.0)
    state = lambda total, i, part: F.struct(total.alias("sum"), i.alias("i"), part.alias("part"))
    goal = F.aggregate(parts, zero, lambda total, x: total + x) * q

    def walk(s: Column, x: Column) -> Column:
        """Whole steps so far, and the part of the next one once that reaches the goal (before: -1)."""
        return F.when(s["part"] >= 0, s).when(s["sum"] + x < goal, state(s["sum"] + x, s["i"] + 1, F.lit(-1.0))).otherwise(state(s["sum"], s["i"], (goal - s["sum"]) / x))

    end = F.aggregate(parts, state(zero, F.lit(0), F.lit(-1.0)), walk, lambda s: s["i"] + s["part"])
    return 1 / (1 + F.exp(-(low + step * end)))


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES, level: float = 0.95) -> DataFrame:
    """One row for each host of ``pages (page_id, host)``: ``good_rate`` (posterior mean), ``bound`` (the posterior's ``level`` quantile) and
    ``corpus_rate``.

    ``outcomes (page_id, good)``: labelled pages, ``good`` 0 or 1; nulls and labels of unknown pages are ignored, repeated
    labels count each. Hosts without labels get their domain's
    prior, and so on upwards; with no labels at all the rate is one half.
    """
    votes = outcomes.where("good is not null and page_id is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    hosts = pages.select("page_id", "host").join(votes, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("host_n"), F.coalesce(F.sum("k"), F.lit(0)).alias("host_k"))
    domain, suffix = host_levels(F.col("host"), suffixes)
    hosts = stored(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "host_n", "host_k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("host_n").alias("domain_n"), F.sum("host_k").alias("domain_k"))
    ends = domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_k").alias("suffix_k"))
    total = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_k").alias("all_k"))
    all_n, all_k = total.select("all_n").scalar(), total.select("all_k").scalar()
    ends = ends.withColumns({"all_n": all_n, "all_k": all_k})
    domains = domains.join(ends, "suffix")
    full = hosts.join(domains.drop("suffix"), "domain")
    strength = lambda rho: 1 / rho - 1
    s0, s1, s2 = strength(_rho(ends, "suffix", "all")), strength(_rho(domains, "domain", "suffix")), strength(_rho(full, "host", "domain"))
    full = full.withColumn("m0", (F.col("all_k") + 0.5) / (F.col("all_n") + 1))
    full = full.withColumn("s0", s0).withColumn("m1", (F.col("suffix_k") + F.col("s0") * F.col("m0")) / (F.col("suffix_n") + F.col("s0")))
    full = full.withColumn("s1", s1).withColumn("m2", (F.col("domain_k") + F.col("s1") * F.col("m1")) / (F.col("domain_n") + F.col("s1")))
    full = full.withColumn("s2", s2).withColumn("w", F.col("host_n") + F.col("s2")).withColumn("m", (F.col("host_k") + F.col("s2") * F.col("m2")) / F.col("w"))
    posteriors = full.select((F.col("m") * F.col("w")).alias("a"), ((1 - F.col("m")) * F.col("w")).alias("b"), "host", "m", "m0")
    return posteriors.select("host", F.col("m").alias("good_rate"), beta_quantile(F.col("a"), F.col("b"), level).alias("bound"), F.col("m0").alias("corpus_rate"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), least_share: float = 0.75, level: float = 0.95, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Judges every row of ``pages (page_id, url)``: page_id, host, path, rule, verdict, good_rate, bound.

    A rule's verdict holds where one fits; else ``block`` if the host's upper posterior bound is below ``least_share`` of the corpus' share
    of good pages, else ``allow``. Null urls have an empty host and path and are judged like any other host. Repeated rows
    stay; other columns of either table are not read; empty tables give no rows.
    """
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    reputation = host_reputation(urls, outcomes.select("page_id", "good"), suffixes, level)
    judged = match_rules(urls, rules).join(reputation, "host", "left")
    method = F.when(F.col("bound") < F.col("corpus_rate") * least_share, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), F.round("good_rate", 6).alias("good_rate"), F.round("bound", 6).alias("bound"))
