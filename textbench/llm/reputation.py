"""Filtering urls by rules and empirical-Bayes reputation of their hosts.

Labelled outcomes of pages are counted per host, registered domain and suffix.
Each level is shrunk to the one above by a beta-binomial prior whose strength
is estimated from the spread between its members (method of moments): the
overall share is the prior of suffixes, a suffix that of its domains, a domain
that of its hosts. A page is allowed when the lower bound of its host's
posterior share of good pages reaches a threshold. Hosts without outcomes take
the prior of their domain, suffix or the whole.

Only hosts are aggregated and joined; a host with a third of all pages costs a
row per task before the shuffle, and adaptive execution may split its join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.scratch import cut

#: The bound is this many standard deviations below the posterior mean (5 % one-sided).
DEVIATIONS = 1.645
#: Least share of good pages the bound must reach.
LEAST_GOOD = 0.5

# Common public suffixes of two labels, below which domains are registered.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "edu.au", "go.jp", "gov.au", "gov.br",
    "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.br", "org.cn", "org.nz", "org.uk",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` in lower case (A-Z), and path up to ? or #; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("1"))
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.when(rest.isNotNull(), F.regexp_extract(after, r"^[^/?#]*", 0))
    path = F.when(rest.isNotNull(), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _per_suffix(host: Column, suffixes: Sequence[str], more: int) -> Column:
    """The labels of the longest listed suffix (else the last label) and `more` before them."""
    depths: dict[int, list[str]] = {}
    for suffix in suffixes:
        depths.setdefault(suffix.count(".") + 1, []).append(suffix)
    out = F.substring_index(host, ".", -1 - more)
    for depth in sorted(depths):
        listed = F.substring_index(host, ".", -depth).isin(depths[depth])
        out = F.when(listed, F.substring_index(host, ".", -depth - more)).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest of `suffixes` that ends the host at a label, else its last label."""
    return _per_suffix(host, suffixes, 0)


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Registered domain: the suffix of a host and the label before it; a bare suffix is its own."""
    return _per_suffix(host, suffixes, 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    A rule is (verdict, host and path). It fits its host and all subdomains when
    the path starts with the rule's path. Of rules of one length the first in
    the list holds. Rules are a short list that becomes part of the plan.
    """
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        # Later means longer; equal lengths must not replace an earlier one.
        longer = rule.isNull() | (F.length(rule) < len(text))
        rule, verdict = F.when(fits & longer, text).otherwise(rule), F.when(fits & longer, decision).otherwise(verdict)
    return rule, verdict


def _strength(members: DataFrame) -> float:
    """Prior strength from (_n, _k, _above) of the members of a level.

    A member's squared deviation from the share above, times its count, has the
    mean m(1-m)(1 + rho(n-1)); rho is solved from the sums and kept inside
    [0.0001, 0.9999].
    """
    room = F.col("_above") * (1 - F.col("_above"))
    share = F.col("_k") / F.col("_n")
    sums = members.where((F.col("_n") > 0) & (room > 0)).agg(
        F.sum(F.col("_n") * (share - F.col("_above")) * (share - F.col("_above")) / room).alias("s"),
        F.count(F.lit(1)).alias("members"),
        F.sum("_n").alias("rows"),
    ).first()
    spare = (sums.rows or 0.0) - sums.members
    rho = (sums.s - sums.members) / spare if sums.s is not None and spare else 0.0001
    return 1 / max(min(rho, 0.9999), 0.0001) - 1


def _shrink(members: DataFrame) -> DataFrame:
    """Add the posterior (_a, _b) of each member and its mean, under the share above."""
    strength = _strength(members)
    return members.withColumns(
        {
            "_a": F.col("_k") + strength * F.col("_above"),
            "_b": F.col("_n") - F.col("_k") + strength * (1 - F.col("_above")),
        }
    ).withColumn("_post", F.col("_a") / (F.col("_a") + F.col("_b")))


def host_bounds(
    outcomes: DataFrame, hosts: DataFrame, deviations: float = DEVIATIONS, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """(host, bound) for each of `hosts`, from outcomes (host, good 0/1).

    Null outcomes are ignored. Without any outcome every bound is that of a
    uniform prior. `suffixes` is a list that becomes part of the plan, such as that of
    all public suffixes. The counts per host are written once; the overall share and
    the three strengths are all that reaches the driver.
    """
    seen = (
        outcomes.where(F.col("good").isin(0, 1))
        .groupBy("host")
        .agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("good").cast("double").alias("_k"))
    )
    tree = cut(
        hosts.select("host").distinct().join(seen, "host", "full_outer")
        .fillna(0.0, ["_n", "_k"])
        .withColumns({"_domain": domain_of(F.col("host"), suffixes), "_suffix": suffix_of(F.col("host"), suffixes)})
    )
    sums = tree.agg(F.sum("_n").alias("n"), F.sum("_k").alias("k")).first()
    mean = ((sums.k or 0.0) + 1) / ((sums.n or 0.0) + 2)

    def level(*names):
        return tree.groupBy(*names).agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))

    suffixes = _shrink(level("_suffix").withColumn("_above", F.lit(mean)))
    above = suffixes.select("_suffix", F.col("_post").alias("_above"))
    domains = _shrink(cut(level("_suffix", "_domain").join(above, "_suffix")))
    above = domains.select("_domain", F.col("_post").alias("_above"))
    below = _shrink(cut(tree.join(above, "_domain")))
    total = F.col("_a") + F.col("_b")
    spread = F.sqrt(F.col("_a") * F.col("_b") / (total * total * (total + 1)))
    return below.select("host", (F.col("_post") - deviations * spread).alias("bound"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]],
    least_good: float = LEAST_GOOD, deviations: float = DEVIATIONS,
    id_col: str = "page_id", url_col: str = "url", suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """(id, host, path, rule, verdict, bound) per row of `pages`.

    `outcomes` has (url, good). The verdict is that of the longest fitting rule,
    else `allow` where the host's bound reaches `least_good` and `block` below.
    Urls that are null or have no `://` share the empty host. Repeated rows give
    repeated rows; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    known = outcomes.select(host_and_path(F.col("url"))[0].alias("host"), "good")
    bounds = host_bounds(known, rows.select("host").distinct(), deviations, suffixes)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= least_good, "allow").otherwise("block")
    return rows.join(bounds, "host").select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound"
    )
