"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host, registered domain and suffix. A suffix is the last label, or the longest
of the public suffixes given (such as ``co.uk``) that the host ends with; a registered domain is one label more.
Each level's rate is shrunk towards its parent's by a beta prior whose strength is fitted by the method of
moments to how much the children vary. A page without a rule is blocked when the lower bound of its host's
posterior bad rate passes a threshold; hosts without labels carry their parents' posterior.

Everything is DataFrame operations. A null url or one without ``://`` has an empty host and path; its verdict is
the global rate's. Hosts are counted before they are joined; their table is broadcast only up to
``BROADCAST_HOSTS`` rows, else pages are joined with salted hosts, so one host may hold any share of the pages.
Repeated rows are kept and count as often as they stand; labels of a doubled id count once (bad if any is); empty
tables give no rows or no outcomes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.functions.skew import join_hot
from signflow.session import discard, materialize

#: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rows of the host table (about 100 bytes each) up to which it is broadcast, and the salts beyond.
BROADCAST_HOSTS, SALTS = 100_000, 32
#: Standard deviations below the posterior mean, and the bad rate above which that bound blocks.
Z, LIMIT = 1.645, 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    first = lambda values: reduce(lambda out, x: F.when(x[0], F.lit(x[1])).otherwise(out), reversed(list(zip(fits, values, strict=True))), F.lit(None).cast("string"))
    return first([h + p for _, h, p in ordered]), first([v for v, _, _ in ordered])


def strength(children: DataFrame, mean: float) -> float:
    """The beta prior's weight in rows: from how far the children's counts vary beyond chance (method of moments)."""
    r = children.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.pow(F.col("bad") - F.col("n") * mean, F.lit(2.0))).alias("ss")).first()
    if not r["k"] or r["k"] < 2 or not 0 < mean < 1:
        return 10.0
    spread = r["ss"] / (mean * (1 - mean)) - (r["k"] - 1)
    room = r["n"] - r["nn"] / r["n"] - (r["k"] - 1)
    rho = min(max(spread / room if room > 0 else 0.0, 0.002), 0.9)
    return 1 / rho - 1


def registered(host: Column, public_suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """A host's suffix and registered domain (the host itself if it is a suffix)."""
    suffix = F.element_at(F.split(host, r"\."), -1)
    for s in sorted(public_suffixes, key=len):
        suffix = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(suffix)
    rest = F.split(F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1), r"\.")
    return suffix, F.when(F.length(host) > F.length(suffix), F.concat_ws(".", F.element_at(rest, -1), suffix)).otherwise(host)


def reputation(hosts: DataFrame, public_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``host, n, bad`` (one row for each host) with ``rate``, the posterior mean, and ``bound``, below which it is unlikely.

    One domain or suffix may own any share of the hosts: their tables are split by ``join_hot``.
    """
    n_hosts = hosts.count()
    suffix, domain = registered(F.col("host"), public_suffixes)
    named = hosts.withColumns({"suffix": suffix, "domain": domain})
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (total["bad"] + 0.5) / (total["n"] + 1)
    suffixes = named.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count_distinct("domain").alias("size"))
    domains = named.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("size"))
    s0, s1, s2 = strength(suffixes, mean), strength(domains, mean), strength(named, mean)
    of_suffix = suffixes.select("suffix", "size", ((F.col("bad") + s0 * mean) / (F.col("n") + s0)).alias("suffix_rate"))
    of_domain = join_hot(domains.withColumnRenamed("size", "hosts"), of_suffix, ["suffix"], "size", n_hosts).select("domain", F.col("hosts").alias("size"), ((F.col("bad") + s1 * F.col("suffix_rate")) / (F.col("n") + s1)).alias("domain_rate"))
    rated = join_hot(named, of_domain, ["domain"], "size", n_hosts).withColumn("rate", (F.col("bad") + s2 * F.col("domain_rate")) / (F.col("n") + s2))
    return rated.select("host", "n", "bad", "rate", (F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + s2 + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, limit: float = LIMIT, broadcast_hosts: int = BROADCAST_HOSTS, public_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, bound. ``outcomes``: page_id, bad (0 or 1) of the labelled pages."""
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("bigint"), host.alias("host"), path.alias("path"))
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = parts.select("page_id", "host").join(labelled, "page_id", "left")
    counted, path = materialize(known.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    hosts, _ = materialize(reputation(counted, public_suffixes).select("host", "rate", "bound"), "reputation")
    discard(pages.sparkSession, path)
    if hosts.count() <= broadcast_hosts:
        joined = parts.join(F.broadcast(hosts), "host", "left")
    else:
        salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > limit, F.lit("block")).otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "rate", "bound")
