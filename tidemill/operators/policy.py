"""Which hosts may be fetched: every answer of a name must be public, or a private one must be allowed by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors, ip

MOST_ANSWERS = 16


@dataclass(frozen=True)
class Policy:
    allow_loopback: bool = False
    private_enabled: bool = False
    private_hosts: Sequence[str] = field(default_factory=tuple)


def passes(blocked: Column, host: Column, policy: Policy, redirect: bool = False) -> Column:
    """True for a public address; for loopback where the policy allows it; for a private one of an allowed host, but
    not behind a redirect."""
    relaxed = F.lit(False)
    if policy.private_enabled and policy.private_hosts and not redirect:
        relaxed = (blocked["kind"] == "private") & host.isin(*policy.private_hosts)
    return blocked.isNull() | ((blocked["kind"] == "loopback") & F.lit(policy.allow_loopback)) | relaxed


def resolve(dns: DataFrame, policy: Policy, redirect: bool = False) -> DataFrame:
    """(host, addresses, error_code, error_message): one row for each host of dns (host, ord, ip as text).

    The first 16 answers count. If one of them is refused the host is, with the first refused one's category; else the
    host has its distinct addresses in order. A host whose only rows have a null ip did not resolve. One aggregation,
    no join; each host's answers are few.
    """
    rows = dns.where(F.col("ord") < MOST_ANSWERS).withColumn("_b", ip.classify_text(F.col("ip")))
    rows = rows.withColumn("_ok", passes(F.col("_b"), F.col("host"), policy, redirect))
    answer = F.when(F.col("ip").isNotNull(), F.struct("ord", "ip"))
    hosts = rows.groupBy("host").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(answer)), lambda a: a["ip"])).alias("_ips"),
        F.min_by(F.col("_b.category"), F.when(~F.col("_ok"), F.col("ord"))).alias("_category"),
    )
    refused = F.concat(F.lit("hostname resolves to a non-public address ("), F.col("_category"), F.lit(")"))
    missing = F.size("_ips") == 0
    return hosts.select(
        "host",
        F.when(~missing & F.col("_category").isNull(), F.col("_ips")).alias("addresses"),
        F.when(missing, "dns_failure").when(F.col("_category").isNotNull(), "blocked_target").alias("error_code"),
        F.when(missing, errors.NO_DNS).otherwise(refused).alias("error_message"),
    )
