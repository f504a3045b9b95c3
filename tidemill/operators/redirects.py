"""Redirect chains: a few hops, each one join on the url."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_REDIRECTS = 5
STATUSES = (301, 302, 303, 307, 308)


def follow(starts: DataFrame, edges: DataFrame, url: str = "url", most: int = MOST_REDIRECTS) -> DataFrame:
    """starts with final_url, hops and too_many, by edges (from_url, to_url), one for each from_url.

    A chain of over `most` redirects, a loop too, ends where it is after `most` of them, with too_many set.
    """
    now = starts.withColumn("final_url", F.col(url)).withColumn("hops", F.lit(0))
    step = edges.select(F.col("from_url").alias("_from"), F.col("to_url").alias("_to"))
    for _ in range(most):
        now = now.join(step, now["final_url"] == step["_from"], "left")
        now = now.withColumn("hops", F.col("hops") + F.col("_to").isNotNull().cast("int")).withColumn("final_url", F.coalesce("_to", "final_url")).drop("_from", "_to")
    last = step.select("_from", F.lit(True).alias("_more"))
    now = now.join(last, now["final_url"] == last["_from"], "left")
    return now.withColumn("too_many", (F.col("hops") == most) & F.coalesce("_more", F.lit(False))).drop("_from", "_more")
