"""robots.txt: files to records, and what the record for an agent says about a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORDS = "array<struct<agents: array<string>, rules: array<struct<prefix: string, allow: boolean>>>>"


def records(robots: DataFrame, key: str = "origin", body: str = "body") -> DataFrame:
    """(key, records) for each row of robots: agents in lower case, rules in order.

    A # starts a comment anywhere. Agent lines in a row share a record; one after a rule opens the next. An empty
    Disallow allows everything, an empty Allow says nothing but is a rule line. Rules before any agent belong to none.
    """
    lines = robots.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n")).alias("no", "line"))
    line = F.trim(F.substring_index(F.regexp_replace("line", r"\r$", ""), "#", 1))
    lines = lines.select(key, "no", line.alias("line")).where(F.col("line").contains(":"))
    field = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.regexp_extract("line", r"(?s)^[^:]*:[\s]*(.*?)[\s]*$", 1)
    lines = lines.select(key, "no", field.alias("field"), value.alias("value"))
    lines = lines.where(F.col("field").isin("allow", "disallow") | ((F.col("field") == "user-agent") & (F.col("value") != "")))
    by = Window.partitionBy(key).orderBy("no")
    agent = F.col("field") == "user-agent"
    lines = lines.withColumn("_opens", (agent & F.coalesce(F.lag("field").over(by) != "user-agent", F.lit(True))).cast("int"))
    lines = lines.withColumn("record", F.sum("_opens").over(by))
    ordered = lambda what, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("no", what.alias("x"))))), lambda e: e["x"])
    rule = F.struct(F.col("value").alias("prefix"), ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"))
    some_rule = ~agent & ~((F.col("field") == "allow") & (F.col("value") == ""))
    rec = lines.where("record > 0").groupBy(key, "record").agg(ordered(F.lower("value"), agent).alias("agents"), ordered(rule, some_rule).alias("rules"))
    grouped = rec.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("record", "agents", "rules"))), lambda r: F.struct(r["agents"].alias("agents"), r["rules"].alias("rules"))).alias("records"))
    return robots.select(key).distinct().join(grouped, key, "left").select(key, F.coalesce("records", F.from_json(F.lit("[]"), RECORDS)).alias("records"))


def allowed(recs: Column, agent: Column, path: Column) -> Column:
    """Whether a path may be fetched: the record with the longest token that the agent's name starts with, else that of
    *; in it the longest prefix of the path, Allow before Disallow. No record or rule: yes. Null records: yes."""
    agent, path = F.lower(agent), F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)
    longest = lambda r: F.array_max(F.transform(F.filter(r["agents"], lambda a: (a != "*") & F.startswith(agent, a)), lambda a: F.length(a)))
    named = F.filter(F.transform(recs, lambda r, i: F.struct(longest(r).alias("n"), (-i).alias("first"), r["rules"].alias("rules"))), lambda r: r["n"].isNotNull())
    star = F.filter(recs, lambda r: F.array_contains(r["agents"], "*"))
    rules = F.coalesce(F.array_max(F.transform(named, lambda r: F.struct(r["n"], r["first"], r["rules"].alias("rules"))))["rules"], F.get(star, F.lit(0))["rules"])
    hits = F.transform(F.filter(rules, lambda r: F.startswith(path, r["prefix"])), lambda r: F.struct(F.octet_length(r["prefix"]).alias("n"), r["allow"].alias("allow")))
    return F.coalesce(F.array_max(hits)["allow"], F.lit(True))
