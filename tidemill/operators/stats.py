"""Statistics and verdicts over benchmark samples and corpora, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_VALID = 10
LEAST_FOR_P95 = 20
BOUND_RATIO = 1.10
MIB_KB = 1024.0


def timing_stats(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, median (to three places), min, max, and from 20 samples on the nearest-rank p95, for each key. Null values
    don't count."""
    v = F.col(value)
    return samples.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.median(v), 3).alias("median"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.when(F.count("*") >= LEAST_FOR_P95, F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)")).alias("p95"),
    )


def scenario_verdicts(samples: DataFrame, keys: Sequence[str], value: str, valid: str, target: Column, recorded_only: Column | None = None, smoke: bool = False) -> DataFrame:
    """runs, valid_runs, median over the valid ones, reasons, verdict: INVALID under 10 valid runs (or none), RECORDED
    where the scenario is for the record, else PASS up to the target and FAIL beyond it."""
    ok = F.col(valid)
    reasons = F.array_sort(F.collect_set(F.when(~ok, F.col("reason")))) if "reason" in samples.columns else F.array().cast("array<string>")
    extra = [] if recorded_only is None else [F.bool_or(recorded_only).alias("_recorded")]
    out = samples.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if(ok).alias("valid_runs"),
        F.median(F.when(ok, F.col(value))).alias("median"),
        reasons.alias("reasons"),
        F.max(target).alias("target"),
        *extra,
    )
    few = (F.col("valid_runs") == 0) | ((F.col("valid_runs") < LEAST_VALID) & F.lit(not smoke))
    verdict = F.when(few, "INVALID")
    if extra:
        verdict = verdict.when(F.col("_recorded"), "RECORDED")
    out = out.withColumn("verdict", verdict.when(F.col("median") <= F.col("target"), "PASS").otherwise("FAIL"))
    return out.drop("_recorded") if extra else out


def gating_peak(scenarios: DataFrame, peaks: Column) -> DataFrame:
    """The largest of the scenarios' medians, over those that gate: one row."""
    return scenarios.where(peaks & (F.col("verdict") != "INVALID")).agg(F.max("median").alias("gating_peak"), F.count("*").alias("scenarios"))


def boundedness(scenarios: DataFrame, key: str, reference: str) -> DataFrame:
    """Each scenario that names a reference: ratio of the medians, and within, over or unchecked where the reference has
    no valid result."""
    other = scenarios.where("verdict != 'INVALID'").select(F.col(key).alias("_key"), F.col("median").alias("_median"))
    rows = scenarios.where(F.col(reference).isNotNull() & (F.col("verdict") != "INVALID")).join(other, F.col(reference) == F.col("_key"), "left")
    ratio = F.col("median") / F.col("_median")
    state = F.when(F.col("_median").isNull(), "incomplete").when(ratio > BOUND_RATIO, "over").otherwise("within")
    return rows.select(key, reference, F.round(ratio, 3).alias("ratio"), state.alias("state"))


def run_verdict(invalid: Column, missed: Column, incomplete: Column, gate: bool = True) -> Column:
    """INVALID before FAIL before INCOMPLETE before a pass, from aggregated flags."""
    return F.when(invalid, "INVALID").when(missed, "FAIL").when(incomplete, "INCOMPLETE").otherwise("PASS" if gate else "ADVISORY_PASS")


def release_decision(state: Column) -> Column:
    """Over the rows of checks with a state met, missed or missing."""
    return F.when(F.bool_or(state == "missed"), "do not release").when(F.bool_or(state == "missing"), "not decided").otherwise("release")


def regression(current: DataFrame, baseline: DataFrame, key: str, metrics: Sequence[str], percent: float = 10.0, least: float = 1536.0) -> DataFrame:
    """Each metric of current against the baseline of its key: limit, and ok, regression, or no baseline. Both bars count:
    percent over the baseline, and `least` over it. A zero or missing baseline metric isn't compared."""
    base = baseline.select(F.col(key), *(F.col(m).alias(f"_{m}") for m in metrics))
    rows = current.join(base, key, "left")
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("current"), F.col(f"_{m}").cast("double").alias("baseline")) for m in metrics))
    rows = rows.select(key, F.inline(parts))
    limit = F.greatest(F.col("baseline") * (1 + percent / 100), F.col("baseline") + least)
    has = F.coalesce(F.col("baseline") != 0, F.lit(False))
    return rows.select(key, "metric", "current", "baseline", F.when(has, limit).alias("limit"), F.when(~has, "no baseline").when(F.col("current") > limit, "regression").otherwise("ok").alias("verdict"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def corpus_verdict(rows: DataFrame, success: float = 0.95, reduction: float = 0.50) -> DataFrame:
    """One row over a corpus (name, ok, reduction, script_leaked): rates, the median reduction, leaks and the verdict."""
    out = rows.agg(
        F.count("*").alias("pages"),
        F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)).alias("success_rate"),
        F.median("reduction").alias("median_reduction"),
        F.count_if("script_leaked").alias("leaks"),
    )
    good = (F.col("success_rate") >= success) & F.coalesce(F.col("median_reduction") >= reduction, F.lit(False)) & (F.col("leaks") == 0)
    return out.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def by_category(rows: DataFrame, category: str, ok: Column, categories: Sequence[str]) -> DataFrame:
    """ok and total for each of the categories, those without rows too."""
    all_ = rows.sparkSession.createDataFrame([(c,) for c in categories], f"`{category}` string")
    counts = rows.groupBy(category).agg(F.count_if(ok).alias("ok"), F.count("*").alias("total"))
    return F.broadcast(all_).join(counts, category, "left").select(category, F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("total", F.lit(0)).alias("total"))


def close_medians(samples: DataFrame, build: str, value: str, shipped: str, bench: str, within: float = 0.10, cap: float = 40 * MIB_KB) -> DataFrame:
    """Two builds' medians: their difference and ratio, and whether both are under the cap and near each other."""
    m = samples.agg(*(F.median(F.when(F.col(build) == b, F.col(value))).alias(n) for b, n in ((shipped, "shipped"), (bench, "bench"))))
    near = (F.abs(F.col("shipped") / F.col("bench") - 1) <= within) & (F.greatest("shipped", "bench") <= cap)
    return m.select("shipped", "bench", (F.col("bench") - F.col("shipped")).alias("delta"), (F.col("shipped") / F.col("bench")).alias("ratio"), F.coalesce(near, F.lit(False)).alias("close"))


def missing_requirements(required: Sequence[str], present: Column) -> Column:
    """What of required isn't in the array present."""
    return F.array_except(F.lit(list(required)), present)
