"""Comparison of runs: intervals, differences, changes per question, McNemar, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEAD_BAND, CHI_CUT = 0.03, 3.84


def interval(p: Column, n: Column) -> Column:
    """Half width of the 95 % interval of a share."""
    return F.lit(1.96) * F.sqrt(p * (1 - p) / n)


def with_interval(runs: DataFrame, limit: float = 0.8) -> DataFrame:
    """``runs`` (run_id, n, p) with half width and verdict."""
    return runs.select("run_id", "n", F.round("p", 6).alias("p"), F.round(interval(F.col("p"), F.col("n")), 6).alias("half_width"), F.when(F.col("p") >= limit, "pass").otherwise("fail").alias("verdict"))


def two_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(diff, error, verdict): b against a; significant when the difference exceeds the pooled error."""
    left = runs.where(F.col("run_id") == a).select(F.lit(1).alias("j"), F.col("n").alias("na"), F.col("p").alias("pa"))
    right = runs.where(F.col("run_id") == b).select(F.lit(1).alias("j"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    error = F.lit(1.96) * F.sqrt(F.col("pa") * (1 - F.col("pa")) / F.col("na") + F.col("pb") * (1 - F.col("pb")) / F.col("nb"))
    diff = F.col("pb") - F.col("pa")
    return left.join(right, "j").select(F.round(diff, 6).alias("diff"), F.round(error, 6).alias("error"), F.when(F.abs(diff) > error, "significant").otherwise("hold").alias("verdict"))


def changes(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(qid, before, after, change) of questions that both runs have."""
    met = a.select("qid", F.col(metric).alias("before")).join(b.select("qid", F.col(metric).alias("after")), "qid")
    return met.withColumn("change", F.when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "regressed").otherwise("same"))


def mcnemar(a: DataFrame, b: DataFrame, flag: str) -> DataFrame:
    """(gained, lost, chi2, verdict) with continuity correction; chi2 is 0 without changes."""
    met = a.select("qid", (F.col(flag) > 0).alias("x")).join(b.select("qid", (F.col(flag) > 0).alias("y")), "qid")
    counts = met.agg(F.count_if(~F.col("x") & F.col("y")).alias("gained"), F.count_if(F.col("x") & ~F.col("y")).alias("lost"))
    total = F.col("gained") + F.col("lost")
    chi = F.when(total > 0, F.pow(F.greatest(F.abs(F.col("gained") - F.col("lost")) - 1, F.lit(0)), 2) / total).otherwise(0.0)
    return counts.select("gained", "lost", F.round(chi, 6).alias("chi2"), F.when(chi > CHI_CUT, "significant").otherwise("hold").alias("verdict"))


def delta_vs_base(summary: DataFrame, base: str, key: str = "run_id", columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Difference of every run to the base run; without the base run, no rows."""
    names = [F.col(c).alias(f"__{c}") for c in columns]
    ref = summary.where(F.col(key) == base).select(F.lit(1).alias("__j"), *names)
    return summary.withColumn("__j", F.lit(1)).join(ref, "__j").select(key, F.when(F.col(key) == base, "base").otherwise("").alias("base"), *(F.round(F.col(c) - F.col(f"__{c}"), 3).alias(f"d_{c}") for c in columns))


def delta_vs_previous(summary: DataFrame, order: str, value: str, group: str | None = None, band: float = DEAD_BAND) -> DataFrame:
    """Difference to the run before with up, down or flat within the dead band; the first run has '-'."""
    before = F.lag(value).over(Window.partitionBy(group or F.lit(1)).orderBy(order))
    d = F.round(F.col(value) - before, 6)
    word = F.when(before.isNull(), "-").when(d > band, "up").when(d < -band, "down").otherwise("flat")
    return summary.select(*([group] if group else []), order, value, d.alias("delta"), word.alias("trend"))


def first_last(runs: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """The metric of each run across, with last minus first and whether it regressed; a row's first and last are those it has."""
    wide = runs.groupBy(row).pivot(column, values).agg(F.first(metric)) if values else runs.select(row).distinct()
    across = [F.col(f"`{v}`") for v in values] or [F.lit(None).cast("double")]
    d = F.round(F.coalesce(*reversed(across)) - F.coalesce(*across), 6)
    return wide.withColumn("delta", d).withColumn("regressed", F.coalesce(d < 0, F.lit(False)))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def rates(df: DataFrame, group: str, good: Column, judged: Column) -> DataFrame:
    """(group, n, n_good, rate): share of good ones among those judged; null where none is."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(good & judged).alias("n_good"), F.round(F.try_divide(F.count_if(good & judged), F.count_if(judged)), 6).alias("rate"))


def rubric(scores: DataFrame, limit: float = 0.75) -> DataFrame:
    """(mean_score, no_answer_accuracy, verdict) over (score, is_no_answer)."""
    mean = F.avg("score")
    return scores.agg(F.round(mean, 6).alias("mean_score"), F.round(F.avg(F.when(F.col("is_no_answer"), F.col("score"))), 6).alias("no_answer_accuracy"), F.when(mean >= limit, "pass").otherwise("fail").alias("verdict"))


RUN_METRICS = ("recall_1", "recall_5", "recall_10", "mrr", "ndcg_10")
RUN_SETTINGS = ("eval_version", "setting", "chunking", "header", "tokenizer", "reranker", "candidates", "note")


def run_record(detail: DataFrame, run_id: str, run_on: str, **settings: str) -> DataFrame:
    """One row of the table of runs: id, day, number of questions, settings, and the mean of each metric that ``detail`` has, null for others."""
    unknown = set(settings) - set(RUN_SETTINGS)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    means = [(F.round(F.avg(m), 6) if m in detail.columns else F.lit(None).cast("double")).alias(m) for m in RUN_METRICS]
    row = detail.agg(F.count(F.lit(1)).alias("n_questions"), *means)
    return row.select(F.lit(run_id).alias("run_id"), F.lit(run_on).cast("date").alias("run_on"), *(F.lit(settings.get(c, "")).alias(c) for c in RUN_SETTINGS), "n_questions", *RUN_METRICS)


def record_run(record: DataFrame, path: str) -> None:
    """Appends a record to the table of runs at ``path``, one folder a run; a run recorded again replaces its former record."""
    run_id = record.first().run_id
    record.drop("run_id").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")
