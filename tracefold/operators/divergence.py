"""Columns of aligned runs: divergence points, activity, consensus. ``cells`` holds group_id, row_idx, run_id,
col, value (null for a gap) and success."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.stats import adjusted, chi2_table, entropy, fisher_exact

GAP = "-"


def position_cells(runs: DataFrame, group: str = "task_id") -> DataFrame:
    """Cells of runs laid side by side by position, unaligned."""
    return runs.select(F.col(group).alias("group_id"), "run_id", "success", F.posexplode("names").alias("col", "value"))


def divergence_points(cells: DataFrame, min_branch: int = 2, q: float = 0.5) -> DataFrame:
    """Columns with two or more values: entropy, p of value against outcome (two values by Fisher's test, more by
    the chi-squared one; null under four known outcomes or where one side is empty), adjusted within the group."""
    by_value = cells.where("value IS NOT NULL").groupBy("group_id", "col", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("success")).alias("n_pass"), F.count_if(~F.col("success")).alias("n_fail"))
    cols = by_value.groupBy("group_id", "col").agg(F.sort_array(F.collect_list(F.struct("value", "n", "n_pass", "n_fail"))).alias("v")).where((F.size("v") >= 2) & (F.array_min(F.transform("v", lambda x: x["n"])) >= min_branch))
    total = lambda c: F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x[c])
    a, b = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    rows = cols.select("group_id", "col", F.size("v").alias("n_values"), F.array_min(F.transform("v", lambda x: x["n"])).alias("min_branch"), entropy(F.transform("v", lambda x: x["n"].cast("double"))).alias("entropy"), F.col("v"), total("n_pass").alias("np"), total("n_fail").alias("nf"))
    tested = (F.col("np") + F.col("nf") >= 4) & (F.col("np") > 0) & (F.col("nf") > 0)
    p = F.when(tested & (F.col("n_values") == 2), fisher_exact(a["n_pass"], a["n_fail"], b["n_pass"], b["n_fail"])).when(tested, chi2_table(F.col("v")))
    return adjusted(rows.withColumn("p_value", p), by=("group_id",)).where(F.col("q_value").isNull() | (F.col("q_value") <= q)).select("group_id", "col", "n_values", "min_branch", "entropy", "p_value", "q_value")


def consensus(cells: DataFrame) -> DataFrame:
    """The commonest value of each column; ties by value."""
    counts = cells.where("value IS NOT NULL").groupBy("group_id", "col", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("group_id", "col").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))


def activity(cells: DataFrame, runs: DataFrame, group: str = "task_id") -> DataFrame:
    """Per column, whether runs with a step there pass more often than runs without: Fisher's test. The direction
    is the share of passing runs that have a step there less that of failing ones (0 where a side has no runs)."""
    totals = runs.groupBy(F.col(group).alias("group_id")).agg(F.count_if(F.col("success")).alias("np"), F.count_if(~F.col("success")).alias("nf"))
    active = cells.where("value IS NOT NULL").groupBy("group_id", "col").agg(F.count_if(F.col("success")).alias("ap"), F.count_if(~F.col("success")).alias("af"))
    rows = active.join(totals, "group_id").withColumn("gp", F.col("np") - F.col("ap")).withColumn("gf", F.col("nf") - F.col("af"))
    rows = rows.where((F.col("ap") + F.col("af") > 0) & (F.col("gp") + F.col("gf") > 0))
    return adjusted(rows.withColumn("p_value", fisher_exact(F.col("ap"), F.col("af"), F.col("gp"), F.col("gf"))), by=("group_id",)).select(
        "group_id", "col", "ap", "af", "gp", "gf", F.try_subtract(F.coalesce(F.try_divide(F.col("ap"), F.col("np")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("af"), F.col("nf")), F.lit(0.0))).alias("direction"), "p_value", "q_value")


def population_pairs(cells: DataFrame, q: float = 0.10, min_branch: int = 2, least_gap: float = 0.15, context: int = 5) -> DataFrame:
    """Of each significant column the branches with the highest and the lowest pass rate (ties by value), the first
    passing run of the one and failing run of the other, and the labels of up to ``context`` columns before, in the
    passing run. Counts and representatives come from one aggregation over the cells of those columns."""
    points = divergence_points(cells, min_branch, q).where("q_value IS NOT NULL").select("group_id", "col", "p_value", "q_value")
    at = cells.where("value IS NOT NULL").join(points, ["group_id", "col"])
    branches = at.groupBy("group_id", "col", "value").agg(
        F.avg(F.col("success").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"), F.first("p_value").alias("p_value"), F.first("q_value").alias("q_value"),
        F.min(F.when(F.col("success"), F.col("run_id"))).alias("pass_run"), F.min(F.when(~F.col("success"), F.col("run_id"))).alias("fail_run"),
    ).where("rate IS NOT NULL")
    row = F.struct("value", "rate", "n", "pass_run", "fail_run")
    ends = branches.groupBy("group_id", "col").agg(F.first("p_value").alias("p_value"), F.first("q_value").alias("q_value"), F.min_by(row, F.struct(-F.col("rate"), "value")).alias("best"), F.min_by(row, F.struct("rate", "value")).alias("worst"))
    pairs = ends.where((F.col("best.rate") - F.col("worst.rate") >= least_gap) & F.col("best.pass_run").isNotNull() & F.col("worst.fail_run").isNotNull()).select(
        "group_id", "col", F.col("best.pass_run").alias("pass_run"), F.col("worst.fail_run").alias("fail_run"), F.col("best.value").alias("preferred"), F.col("worst.value").alias("dispreferred"),
        F.col("best.rate").alias("preferred_rate"), F.col("worst.rate").alias("dispreferred_rate"), F.col("best.n").alias("n_preferred"), F.col("worst.n").alias("n_dispreferred"), "p_value", "q_value")
    before = cells.where("value IS NOT NULL").select("group_id", F.col("run_id").alias("pass_run"), F.struct(F.col("col").alias("c"), F.col("value").alias("x")).alias("e"))
    seen = pairs.join(before, ["group_id", "pass_run"]).where((F.col("e.c") < F.col("col")) & (F.col("e.c") >= F.col("col") - context))
    said = seen.groupBy("group_id", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["x"]), " → ").alias("context"))  # at most ``context`` labels
    return pairs.join(said, ["group_id", "col"], "left").withColumn("context", F.coalesce("context", F.lit("")))
