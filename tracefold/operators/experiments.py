"""Statistics of experiments: histograms, correlations within tasks, rank tests, intervals of a difference of rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.stats import erfc
from tracefold.operators.cohorts import POISSON


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin, n) over equal bins of [low, high]; values outside count in the first or last one, nulls don't."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) * bins / (high - low)))).cast("long")
    return rows.where(F.col(value).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def centred_correlation(rows: DataFrame, value: str, group: str = "task_id") -> DataFrame:
    """One row: correlation of a value with outcome after each task's means are taken off, rows, and its normal p. From sums by
    task, so that only one row a task is shuffled."""
    x, y = F.col(value).cast("double"), F.col("success").cast("double")
    known = rows.where(F.col("success").isNotNull() & F.col(value).isNotNull())
    sums = known.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    left = lambda s, a, b: F.sum(F.col(s) - F.col(a) * F.col(b) / F.col("n"))
    total = sums.agg(F.sum("n").alias("n"), left("xx", "x", "x").alias("vx"), left("yy", "y", "y").alias("vy"), left("xy", "x", "y").alias("c"))
    r = F.when((F.col("vx") > 1e-12) & (F.col("vy") > 1e-12), F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return total.select("n", r.alias("r")).withColumn("p_value", F.when(F.col("n") > 2, erfc(F.abs("r") * F.sqrt(F.col("n").cast("double")) / F.sqrt(F.lit(2.0)))))


def rank_test(rows: DataFrame, value: str) -> DataFrame:
    """One row: Mann-Whitney U of passing against failing runs, rank-biserial correlation and the normal p with correction for
    ties. Equal values are one row before they are ordered."""
    known = rows.where(F.col("success").isNotNull() & F.col(value).isNotNull())
    by_value = known.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col("success")).alias("a"), F.count_if(~F.col("success")).alias("b"))
    below = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # over distinct values
    met = by_value.withColumn("less", F.coalesce(F.sum("b").over(below), F.lit(0))).withColumn("t", (F.col("a") + F.col("b")).cast("double"))
    total = met.agg(F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n2"), F.sum(F.col("a") * F.col("less") + F.col("a") * F.col("b") / 2.0).alias("u"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n, pairs = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    spread = F.sqrt(pairs / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - pairs / 2) - 0.5) / spread
    return total.where("n1 > 0 AND n2 > 0").select("n1", "n2", "u", (2 * F.col("u") / pairs - 1).alias("rank_biserial"), F.when(spread > 0, F.least(F.lit(1.0), erfc(z / F.sqrt(F.lit(2.0))))).otherwise(1.0).alias("p_value"))


def rate_delta_interval(runs: DataFrame, side: Column, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row: the difference of success rates between runs with ``side`` true and false, and its 2.5 and 97.5 per cent points
    over resamples. Runs of equal side and outcome are alike, so a resample is four sums of Poisson weights, one pass over runs."""
    known = runs.where("success IS NOT NULL").select("run_id", side.alias("side"), F.col("success").cast("double").alias("y")).where("side IS NOT NULL")
    draw = (F.pmod(F.xxhash64("run_id", "round", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    w = sum((draw > c).cast("int") for c in POISSON)
    rate = lambda s, w: F.try_divide(F.sum(F.when(F.col("side") == s, w * F.col("y"))), F.sum(F.when(F.col("side") == s, w)))
    drawn = known.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", w)
    deltas = drawn.groupBy("round").agg((rate(True, F.col("w")) - rate(False, F.col("w"))).alias("d")).where("d IS NOT NULL")
    points = deltas.agg(F.sort_array(F.collect_list("d")).alias("s"))  # a value a round
    seen = known.agg((rate(True, F.lit(1)) - rate(False, F.lit(1))).alias("delta"))
    at = lambda share: F.get("s", F.floor(F.size("s") * share).cast("int"))
    return seen.crossJoin(F.broadcast(points)).select("delta", at(0.025).alias("ci_lower"), at(0.975).alias("ci_upper"))  # one row each
