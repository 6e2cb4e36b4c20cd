"""Patterns of labels: contiguous, gapped, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.stats import adjusted, fisher_exact


def _exact_mean(position: Column) -> Column:
    """Mean, to nine places, that doesn't depend on the order of summation: positions add up as decimals."""
    return F.round(F.sum(F.round(position, 12).cast("decimal(28,12)")).cast("double") / F.count(F.lit(1)), 9)


def grams(runs: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """Every row of ``runs`` with each distinct pattern of ``least`` to ``most`` labels and the position, in 0..1, where it
    comes first. Patterns of a run are listed within its row, so nothing is shuffled."""
    n = F.size("names")

    def of_length(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.expr("CAST(array() AS array<int>)"))
        return F.transform(starts, lambda i: F.array_join(F.slice("names", i + 1, k), " → "))

    rows = runs.withColumn("__all", F.array(*map(of_length, range(least, most + 1))))
    firsts = F.flatten(F.transform("__all", lambda ps: F.transform(F.array_distinct(ps), lambda p: F.struct(p.alias("pattern"), (F.array_position(ps, p) - 1).alias("i")))))
    rows = rows.withColumn("__g", F.explode(firsts))
    return rows.select(*(c for c in runs.columns if c != "steps"), F.col("__g.pattern").alias("pattern"), (F.col("__g.i") / F.greatest(n - 1, F.lit(1))).alias("position"))


def _tested(found: DataFrame, totals: DataFrame, by: tuple[str, ...], min_count: int, q: float) -> DataFrame:
    """Fisher's test of each pattern's presence against outcome, adjusted over candidates."""
    rows = found.join(F.broadcast(totals), list(by)) if by else found.crossJoin(F.broadcast(totals))  # one row a stratum
    rows = rows.where((F.col("n_with") >= min_count) & (F.col("all_pass") > 0) & (F.col("all_pass") < F.col("all_known")))
    p = fisher_exact(F.col("n_pass"), F.col("n_with") - F.col("n_pass"), F.col("all_pass") - F.col("n_pass"), F.col("all_known") - F.col("all_pass") - F.col("n_with") + F.col("n_pass"))
    scored = rows.select(*by, "pattern", "n_with", "n_pass", "avg_position", (F.col("n_pass") / F.col("n_with")).alias("success_rate"), ((F.col("n_pass") / F.col("n_with")) / (F.col("all_pass") / F.col("all_known"))).alias("lift"), p.alias("p_value"))
    return adjusted(scored, by=by).where(F.col("q_value") <= q)


def _totals(runs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return runs.groupBy(*by).agg(F.count("success").alias("all_known"), F.count_if(F.col("success")).alias("all_pass"))


def find_motifs(runs: DataFrame, least: int = 3, most: int = 5, min_count: int = 3, q: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Patterns whose presence goes with outcome. Presence counts once a run; avg_position is of first
    occurrences, over all runs. ``by`` stratifies the counts and the adjustment. One shuffle, by pattern."""
    found = grams(runs, least, most).groupBy(*by, "pattern").agg(F.count("success").alias("n_with"), F.count_if(F.col("success")).alias("n_pass"), _exact_mean(F.col("position")).alias("avg_position"))
    return _tested(found, _totals(runs, by), by, min_count, q)


def best_strata(found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of each pattern the row of its least adjusted p, where a p of exactly 0 counts as 1; ties by stratum."""
    q = F.when(F.col("q_value") == 0, 1.0).otherwise(F.coalesce("q_value", F.lit(1.0)))
    others = [c for c in found.columns if c != "pattern"]
    return found.groupBy("pattern").agg(F.min_by(F.struct(*others), F.struct(F.round(q, 9), *by)).alias("b")).select("pattern", "b.*")


def frequent_labels(runs: DataFrame, min_count: int = 3, share: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Labels that at least ``min_count`` runs and ``share`` of all runs hold, by stratum: at most 1 / share each."""
    n = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"))
    held = runs.select(*by, F.explode(F.array_distinct("names")).alias("label")).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    both = held.join(F.broadcast(n), list(by)) if by else held.crossJoin(F.broadcast(n))  # one row a stratum
    return both.where(F.col("n") >= F.greatest(F.lit(min_count), F.ceil(share * F.col("n_runs")))).select(*by, "label")


def find_gapped(runs: DataFrame, length: int = 2, min_count: int = 3, q: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs or triples of frequent labels with anything between, over runs of known outcome.

    Each run lists its patterns within its row (greedy: a pattern is complete at its earliest possible end);
    only (pattern, outcome, position) is shuffled, once."""
    known = runs.where("success IS NOT NULL")
    labels = frequent_labels(known, min_count, by=by).groupBy(*by).agg(F.collect_set("label").alias("frequent"))
    met = known.join(F.broadcast(labels), list(by)) if by else known.crossJoin(F.broadcast(labels))  # one row a stratum
    held = F.filter(F.transform("names", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: F.array_contains("frequent", z["x"]))

    def onwards(rest: Column) -> Column:
        """Each label of ``rest`` and its first place there."""
        return F.transform(F.array_distinct(F.transform(rest, lambda z: z["x"])), lambda x: F.filter(rest, lambda z: z["x"] == x)[0])

    first = lambda: F.transform(onwards(F.col("s")), lambda z: F.struct(z["x"].alias("p"), z["i"].alias("at")))
    rows = met.select(*by, "success", F.size("names").alias("n"), held.alias("s")).where(F.size("s") > 0).withColumn("f", first())
    for _ in range(length - 1):
        longer = F.flatten(F.transform("f", lambda f: F.transform(onwards(F.filter("s", lambda z: z["i"] > f["at"])), lambda z: F.struct(F.concat(f["p"], F.lit(" → ... → "), z["x"]).alias("p"), z["i"].alias("at")))))
        rows = rows.withColumn("f", longer)
    rows = rows.select(*by, "success", "n", F.explode("f").alias("f"))
    found = rows.groupBy(*by, F.col("f.p").alias("pattern")).agg(F.count("success").alias("n_with"), F.count_if(F.col("success")).alias("n_pass"), _exact_mean(F.col("f.at") / F.greatest(F.col("n") - 1, F.lit(1))).alias("avg_position"))
    return _tested(found, _totals(known, by), by, min_count, q)


def pruned_pairs(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """``pairs`` without those that a triple holds in order, with as many runs at least and no greater adjusted p.
    A triple holds three pairs at most, so the anti-join's right side is linear in triples."""
    gap = " → ... → "
    x = F.split("pattern", gap, -1)
    inside = triples.select(F.explode(F.array(*(F.concat_ws(gap, x[a], x[b]) for a, b in ((0, 1), (0, 2), (1, 2))))).alias("pattern"), F.col("n_with").alias("t_with"), F.col("q_value").alias("t_q"))
    a, b = pairs.alias("a"), inside.alias("b")
    return a.join(b, (F.col("a.pattern") == F.col("b.pattern")) & (F.col("b.t_with") >= F.col("a.n_with")) & (F.col("b.t_q") <= F.col("a.q_value")), "left_anti")


def all_motifs(contiguous: DataFrame, gapped: DataFrame, base_rate: float) -> DataFrame:
    """Both kinds in one order: least adjusted p first, then the success rate farthest from ``base_rate``."""
    both = contiguous.withColumn("kind", F.lit("contiguous")).unionByName(gapped.withColumn("kind", F.lit("gapped")))
    return both.orderBy("q_value", F.desc(F.abs(F.col("success_rate") - base_rate)), "pattern")


def transition_signals(runs: DataFrame, least_raw: int = 10, k: int = 5) -> DataFrame:
    """Adjacent label pairs whose rate differs most between passing and failing runs that edit; a side's rate
    is the mean over its runs that hold the pair."""
    edits = F.exists("steps", lambda s: s["name"].isin("edit", "write"))
    kept = runs.where(F.col("success").isNotNull() & edits & (F.size("names") >= 2))
    pairs = kept.select("run_id", "success", F.size("names").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda i: F.concat(F.get("names", i - 1), F.lit(" → "), F.get("names", i)))).alias("pair"))
    per_run = pairs.groupBy("run_id", "success", "n", "pair").agg(F.count(F.lit(1)).alias("c"))
    side = lambda s: F.coalesce(F.avg(F.when(F.col("success") == s, F.col("c") / F.greatest(F.lit(1), F.col("n") - 1))), F.lit(0.0))
    got = per_run.groupBy("pair").agg(F.sum("c").alias("n_raw"), side(True).alias("pass_rate"), side(False).alias("fail_rate")).where(F.col("n_raw") >= least_raw)
    return got.withColumn("delta", F.col("pass_rate") - F.col("fail_rate")).orderBy(F.desc(F.abs(F.col("delta"))), "pair").limit(k)
