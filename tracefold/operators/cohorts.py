"""Cohorts: filters, task groups, summaries, comparisons. ``runs`` is the canonical form (see sources)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.labels import signature
from tracefold.functions.stats import cohens_h, delta_interval, effect_magnitude


def filter_runs(runs: DataFrame, **fields: str) -> DataFrame:
    """Runs whose fields equal the given values; an empty value doesn't filter, an absent column matches nothing."""
    for name, value in fields.items():
        if value:
            runs = runs.where(F.col(name).cast("string") == str(value)) if name in runs.columns else runs.where(F.lit(False))
    return runs


def task_outcomes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count("success").alias("n_known"),
        F.count_if(F.col("success")).alias("n_pass"), F.count_if(~F.col("success")).alias("n_fail"),
    )


def task_groups(runs: DataFrame, min_runs: int = 10) -> DataFrame:
    """Each task's counts and why it is skipped: too_few_runs, all_fail, all_pass; null where it qualifies."""
    reason = F.when(F.col("n_known") < min_runs, "too_few_runs").when(F.col("n_pass") == 0, "all_fail").when(F.col("n_fail") == 0, "all_pass")
    return task_outcomes(runs).withColumn("skip_reason", reason)


def mixed_tasks(runs: DataFrame, min_runs: int = 0, unknown_fails: bool = False) -> DataFrame:
    """Task ids with passing and failing runs; with ``unknown_fails`` a run of unknown outcome counts as failing."""
    passed = F.coalesce("success", F.lit(False)) if unknown_fails else F.col("success")
    return runs.groupBy("task_id").agg(F.bool_or(passed).alias("p"), F.bool_or(~passed).alias("f"), F.count(passed).alias("n")).where(f"p AND f AND n >= {min_runs}").select("task_id")


def in_tasks(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    return runs.join(tasks.select("task_id").distinct(), "task_id", "left_semi")


def summary(runs: DataFrame) -> DataFrame:
    """One row: count, success rate over known outcomes, mean and true median of step counts."""
    n = F.size("steps")
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg(n).alias("avg_steps"), F.median(n).cast("double").alias("median_steps"))


def top_signatures(runs: DataFrame, k: int = 10) -> DataFrame:
    """The k commonest type:name sequences; ties by their text."""
    return runs.groupBy(signature(F.col("steps")).alias("signature")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(k)


def exclusive_signatures(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signatures that only one cohort has, with its name ('a', 'b') and count."""
    count = lambda r: r.groupBy(signature(F.col("steps")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    left, right = count(a), count(b)
    return left.join(right, "signature", "left_anti").withColumn("side", F.lit("a")).unionByName(right.join(left, "signature", "left_anti").withColumn("side", F.lit("b")))


def phase_counts(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode("phases").alias("phase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


# --- behaviour of a cohort, and two variants ------------------------------------------------------


def _adjacent(*starts: str) -> Column:
    """Whether labels with these beginnings follow each other."""
    n = len(starts)
    return F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("names") - n)), lambda i: _all([F.coalesce(F.get("names", i + k).startswith(s), F.lit(False)) for k, s in enumerate(starts)]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _blind_submit() -> Column:
    state = F.struct(F.lit(False).alias("edit"), F.lit(False).alias("test"), F.lit(False).alias("blind"))
    step = lambda s, n: F.struct(
        (s["edit"] | n.startswith("edit")).alias("edit"),
        F.when(n.startswith("edit"), False).otherwise(s["test"] | n.startswith("test")).alias("test"),
        (s["blind"] | ((n.startswith("finish") | (n == "submit")) & s["edit"] & ~s["test"])).alias("blind"),
    )
    return F.aggregate("names", state, step, lambda s: s["blind"])


#: name -> (numerator, denominator) of a run; a cohort's value is the ratio of sums.
def behaviours() -> dict[str, tuple[Column, Column]]:
    one, n = F.lit(1), F.size("steps")
    steps_where = lambda f: F.size(F.filter("steps", f))
    return {
        "TEST_AFTER_EDIT_RATE": (_adjacent("edit", "test").cast("int"), one),
        "ITERATIVE_FIX_RATE": (_adjacent("edit", "test", "edit").cast("int"), one),
        "BLIND_SUBMIT_RATE": (_blind_submit().cast("int"), one),
        "TOOL_TIMEOUT_ERROR_RATE": (F.exists("steps", lambda s: s["status"].isin("error", "timeout") & s["name"].isin("bash", "execute", "unknown")).cast("int"), one),
        "STEP_FAILURE_RATE": (steps_where(lambda s: s["status"] != "ok"), n),
        "AVG_STEP_COUNT": (n, one),
        "SEARCH_BEFORE_EDIT_RATE": (_adjacent("search", "edit").cast("int"), one),
        "REASONING_DENSITY": (steps_where(lambda s: F.coalesce(s["reasoning"], F.lit("")) != ""), n),
    }


def cohort_behaviours(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., feature, value, n_runs): one pass and one aggregate, then unpivoted."""
    named = behaviours()
    sums = [f(x).alias(f"{k}_{t}") for k, pair in named.items() for t, f, x in (("a", F.sum, pair[0]), ("b", F.sum, pair[1]))]
    wide = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *sums)
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), F.coalesce(F.try_divide(F.col(f"{k}_a").cast("double"), F.col(f"{k}_b").cast("double")), F.lit(0.0)).alias("value")) for k in named))
    return wide.select(*by, "n_runs", F.explode(rows).alias("r")).select(*by, "n_runs", "r.*")


def shifts_of(values: DataFrame, variant: str, baseline: str, current: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per behaviour: both values, shift, effect size, its magnitude and the interval; rates by Cohen's h, the step count relative."""
    wide = values.groupBy(*by, "feature").agg(
        *(F.coalesce(F.max(F.when(F.col(variant) == v, F.col(c))), F.lit(0)).alias(f"{c}_{s}") for s, v in (("b", baseline), ("c", current)) for c in ("value", "n_runs"))
    )
    rate = F.col("feature") != "AVG_STEP_COUNT"
    low, high = delta_interval(F.col("value_b"), F.col("n_runs_b"), F.col("value_c"), F.col("n_runs_c"))
    shift = F.col("value_c") - F.col("value_b")
    effect = F.when(rate, cohens_h(F.col("value_c"), F.col("value_b"))).otherwise(shift / F.greatest(F.abs("value_b"), F.abs("value_c"), F.lit(1.0)))
    return wide.select(*by, "feature", F.col("value_b").alias("baseline"), F.col("value_c").alias("current"), shift.alias("shift"), effect.alias("effect_size"), effect_magnitude(effect).alias("magnitude"), F.when(rate, low).alias("ci_low"), F.when(rate, high).alias("ci_high"))


def variant_shifts(runs: DataFrame, variant: str, baseline: str, current: str) -> DataFrame:
    return shifts_of(cohort_behaviours(runs.where(F.col(variant).isin(baseline, current)), (variant,)), variant, baseline, current)


def task_breakdown(runs: DataFrame, variant: str, baseline: str, current: str) -> DataFrame:
    """Pass rates of both variants for each task; a missing side counts as rate 0 of 0 runs. One shuffle on task_id."""
    side = lambda v: F.col(variant) == v
    rate = lambda v: F.coalesce(F.avg(F.when(side(v), F.col("success").cast("double"))), F.lit(0.0))
    return runs.where(F.col(variant).isin(baseline, current)).groupBy("task_id").agg(
        rate(baseline).alias("baseline_rate"), rate(current).alias("current_rate"), F.count_if(side(baseline)).alias("baseline_runs"), F.count_if(side(current)).alias("current_runs"),
    ).withColumn("delta", F.col("current_rate") - F.col("baseline_rate"))


def score_causes(shifts: DataFrame, causes: list[dict], unknown_prior: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidate causes (id, expected_shifts, prior) by evidence: a shift in the expected direction counts its
    effect, one against it half of it negatively; what no cause claims goes to '_unknown'. Scores sum to 1, for
    each value of ``by``."""
    spark = shifts.sparkSession
    auto = 1.0 / (len(causes) + 1)
    prior = {c["id"]: c.get("prior") or auto for c in causes} | {"_unknown": unknown_prior if unknown_prior > 0 else auto}
    total = sum(prior.values())
    claims = [(c["id"], f, d) for c in causes for f, d in c["expected_shifts"].items()]
    claimed = sorted({f for _, f, _ in claims})
    wanted = spark.createDataFrame(claims, "cause_id string, feature string, direction string")
    priors = F.array(*(F.struct(F.lit(k).alias("cause_id"), F.lit(v / total).alias("prior")) for k, v in prior.items()))
    size = F.abs("effect_size")
    agrees = F.when(F.col("direction") == "increase", F.col("shift") > 0).when(F.col("direction") == "decrease", F.col("shift") < 0).otherwise(False)
    known = shifts.join(F.broadcast(wanted), "feature").select(*by, "cause_id", F.when(agrees, size).otherwise(-0.5 * size).alias("e"))  # a few rows a cause
    other = shifts.where(~F.col("feature").isin(claimed) & (size > 0.1)).select(*by, F.lit("_unknown").alias("cause_id"), size.alias("e"))
    none = shifts.select(*by).distinct().select(*by, F.explode(priors).alias("p")) if by else spark.range(1).select(F.explode(priors).alias("p"))
    listed = none.select(*by, "p.cause_id", "p.prior")
    raw = known.unionByName(other).groupBy(*by, "cause_id").agg(F.sum("e").alias("evidence"))
    weighed = listed.join(raw, [*by, "cause_id"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0.0))).withColumn("w", F.col("prior") * F.exp(F.least("evidence", F.lit(50.0))))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row a cause
    return weighed.select(*by, "cause_id", "evidence", (F.col("w") / F.sum("w").over(whole)).alias("score"))


#: Shares of the Poisson distribution of mean 1 up to each whole number.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def bootstrap_confidence(runs: DataFrame, variant: str, baseline: str, current: str, causes: list[dict], rounds: int = 200, seed: int = 42) -> DataFrame:
    """Scores of causes with the 2.5 and 97.5 per cent points of resampled scores (null under 20 rounds).

    A run's weight in a round is drawn from the Poisson distribution of mean 1 by a hash of run and round, so
    resampling is one pass with map-side sums: nothing but (variant, round) totals is shuffled."""
    own = runs.where(F.col(variant).isin(baseline, current))
    draw = (F.pmod(F.xxhash64("run_id", "round", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight = sum((draw > c).cast("int") for c in POISSON)
    pairs = behaviours()
    per_run = own.select("run_id", variant, *(x.alias(f"{k}_{t}") for k, ab in pairs.items() for t, x in zip("ab", ab, strict=True)))
    drawn = per_run.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", weight)
    sums = drawn.groupBy(variant, "round").agg(F.sum("w").alias("n_runs"), *(F.sum(F.col("w") * F.col(f"{k}_{t}")).alias(f"{k}_{t}") for k in pairs for t in "ab"))
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), F.coalesce(F.try_divide(F.col(f"{k}_a").cast("double"), F.col(f"{k}_b").cast("double")), F.lit(0.0)).alias("value")) for k in pairs))
    values = sums.select(variant, "round", "n_runs", F.explode(rows).alias("r")).select(variant, "round", "n_runs", "r.*")
    scored = score_causes(shifts_of(values, variant, baseline, current, ("round",)), causes, by=("round",))
    spread = scored.groupBy("cause_id").agg(F.sort_array(F.collect_list("score")).alias("s"))  # a value a round
    at = lambda share: F.when(F.size("s") >= 20, F.get("s", F.floor(F.size("s") * share).cast("int")))
    return score_causes(variant_shifts(runs, variant, baseline, current), causes).join(spread, "cause_id", "left").select("cause_id", "evidence", "score", at(0.025).alias("ci_lower"), at(0.975).alias("ci_upper"))


# --- filters and listings -------------------------------------------------------------------------


def parse_filter(text: str) -> tuple[str, str]:
    """``key=value``, split at the first sign; a key must be there."""
    key, sign, value = text.partition("=")
    if not sign or not key.strip():
        raise ValueError(f"not key=value: {text!r}")
    return key.strip(), value.strip()


def apply_filters(runs: DataFrame, texts: list[str]) -> DataFrame:
    """Runs that match all of ``key=value``: a field of that name, else a tag; of repeated keys the last holds. Booleans of
    tags read True and False."""
    for key, value in dict(map(parse_filter, texts)).items():
        if not value:
            continue
        if key in runs.columns and key != "tags":
            runs = runs.where(F.col(key).cast("string") == value)
        elif "tags" in runs.columns:
            tag = F.col("tags")[key]
            runs = runs.where(F.when(tag.isin("true", "false"), F.initcap(tag)).otherwise(tag) == value)
        else:
            runs = runs.where(F.lit(False))
    return runs


def available_values(runs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, value, n): what a filter could ask for."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields if f in runs.columns))
    return runs.select(F.explode(rows).alias("r")).select("r.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def phase_summary(runs: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Phases of each ``by`` with counts, as text: "explore 50%, modify 30%", most frequent first."""
    counts = runs.select(*by, F.explode("phases").alias("phase")).groupBy(*by, "phase").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "phase"))).alias("c"), F.sum("n").alias("n_steps"))  # a few phases
    return listed.select(*by, "n_steps", F.array_join(F.transform("c", lambda c: F.concat(c["phase"], F.lit(" "), F.round(-100 * c["m"] / F.col("n_steps")).cast("int").cast("string"), F.lit("%"))), ", ").alias("summary"))


def cluster_stats(runs: DataFrame, cluster: str) -> DataFrame:
    """Per cluster: runs, success rate over known outcomes, mean length and the commonest signature (ties by text)."""
    rows = runs.select(cluster, "success", F.size("steps").alias("n"), signature(F.col("steps")).alias("signature"))
    by_signature = rows.groupBy(cluster, "signature").agg(F.count(F.lit(1)).alias("c"), F.count("success").alias("known"), F.count_if(F.col("success")).alias("passed"), F.sum("n").alias("n"))
    return by_signature.groupBy(cluster).agg(F.sum("c").alias("n_runs"), F.try_divide(F.sum("passed").cast("double"), F.sum("known").cast("double")).alias("success_rate"), (F.sum("n") / F.sum("c")).alias("avg_steps"), F.min_by("signature", F.struct(-F.col("c"), "signature")).alias("prototype"))
