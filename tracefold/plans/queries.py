"""Queries over the driver's tables, one for each operator or family, and SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.labels import compressed, phase, signature, step_label, with_sequences
from tracefold.functions.stats import adjusted
from tracefold.operators import align, cohorts, divergence, experiments, features, motifs, preferences
from tracefold.sources import fenced_dialogues, tool_logs
from tracefold.sources.trajectories import conversations_as_runs, first_by, read_events

CAUSES = [
    {"id": "less_testing", "expected_shifts": {"TEST_AFTER_EDIT_RATE": "decrease", "ITERATIVE_FIX_RATE": "decrease"}},
    {"id": "tool_trouble", "expected_shifts": {"TOOL_TIMEOUT_ERROR_RATE": "increase", "STEP_FAILURE_RATE": "increase"}, "prior": 0.3},
]


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(F.col(c), 6).alias(c) if c in names else F.col(c) for c in df.columns))


def _runs(spark: SparkSession, d: str, grain: str = "day") -> DataFrame:
    """Canonical runs with label sequences. Workers import this package from where the driver has it."""
    import os
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return with_sequences(read_events(spark, d, grain))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Runs as two variants: users of even and odd number; their tasks are the last digit of the user."""
    user = F.split("run_id", ":")[0].cast("long")
    return _runs(spark, d).withColumn("variant", F.when(user % 2 == 0, "a").otherwise("b")).withColumn("task_id", (F.floor(user / 2) % 10).cast("string"))


def enriched_steps(spark, d):
    return _runs(spark, d).select("run_id", F.explode("steps").alias("s")).select("run_id", F.col("s.pos").cast("long").alias("pos"), step_label(F.col("s")).alias("label"), phase(F.col("s.name"), F.col("s.type")).alias("phase"), F.col("s.status").alias("status"))


def compressed_runs(spark, d):
    return _runs(spark, d).select("run_id", compressed(F.col("names")).alias("steps"), compressed(F.col("phases")).alias("phases"))


def run_signatures(spark, d):
    return _runs(spark, d).select("run_id", signature(F.col("steps")).alias("signature"), F.size("steps").cast("long").alias("n_steps"), "success")


def run_summary(spark, d):
    return _round(cohorts.summary(_runs(spark, d)), "success_rate", "avg_steps")


def top_signatures(spark, d):
    return cohorts.top_signatures(_runs(spark, d))


def phase_counts(spark, d):
    return cohorts.phase_counts(_runs(spark, d))


def task_groups(spark, d):
    return cohorts.task_groups(_runs(spark, d))


def mixed_tasks_unknown_fails(spark, d):
    return cohorts.mixed_tasks(_runs(spark, d), 3, True)


def filtered_runs(spark, d):
    return cohorts.filter_runs(_runs(spark, d), task_id="7").select("run_id", "success", F.size("steps").cast("long").alias("n_steps"))


def first_runs(spark, d):
    runs = _runs(spark, d)
    return first_by(runs.select("task_id", "run_id", F.size("steps").cast("long").alias("n_steps")), ["task_id"], "run_id")


def run_features(spark, d):
    f = features.run_features(_runs(spark, d)).select("run_id", "test_position_centroid", "symmetry_index", "edit_dispersion")
    return _round(f, "test_position_centroid", "symmetry_index", "edit_dispersion")


def experiment_features(spark, d):
    return _round(features.experiment_features(_runs(spark, d)).drop("task_id", "success"), "exploration_ratio", "edit_density", "bash_ratio", "late_test_ratio")


def exemplar_tasks(spark, d):
    return _round(features.exemplar_tasks(features.experiment_features(_runs(spark, d)), "exploration_ratio", 3, k=10), "pass_mean", "fail_mean", "gap")


def feature_deltas(spark, d):
    runs = _runs(spark, d)
    tasks = cohorts.task_groups(runs).where("skip_reason IS NULL")
    return _round(features.task_deltas(features.run_features(cohorts.in_tasks(runs, tasks)), ["edit_dispersion", "symmetry_index", "test_position_centroid"], 1), "delta")


def rank_features(spark, d):
    return _round(features.rank_features(_runs(spark, d), least_side=1), "delta_pp", "p_value", "q_value")


def cohort_behaviours(spark, d):
    return _round(cohorts.cohort_behaviours(_variants(spark, d), ("variant",)), "value")


def variant_shifts(spark, d):
    return _round(cohorts.variant_shifts(_variants(spark, d), "variant", "a", "b").drop("magnitude"), "baseline", "current", "shift", "effect_size", "ci_low", "ci_high")


def task_breakdown(spark, d):
    return _round(cohorts.task_breakdown(_variants(spark, d), "variant", "a", "b"), "baseline_rate", "current_rate", "delta")


def cause_scores(spark, d):
    return _round(cohorts.score_causes(cohorts.variant_shifts(_variants(spark, d), "variant", "a", "b"), CAUSES), "evidence", "score")


def cause_intervals(spark, d):
    return _round(cohorts.bootstrap_confidence(_variants(spark, d), "variant", "a", "b", CAUSES), "evidence", "score", "ci_lower", "ci_upper")


def effect_magnitudes(spark, d):
    return cohorts.variant_shifts(_variants(spark, d), "variant", "a", "b").select("feature", "magnitude")


def available_values(spark, d):
    return cohorts.available_values(_variants(spark, d), ("variant", "task_id", "model"))


def tagged_runs(spark, d):
    """Runs by key=value: a field, and a boolean tag that reads as text."""
    tag = F.create_map(F.lit("long"), (F.size("steps") >= 3).cast("string"), F.lit("cohort"), F.col("variant"))
    runs = cohorts.apply_filters(_variants(spark, d).withColumn("tags", tag).drop("variant"), ["task_id=1", "task_id=3", "long=True", "cohort=a", "name_unset="])
    return runs.select("run_id", F.size("steps").cast("long").alias("n_steps"))


def phase_summaries(spark, d):
    return cohorts.phase_summary(_variants(spark, d), ("variant",)).select("variant", F.col("n_steps").cast("long").alias("n_steps"), "summary")


def signature_stats(spark, d):
    return _round(cohorts.cluster_stats(_variants(spark, d), "task_id"), "success_rate", "avg_steps")


def test_centroids(spark, d):
    return _round(_runs(spark, d).select("run_id", features.test_centroid().alias("centroid")), "centroid")


def reasoning_metrics(spark, d):
    runs = conversations_as_runs(spark.read.parquet(f"{d}/conversations.parquet"))
    return _round(features.reasoning_metrics(runs, ()), "uncertainty_density", "causal_density", "diagnosis_density", "code_ref_density", "reasoning_per_step")


def reasoning_features(spark, d):
    runs = conversations_as_runs(spark.read.parquet(f"{d}/conversations.parquet"))
    return _round(runs.select("run_id", features.uncertainty_density().alias("uncertainty_density"), features.hypothesis_formation().alias("reasoning_hypothesis_formation")), "uncertainty_density", "reasoning_hypothesis_formation")


def _logs(spark, d):
    """A log of tool calls for each run."""
    said = lambda s: F.when(s["name"] == "read", F.concat(F.lit("Read "), s["file_path"])).when(s["name"] == "edit", F.concat(F.lit("Edit "), s["file_path"])).when(s["pattern"] == "*.py", "Glob: *.py").when(
        s["name"] == "search", F.concat(F.lit("Grep: "), s["pattern"])).when(s["name"] == "test", "Bash: npm test").otherwise(F.concat(F.lit("Bash: "), s["command"]))
    log = F.concat(F.array_join(F.transform("steps", lambda s: F.concat(F.lit("noise\n[tool] "), said(s))), "\n"), F.lit("\n[result] done"))
    return read_events(spark, d).select("run_id", F.concat(F.lit("family-"), "task_id").alias("task_id"), "success", log.alias("log"))


def converted_logs(spark, d):
    runs = tool_logs.trials_as_runs(_logs(spark, d))
    return runs.select("run_id", "task_family", F.explode("steps").alias("s")).select("run_id", "task_family", F.col("s.pos").cast("long").alias("pos"), "s.type", "s.name", "s.file_path", "s.pattern", "s.command", "s.result")


def converted_dialogues(spark, d):
    """Each run as a dialogue: a reply with a command in a fence, and what came of it."""
    typed = lambda s: F.coalesce(s["command"], F.when(s["name"] == "read", F.concat(F.lit("open "), s["file_path"], F.lit(" 10"))).when(s["name"] == "edit", "edit 1:2").when(s["name"] == "search", "search_dir needle").otherwise("pytest -q"))
    said = F.flatten(F.transform("steps", lambda s: F.array(
        F.struct(F.lit("ai").alias("role"), F.concat(F.lit("Now\n```\n"), typed(s), F.lit("\n```")).alias("text")), F.struct(F.lit("user").alias("role"), s["status"].alias("text")))))
    rows = read_events(spark, d).select("run_id", F.concat(F.lit("o__n-"), "task_id").alias("task_id"), "success", said.alias("messages"))
    runs = fenced_dialogues.dialogues_as_runs(rows).select("run_id", "task_family", F.explode("steps").alias("s"))
    return runs.select("run_id", "task_family", F.col("s.pos").cast("long").alias("pos"), "s.type", "s.name", "s.file_path", "s.reasoning", "s.action", "s.result")


def log_compliance(spark, d):
    return _round(tool_logs.compliance(_logs(spark, d)).select("run_id", "source_edits", "tested_edits", "compliance_rate"), "compliance_rate")


def compliance_outcomes(spark, d):
    return tool_logs.compliance_outcomes(tool_logs.compliance(_logs(spark, d)))


def step_histogram(spark, d):
    return experiments.histogram(_variants(spark, d).select("variant", F.size("steps").alias("n_steps")), "n_steps", 0, 6, 4, ("variant",))


def centred_correlation(spark, d):
    return _round(experiments.centred_correlation(_runs(spark, d).select("task_id", "success", F.size("steps").alias("n_steps")), "n_steps"), "r", "p_value")


def step_rank_test(spark, d):
    return _round(experiments.rank_test(_runs(spark, d).select("success", F.size("steps").alias("n_steps")), "n_steps"), "rank_biserial", "p_value")


def rate_delta_interval(spark, d):
    return _round(experiments.rate_delta_interval(_variants(spark, d), F.col("variant") == "b"), "delta", "ci_lower", "ci_upper")


def exclusive_signatures(spark, d):
    v = _variants(spark, d)
    return cohorts.exclusive_signatures(v.where("variant = 'a'"), v.where("variant = 'b'"))


def contiguous_motifs(spark, d):
    return _round(motifs.find_motifs(_runs(spark, d), 2, 3, q=1.0), "avg_position", "success_rate", "lift", "p_value", "q_value")


def stratified_motifs(spark, d):
    by_variant = motifs.find_motifs(_variants(spark, d), 2, 2, q=1.0, by=("variant",))
    return _round(motifs.best_strata(by_variant, ("variant",)), "avg_position", "success_rate", "lift", "p_value", "q_value")


def gapped_pairs(spark, d):
    return _round(motifs.find_gapped(_runs(spark, d), 2, q=1.0), "avg_position", "success_rate", "lift", "p_value", "q_value")


def stratified_gapped(spark, d):
    by_variant = motifs.find_gapped(_variants(spark, d), 2, q=1.0, by=("variant",))
    return _round(motifs.best_strata(by_variant, ("variant",)), "avg_position", "success_rate", "lift", "p_value", "q_value")


def pruned_gapped_pairs(spark, d):
    runs = _runs(spark, d)
    kept = motifs.pruned_pairs(motifs.find_gapped(runs, 2, q=1.0), motifs.find_gapped(runs, 3, q=1.0))
    return _round(kept.select("pattern", "n_with", "n_pass", "p_value", "q_value"), "p_value", "q_value")


def gapped_triples(spark, d):
    return _round(motifs.find_gapped(_runs(spark, d), 3, q=1.0), "avg_position", "success_rate", "lift", "p_value", "q_value")


def transition_signals(spark, d):
    return _round(motifs.transition_signals(_runs(spark, d)), "pass_rate", "fail_rate", "delta")


def divergence_points(spark, d):
    return _round(divergence.divergence_points(divergence.position_cells(_runs(spark, d)), q=1.0), "entropy", "p_value", "q_value").select(F.col("group_id"), F.col("col").cast("long").alias("col"), F.col("n_values").cast("long").alias("n_values"), "min_branch", "entropy", "p_value", "q_value")


def population_pairs(spark, d):
    cells = divergence.position_cells(_runs(spark, d))
    return _round(divergence.population_pairs(cells, q=1.0), "preferred_rate", "dispreferred_rate", "p_value", "q_value").withColumn("col", F.col("col").cast("long"))


def position_consensus(spark, d):
    return divergence.consensus(divergence.position_cells(_runs(spark, d))).select("group_id", F.col("col").cast("long").alias("col"), "value")


def column_activity(spark, d):
    runs = _runs(spark, d)
    return _round(divergence.activity(divergence.position_cells(runs), runs), "direction", "p_value", "q_value").withColumn("col", F.col("col").cast("long"))


def adjusted_p(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return _round(adjusted(events.groupBy("user_id").agg(F.avg("value").alias("v")).select("user_id", F.when(F.col("v") < 70, F.col("v") / 100).alias("p_value"))), "p_value", "q_value")


def preference_candidates(spark, d):
    pairs = preferences.run_pairs(preferences.capped_sides(_runs(spark, d)))
    return pairs.select("task_id", "pass_run", "fail_run")


def preference_pairs(spark, d):
    return _round(preferences.preference_pairs(_runs(spark, d), min_content=0), "position")


def preference_jsonl(spark, d):
    return preferences.as_dpo(preferences.preference_pairs(_runs(spark, d), min_content=0))


def preference_topics(spark, d):
    pairs = preferences.preference_pairs(_runs(spark, d), min_content=0).select("context", "preferred", "dispreferred")
    return preferences.cluster_pairs(pairs).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def alignment_distances(spark, d):
    return _round(align.pairwise_distances(_runs(spark, d, "user")), "distance")


def multiple_alignment(spark, d):
    return align.aligned_cells(_runs(spark, d))


def aligned_divergence(spark, d):
    return _round(divergence.divergence_points(align.aligned_cells(_runs(spark, d)), q=0.5), "entropy", "p_value", "q_value")


def run_clusters(spark, d):
    return align.clusters(_runs(spark, d, "user"), threshold=0.5)


def cluster_splits(spark, d):
    return _round(align.splits(_runs(spark, d, "user")), "height", "left_rate", "right_rate")


def run_concordance(spark, d):
    return _round(align.concordance(_runs(spark, d)), "tau", "p_value")


def motif_permutation_fdr(spark, d):
    return _round(preferences.permutation_fdr(_runs(spark, d)), "null_mean", "fdr")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    rank_features, enriched_steps, compressed_runs, run_signatures, run_summary, top_signatures, phase_counts, task_groups, mixed_tasks_unknown_fails, filtered_runs, first_runs,
    run_features, experiment_features, exemplar_tasks, feature_deltas, cohort_behaviours, variant_shifts, task_breakdown, cause_scores, cause_intervals, effect_magnitudes, available_values, tagged_runs, phase_summaries, signature_stats, test_centroids, reasoning_metrics, reasoning_features,
    converted_logs, converted_dialogues, log_compliance, compliance_outcomes, step_histogram, centred_correlation, step_rank_test, rate_delta_interval,
    exclusive_signatures, contiguous_motifs, stratified_motifs, stratified_gapped, gapped_pairs, pruned_gapped_pairs, population_pairs,
    gapped_triples, transition_signals, divergence_points, position_consensus, column_activity, adjusted_p, preference_candidates, preference_pairs,
    preference_jsonl, preference_topics, alignment_distances, multiple_alignment, aligned_divergence, run_clusters, cluster_splits, run_concordance, motif_permutation_fdr,
)}
