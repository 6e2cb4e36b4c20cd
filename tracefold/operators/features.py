"""Behavioural features of runs and within-task natural experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.stats import adjusted, sign_test
from tracefold.operators.cohorts import in_tasks, task_groups

#: Ideal positions of phases, and phrases that hedge or state a hypothesis.
IDEAL = {"explore": 0.2, "modify": 0.5, "verify": 0.85}
HYPOTHESIS = (
    r"\bi think (?:the|this|it)\b|\bthe (?:root )?cause (?:is|might be|could be|seems)\b|\bthis (?:fails?|errors?|breaks?) because\b"
    r"|\bthe (?:issue|problem|bug|error) (?:is|seems|appears|might be)\b|\bmy (?:hypothesis|theory|guess)\b|\bi (?:suspect|believe|hypothesize)\b"
    r"|\bthis (?:is likely|is probably|seems to be|appears to be)\b|\bthe reason (?:is|for)\b|\bwhat(?:'s| is) happening (?:is|here)\b|\bthis (?:suggests?|indicates?|means?)\b"
)
#: Words of doubt and new attempts, of cause, of diagnosis, and references to code.
HEDGES = r"(?i)\bmaybe\b|\bmight\b|\bpossibly\b|\bactually,|\blet me (?:try|step back|reconsider)\b|\banother approach\b"
CAUSES = r"(?i)\bbecause\b|\bsince\b|\btherefore\b|\bthus\b|\bcaused by\b|\bdue to\b|\bresult of\b"
DIAGNOSES = r"(?i)\bthe issue is\b|\bthe problem is\b|\broot cause\b|\bthis happens when\b|\bfails? because\b|\berror.{0,20}because\b"
CODE = r"\.py\b|line \d+|def \w+|class \w+|import \w+"
LEAST_SIDE = 3


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def test_position_centroid(names: str = "names", least_steps: int = 5, least_tests: int = 2) -> Column:
    n = F.size(names)
    at = F.filter(F.transform(names, lambda x, i: F.when(x.startswith("test("), F.coalesce(F.try_divide(i.cast("double"), (n - 1).cast("double")), F.lit(0.0)))), lambda p: p.isNotNull())
    return F.when((n >= least_steps) & (F.size(at) >= least_tests), _mean(at))


def symmetry_index(phases: str = "phases") -> Column:
    n, ideal = F.size(phases), F.create_map(*(F.lit(x) for p in IDEAL.items() for x in p))
    scores = F.filter(F.transform(phases, lambda p, i: 1.0 - F.abs(i / (n - 1) - F.element_at(ideal, p))), lambda s: s.isNotNull())
    return F.when((n >= 6) & (F.size(scores) >= 4), _mean(scores))


def _reasoning() -> Column:
    return F.filter(F.transform("steps", lambda s: s["reasoning"]), lambda r: F.coalesce(r, F.lit("")) != "")


def uncertainty_density(pattern: str = HEDGES) -> Column:
    """Share of reasoning steps that hedge; null without reasoning."""
    r = _reasoning()
    return F.try_divide(F.size(F.filter(r, lambda x: x.rlike(pattern))).cast("double"), F.size(r).cast("double"))


def hypothesis_formation(pattern: str = HYPOTHESIS) -> Column:
    """Matches for each reasoning step; null without reasoning."""
    r = _reasoning()
    return F.try_divide(F.aggregate(r, F.lit(0), lambda a, x: a + F.regexp_count(F.lower(x), F.lit(pattern))).cast("double"), F.size(r).cast("double"))


def reasoning_metrics(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Matches of each kind for a reasoning step, and characters of reasoning for any step; no row without reasoning."""
    kinds = {"uncertainty_density": HEDGES, "causal_density": CAUSES, "diagnosis_density": DIAGNOSES, "code_ref_density": CODE}
    r = _reasoning()
    count = lambda f: F.aggregate("__r", F.lit(0).cast("long"), lambda a, x: a + f(x))
    rows = runs.select(*by, F.size("steps").alias("__n"), r.alias("__r"))
    rows = rows.select(*by, "__n", F.size("__r").alias("__k"), count(F.length).alias("__chars"), *(count(lambda x, p=p: F.regexp_count(x, F.lit(p))).alias(k) for k, p in kinds.items()))
    sums = rows.groupBy(*by).agg(F.sum("__n").alias("__n"), F.sum("__k").alias("n_reasoning_steps"), F.sum("__chars").alias("__chars"), *(F.sum(k).alias(k) for k in kinds))
    return sums.where("n_reasoning_steps > 0").select(*by, *((F.col(k) / F.col("n_reasoning_steps")).alias(k) for k in kinds), (F.col("__chars") / F.col("__n")).alias("reasoning_per_step"), "n_reasoning_steps")


def test_centroid(names: str = "names") -> Column:
    """Mean position in 0..1 of tests among labelled steps, without thresholds; null without tests."""
    at = F.filter(F.transform(names, lambda x, i: F.when(x.startswith("test("), i / F.greatest(F.size(names) - 1, F.lit(1)))), lambda p: p.isNotNull())
    return F.when(F.size(at) > 0, _mean(at))


def edit_dispersion() -> Column:
    files = F.transform(F.filter(F.arrays_zip("names", "name_pos"), lambda z: z["names"].startswith("edit(")), lambda z: F.coalesce(F.get("steps", z["name_pos"])["file_path"], F.lit("")))
    return F.when(F.size(files) >= 2, F.size(F.array_distinct(files)) / F.size(files))


def feature_columns() -> dict[str, Column]:
    return {
        "test_position_centroid": test_position_centroid(), "symmetry_index": symmetry_index(), "uncertainty_density": uncertainty_density(),
        "reasoning_hypothesis_formation": hypothesis_formation(), "edit_dispersion": edit_dispersion(),
    }


def run_features(runs: DataFrame) -> DataFrame:
    """run_id, task_id, success and one column for each feature; no shuffle."""
    return runs.select("run_id", "task_id", "success", *(c.alias(k) for k, c in feature_columns().items()))


def task_deltas(features: DataFrame, names: list[str], least_side: int = LEAST_SIDE) -> DataFrame:
    """(task_id, feature, delta): pass rate of the runs above the task's upper median less that of the others.

    All features in one shuffle: they are unpivoted first. A task's values are gathered only to find the
    median, a task being a bounded group of runs."""
    long = features.where("success IS NOT NULL").select("task_id", "success", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names))).alias("f")).select("task_id", "success", "f.*").where("v IS NOT NULL")
    got = long.groupBy("task_id", "feature").agg(F.sort_array(F.collect_list(F.struct("v", "success"))).alias("r"))
    cut = F.element_at("r", F.floor(F.size("r") / 2).cast("int") + 1)["v"]
    split = got.where(F.size("r") >= 2 * least_side).withColumn("high", F.filter("r", lambda x: x["v"] > cut)).withColumn("low", F.filter("r", lambda x: x["v"] <= cut))
    rate = lambda c: F.size(F.filter(c, lambda x: x["success"])) / F.size(c)
    return split.where((F.size("high") >= least_side) & (F.size("low") >= least_side)).select("task_id", "feature", (rate("high") - rate("low")).alias("delta"))


def rank_features(runs: DataFrame, min_runs: int = 10, seed: str = "0", least_side: int = LEAST_SIDE) -> DataFrame:
    """Each feature's mean within-task delta in points, its sign test, both halves' and the adjusted p; largest first.

    Tasks are halved by a hash of seed and task id, so no list of tasks reaches the driver."""
    tasks = task_groups(runs, min_runs).where("skip_reason IS NULL")
    names = list(feature_columns())
    deltas = task_deltas(run_features(in_tasks(runs, tasks)), names, least_side)
    half = (F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("task_id"))), 1, 1) < "8").cast("int")
    signs = [f(F.when(w, s)).alias(f"{n}_{t}") for t, w in (("all", F.lit(True)), ("h0", F.col("half") == 0), ("h1", F.col("half") == 1)) for n, f, s in (("p", F.count_if, F.col("delta") > 0), ("m", F.count_if, F.col("delta") < 0))]
    agg = deltas.withColumn("half", half).groupBy("feature").agg((100 * F.avg("delta")).alias("delta_pp"), F.count(F.lit(1)).alias("n_tasks"), *signs)
    test = lambda t: sign_test(F.col(f"p_{t}"), F.col(f"m_{t}"))
    ranked = agg.select("feature", "delta_pp", "n_tasks", test("all").alias("p_value"), (F.coalesce(test("h0") < 0.05, F.lit(False)) & F.coalesce(test("h1") < 0.05, F.lit(False))).alias("holds_in_halves"))
    return adjusted(ranked).orderBy(F.desc(F.abs("delta_pp")), "feature")


def experiment_columns() -> dict[str, Column]:
    """Further per-run features: counts and shares of kinds of steps, loops of failing tests, files touched."""
    n = F.size("names")
    share = lambda *starts: F.when(n > 0, F.size(F.filter("names", lambda x: _any(x, starts))) / n)
    tests = F.filter(F.transform("names", lambda x, i: F.when(x.startswith("test("), i)), lambda i: i.isNotNull())
    # failing tests in a row of any length between them, broken only by an edit
    loop = F.aggregate("names", F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), lambda a, x: F.struct(
        F.when(x.startswith("edit"), 0).when(x == "test(fail)", a["run"] + 1).otherwise(a["run"]).alias("run"),
        F.greatest(a["most"], F.when(x == "test(fail)", a["run"] + 1).otherwise(0)).alias("most")), lambda a: a["most"])
    files = lambda name: F.size(F.array_distinct(F.filter(F.transform(F.filter("steps", lambda s: s["name"] == name), lambda s: s["file_path"]), lambda p: F.coalesce(p, F.lit("")) != ""))).cast("long")
    return {
        "n_labels": n.cast("long"),
        "exploration_ratio": share("read", "search"),
        "edit_density": share("edit", "write"),
        "bash_ratio": share("bash"),
        "late_test_ratio": F.when(F.size(tests) > 0, F.size(F.filter(tests, lambda i: i >= F.floor(n / 2))) / F.size(tests)),
        "test_fail_loop": loop >= 3,
        "files_read": files("read"),
        "files_edited": files("edit"),
    }


def _any(x: Column, starts: tuple[str, ...]) -> Column:
    found = x.startswith(starts[0])
    for s in starts[1:]:
        found = found | x.startswith(s)
    return found


def experiment_features(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "task_id", "success", *(c.alias(k) for k, c in experiment_columns().items()))


def exemplar_tasks(features: DataFrame, name: str, least: int = 5, delta: float = 0.05, k: int = 1) -> DataFrame:
    """Tasks in which passing and failing runs, ``least`` of each, differ most in a feature's mean."""
    mean = lambda s: F.avg(F.when(F.col("success") == s, F.col(name)))
    have = lambda s: F.count(F.when(F.col("success") == s, F.col(name)))
    got = features.groupBy("task_id").agg(mean(True).alias("pass_mean"), mean(False).alias("fail_mean"), have(True).alias("n_pass"), have(False).alias("n_fail"))
    got = got.where((F.col("n_pass") >= least) & (F.col("n_fail") >= least)).withColumn("gap", F.abs(F.col("pass_mean") - F.col("fail_mean")))
    return got.where(F.col("gap") >= delta).orderBy(F.desc("gap"), "task_id").limit(k)
