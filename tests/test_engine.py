"""Known answers for the trajectory engine, and its queries against DuckDB on a small scale."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracefold.functions import stats
from tracefold.functions.labels import compressed, label, with_sequences
from tracefold.operators import align, cohorts, features, motifs, preferences
from tracefold.sources.trajectories import STEP, load_runs

SF = "/root/testdata/sf0.001"


def runs_of(spark, table):
    """(run_id, task_id, success, names) -> canonical runs with plain steps."""
    rows = [(r, t, s, [(i, "tool", n, "ok", *[None] * 6) for i, n in enumerate(names)]) for r, t, s, names in table]
    return with_sequences(spark.createDataFrame(rows, f"run_id string, task_id string, success boolean, steps array<struct<{', '.join(f.replace(' ', ':') for f in STEP.split(', '))}>>"))


def test_labels(spark):
    cases = [
        (("read", "ok", "src/a.py", None, None), "read(source)"), (("edit", "ok", "README.md", None, None), "edit(config)"), (("write", "ok", "x/test_a.py", None, None), "write(test_file)"),
        (("read", "ok", "src", None, None), "read(dir)"), (("read", "ok", "a.rst", None, None), "read(docs)"), (("read", "ok", ".env", None, None), "read(other)"),
        (("search", "ok", None, "*.py", None), "search(glob)"), (("search", "ok", None, "foo", None), "search(specific)"), (("search", "ok", None, None, "grep -r x"), "search(grep_recursive)"),
        (("bash", "ok", None, None, "cd /a && pytest -q"), "test(pass)"), (("bash", "error", None, None, "python run_test.py"), "test(fail)"), (("bash", "ok", None, None, "cd /a; git log"), "bash(git)"),
        (("bash", "ok", None, None, "find . -name x"), "search(find)"), (("bash", "ok", None, None, "pip install x"), "bash(setup)"), (("bash", "ok", None, None, "make"), "bash(other)"),
        (("action", "ok", None, None, None), None), (("error_observation", "ok", None, None, None), None), (("test_result", "error", None, None, None), "test(fail)"), (("bash", "ok", None, None, None), "bash"),
    ]
    df = spark.createDataFrame([(*c, w) for c, w in cases], "name string, status string, file_path string, pattern string, command string, want string")
    got = df.select(label(*(F.col(c) for c in ("name", "status", "file_path", "pattern", "command"))).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_compression(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(compressed(F.col("s"))).collect()] == ["a×2 → b → a", "(empty)"]


def test_statistics(spark):
    tables = [(5, 0, 0, 5), (3, 2, 1, 4), (5, 5, 5, 5), (0, 0, 0, 0), (400, 300, 250, 420)]

    def exact(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        if not n:
            return None
        p = lambda x: math.comb(col, x) * math.comb(n - col, row - x) / math.comb(n, row)
        return min(1, sum(p(x) for x in range(max(0, row + col - n), min(row, col) + 1) if p(x) <= p(a) + 1e-10))

    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r, t in zip(df.select(stats.fisher_exact(*map(F.col, "abcd")).alias("p")).collect(), tables, strict=True):
        assert r.p == pytest.approx(exact(*t), abs=1e-8)
    signs = spark.createDataFrame([(5, 0), (3, 1), (20, 8)], "p long, m long").select(stats.sign_test(F.col("p"), F.col("m"))).collect()
    assert signs[0][0] == pytest.approx(0.0625) and signs[1][0] is None and signs[2][0] == pytest.approx(2 * sum(math.comb(28, i) for i in range(9)) / 2**28)
    p = [0.01, 0.04, None, 0.03, 0.005]
    q = {r.p_value: r.q_value for r in stats.adjusted(spark.createDataFrame([(x,) for x in p], "p_value double")).collect()}
    assert q[None] is None and q[0.005] == pytest.approx(0.02) and q[0.01] == pytest.approx(0.02) and q[0.03] == pytest.approx(0.04) and q[0.04] == pytest.approx(0.04)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_alignment_is_optimal(a, b):
    left, right = align.align_pair(a, b)
    assert [x for x in left if x is not None] == a and [y for y in right if y is not None] == b
    score = sum(1 if x == y else -1 for x, y in zip(left, right, strict=True))

    def best(i, j):
        if not i or not j:
            return -(i + j)
        return max(best(i - 1, j - 1) + (1 if a[i - 1] == b[j - 1] else -1), best(i - 1, j) - 1, best(i, j - 1) - 1)

    assert score == best(len(a), len(b)) and 0 <= align.distance(a, b) <= 1 and align.distance(a, a) == 0


def by_path(a, b):
    left, right = align.align_pair(a, b)
    return sum(x != y for x, y in zip(left, right, strict=True)) / len(left) if left else 0.0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8)), max_size=12))
def test_batches_of_distances_follow_the_paths(pairs):
    assert list(align.pair_distances([a for a, _ in pairs], [b for _, b in pairs])) == [by_path(a, b) for a, b in pairs]


def test_distances_by_blocks_are_of_all_pairs(spark):
    rng = random.Random(5)
    runs = {f"r{k}": [rng.choice("abcd") for _ in range(rng.randint(0, 6))] for k in range(150)}
    rows = spark.createDataFrame([("g", k, v) for k, v in runs.items()] + [("h", "only", ["a"])], "task_id string, run_id string, names array<string>")
    got = {(r.group_id, r.run_a, r.run_b): r.distance for r in align.pairwise_distances(rows).collect()}
    assert got == {("g", a, b): by_path(runs[a], runs[b]) for a, b in itertools.combinations(sorted(runs), 2)}


def test_multiple_alignment_and_clusters(spark):
    rows = align.align_group([list("abcd"), list("abd"), list("abcd"), list("xbcd")])
    assert len({len(r) for r in rows if r}) == 1 and ["".join(x or "" for x in r) for r in rows] == ["abcd", "abd", "abcd", "xbcd"]
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    merges = align.linkage(d)
    assert merges[0][:2] == (0, 1) and merges[1][2] == pytest.approx(0.85) and align.cut(merges, 3, 0.3) == [0, 0, 1]
    tau, p = align.kendall_tau(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 0, 0, 1, 1, 1]))
    assert tau == pytest.approx(0.7745966) and 0 < p < 0.1


def test_features_and_experiment(spark):
    names = [["read"] * k + ["test", "test"] + ["read"] * (9 - k) for k in range(10)]
    table = [(f"{t}{k}", t, k >= 5, names[k]) for t in ("t1", "t2", "t3", "t4", "t5", "t6") for k in range(10)]
    runs = runs_of(spark, table)
    got = features.run_features(runs).where("run_id = 't14'").first()
    assert got.test_position_centroid == pytest.approx(0.45)
    ranked = {r.feature: r for r in features.rank_features(runs).collect()}
    r = ranked["test_position_centroid"]
    assert r.delta_pp == pytest.approx(100 * (1 - 1 / 6)) and r.n_tasks == 6 and r.p_value == pytest.approx(2 / 64)


def test_groups_keep_three_outcomes_apart(spark):
    runs = runs_of(spark, [("a", "t", True, ["x"]), ("b", "t", None, ["x"]), ("c", "u", False, ["x"]), ("d", "u", True, ["x"])])
    assert {r.task_id: r.skip_reason for r in cohorts.task_groups(runs, 1).collect()} == {"t": "all_pass", "u": None}
    assert {r.task_id for r in cohorts.mixed_tasks(runs, 0, True).collect()} == {"t", "u"} and {r.task_id for r in cohorts.mixed_tasks(runs).collect()} == {"u"}


def test_gapped_pairs_match_enumeration(spark):
    r = random.Random(3)
    table = [(str(k), "t", r.random() < 0.5, [r.choice("abcde") for _ in range(r.randint(1, 9))]) for k in range(60)]
    got = {x.pattern: (x.n_with, x.n_pass) for x in motifs.find_gapped(runs_of(spark, table), 3, q=1.0).collect()}
    want = {}
    for _, _, ok, names in table:
        for p in set(itertools.combinations(names, 3)):
            n, k = want.get(p, (0, 0))
            want[p] = n + 1, k + ok
    assert got == {" → ... → ".join(p): v for p, v in want.items() if v[0] >= 3}


def test_causes_sum_to_one_and_favour_the_evidence(spark):
    shifts = spark.createDataFrame([("A", -0.5, -1.0), ("B", 0.2, 0.4), ("C", 0.1, 0.3)], "feature string, shift double, effect_size double")
    got = {r.cause_id: r.score for r in cohorts.score_causes(shifts, [{"id": "x", "expected_shifts": {"A": "decrease"}}, {"id": "y", "expected_shifts": {"A": "increase", "B": "increase"}}]).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["x"] > got["_unknown"] > got["y"]


def test_preferences_skip_noise_steps(spark):
    runs = runs_of(spark, [("p", "t", True, ["action", "read", "test", "edit"]), ("f", "t", False, ["read", "bash", "edit"])])
    pair = preferences.preference_pairs(runs, min_content=0).first()
    assert (pair.preferred, pair.dispreferred, pair.context) == ("test(pass)", "bash", "read")
    assert json.loads(preferences.as_dpo(preferences.preference_pairs(runs, min_content=0)).first().value)["chosen"] == "tool:test"


def test_load_runs(spark, tmp_path):
    run = {"run_id": "r1", "task_id": "t", "steps": [{"idx": 2, "type": "Assistant", "name": "b"}, {"idx": 1, "type": "tool", "attrs": {"command": "ls "}}], "result": {"success": None}}
    (tmp_path / "a.json").write_text(json.dumps(run))
    (tmp_path / "b.json").write_text(json.dumps(run | {"task_id": "other"}))
    (tmp_path / "c.json").write_text("{bad")
    (tmp_path / "d.json").write_text("[1]")
    (tmp_path / "e.json").write_text(json.dumps({"run_id": "x"}))
    runs, rejects = load_runs(spark, str(tmp_path))
    r = runs.first()
    assert runs.count() == 1 and r.task_id == "t" and r.success is None and [s.name for s in r.steps] == ["unnamed", "b"] and r.steps[1].type == "llm"
    assert {x.path.rsplit("/", 1)[1]: x.reason for x in rejects.collect()} == {"c.json": "not JSON", "d.json": "not an object", "e.json": "missing: task_id, steps, result"}


def test_streamed_runs(spark, tmp_path):
    from tracefold.streaming.ingest import closed_runs, event_stream

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    out = closed_runs(event_stream(spark, str(tmp_path / "in"), events.schema))
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert 0 < spark.table("closed").count() <= events.count()


def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def plain(v):
        return None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, int | float | np.number) and not isinstance(v, bool | np.bool_) else str(v)

    for name in ("enriched_steps", "task_groups", "run_features", "variant_shifts", "contiguous_motifs", "gapped_pairs", "rank_features", "divergence_points"):
        a, b = e.queries()[name](spark, SF).toPandas(), con.execute(e.oracle_sql()[name]).df()
        assert sorted(a.columns) == sorted(b.columns)
        key = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
        assert key(a) == key(b), name


def test_large_groups_are_clustered_whole(spark):
    table = [("t", f"r{k:03}", k % 3 == 0, list("abcd") if k % 2 else list("wxyz") + ["e"] * (k % 5)) for k in range(90)]
    runs = spark.createDataFrame(table, "task_id string, run_id string, success boolean, names array<string>")
    got = {r.run_id: r.cluster_id for r in align.clusters(runs, threshold=0.5).collect()}
    assert len(got) == 90 and len({got[f"r{k:03}"] for k in range(1, 90, 2)}) == 1 and got["r000"] != got["r001"]
    assert align.pairwise_distances(runs).count() == 90 * 89 // 2 and align.splits(runs).count() == 89
    assert align.aligned_cells(runs).select("run_id").distinct().count() == 90
    assert align.concordance(runs).first().n_runs == 90


def test_chi_squared_against_its_definition(spark):
    tables = [[(3, 1), (2, 4), (0, 5)], [(5, 5), (5, 5), (5, 5)], [(0, 0), (4, 2), (1, 3)], [(7, 0), (0, 0), (0, 0)], [(40, 1), (2, 50), (9, 9), (1, 1)]]

    def want(rows):
        rows = [r for r in rows if sum(r)]
        p, f = (sum(r[k] for r in rows) for k in (0, 1))
        chi = sum((r[k] - sum(r) * t / (p + f)) ** 2 / (sum(r) * t / (p + f)) for r in rows for k, t in ((0, p), (1, f)) if t)
        df = len(rows) - 1
        if df <= 0 or chi <= 0:
            return 1.0
        return 0.5 * math.erfc(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)) / math.sqrt(2))

    frame = spark.createDataFrame([(k, t) for k, t in enumerate(tables)], "k int, v array<struct<n_pass:long,n_fail:long>>")
    assert [r.p for r in frame.select("k", stats.chi2_table(F.col("v")).alias("p")).orderBy("k").collect()] == [pytest.approx(want(t), rel=1e-9) for t in tables]
    xs = [-6.0, -2.9, -0.1, 0.0, 0.5, 2.99, 3.0, 5.0, 9.0]
    assert [r.e for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.erfc(F.col("x")).alias("e")).collect()] == [pytest.approx(math.erfc(x), rel=1e-9) for x in xs]


def test_dpo_text(spark):
    step = lambda i, name, **k: (i, "tool", name, "ok", None, None, None, k.get("why"), k.get("action"), k.get("result"))
    shape = f"run_id string, task_id string, success boolean, steps array<struct<{', '.join(f.replace(' ', ':') for f in STEP.split(', '))}>>"
    good = [step(0, "read", why="look", result="r" * 600), step(1, "edit", why="w" * 60, action="sed", result="x" * 1200), step(2, "test")]
    bad = [step(0, "read"), step(1, "search", why="v" * 60), step(2, "bash")]
    runs = with_sequences(spark.createDataFrame([("p", "t", True, good), ("f", "t", False, bad), ("g", "t", False, bad[:2])], shape))
    got = [json.loads(r.value) for r in preferences.as_dpo(preferences.preference_pairs(runs)).collect()]
    assert len(got) == 1 and got[0]["prompt"] == "Task: t\n\nTrajectory so far:\n[Step 0: tool:read]\nThinking: look\nResult: " + "r" * 500 + "\n\nWhat should the agent do next?"
    assert got[0]["chosen"] == f"Thinking: {'w' * 60}\nAction: sed\nResult: {'x' * 1000}" and got[0]["rejected"] == "Thinking: " + "v" * 60
    assert got[0]["metadata"]["preferred_run_id"] == "p" and got[0]["metadata"]["p_value"] is None
    assert preferences.preference_pairs(runs, min_content=100).count() == 0


def test_filters(spark):
    runs = spark.createDataFrame([("a", "m1", {"fast": "true", "k": "1"}), ("b", "m2", {"fast": "false"}), ("c", None, None)], "run_id string, model string, tags map<string,string>")
    ids = lambda *texts: [r.run_id for r in cohorts.apply_filters(runs, list(texts)).orderBy("run_id").collect()]
    assert ids("fast=True") == ["a"] and ids("model=m1", "model=m2") == ["b"] and ids("model=") == ["a", "b", "c"] and ids("k=1", "fast=False") == [] and ids("none=x") == []
    assert cohorts.parse_filter("a=b=c") == ("a", "b=c")
    with pytest.raises(ValueError):
        cohorts.parse_filter("=x")
    assert {tuple(r) for r in cohorts.available_values(runs, ("model", "agent")).collect()} == {("model", "m1", 1), ("model", "m2", 1)}


def test_bootstrap_encloses_the_score(spark):
    r = random.Random(2)
    table = [(f"{v}{k}", "t", True, ["edit", "test"] if r.random() < share else ["edit", "read"]) for v, share in (("a", 0.9), ("b", 0.2)) for k in range(150)]
    runs = runs_of(spark, table).withColumn("variant", F.substring("run_id", 1, 1))
    causes = [{"id": "x", "expected_shifts": {"TEST_AFTER_EDIT_RATE": "decrease"}}, {"id": "y", "expected_shifts": {"STEP_FAILURE_RATE": "increase"}}]
    got = {x.cause_id: x for x in cohorts.bootstrap_confidence(runs, "variant", "a", "b", causes, rounds=60).collect()}
    assert all(x.ci_lower <= x.score <= x.ci_upper for x in got.values()) and got["x"].ci_lower > got["y"].ci_upper and got["x"].ci_upper - got["x"].ci_lower > 0.01
    assert all(x.ci_lower is None for x in cohorts.bootstrap_confidence(runs, "variant", "a", "b", causes, rounds=10).collect())


def test_logs_and_transcripts(spark):
    from tracefold.sources.tool_logs import compliance, trials_as_runs

    block = lambda kind, **x: json.dumps({"type": kind[0], "message": {"content": [{"type": kind[1], **x}]}})
    ai, user = "assistant", "user"
    transcript = "\n".join([
        block((ai, "text"), text="look"), block((ai, "tool_use"), name="Read", id="1", input={"file_path": "a.py"}), block((user, "tool_result"), tool_use_id="1", content="x = 1"),
        block((ai, "text"), text="said"), block((ai, "thinking"), thinking="thought"), block((ai, "tool_use"), name="Bash", id="2", input={}), "not json",
        block((ai, "tool_use"), name="Edit", id="3", input={}), block((user, "tool_result"), tool_use_id="3", content="never merged"),
    ])
    log = "start\n[tool] Read a.py\n  [tool] Bash: cd x && pytest -q\n[tool] Write test_b.py\n[tool] Custom Thing here\n[tool] TodoWrite\n[tool] Edit b.py\n[tool] Bash: go test\n[tool] Edit c.py\n[result] 9 turns"
    frame = spark.createDataFrame([("r", "django-12", True, log, transcript), ("s", "plain", None, None, None)], "run_id string, task_id string, success boolean, log string, transcript string")
    got = {r.run_id: r for r in trials_as_runs(frame).collect()}
    steps = got["r"].steps
    assert [(s.type, s.name) for s in steps] == [("tool", "read"), ("tool", "test"), ("tool", "write"), ("tool", "custom_thing_here"), ("system", "plan"), ("tool", "edit"), ("tool", "test"), ("tool", "edit"), ("system", "result")]
    assert (steps[0].file_path, steps[0].reasoning, steps[0].result) == ("a.py", "look", "x = 1") and steps[1].reasoning == "thought" and steps[2].result is None and steps[8].result == "9 turns"
    assert got["r"].task_family == "django" and got["s"].task_family == "plain" and got["s"].steps == []
    measured = {r.run_id: (r.source_edits, r.tested_edits, r.compliance_rate) for r in compliance(frame.withColumn("log", F.coalesce("log", F.lit("")))).collect()}
    assert measured == {"r": (2, 1, 0.5), "s": (0, 0, None)}


def test_concordance_leaves_out_groups_of_one_outcome(spark):
    rows = spark.createDataFrame([(g, f"r{i}", i % 2 == 0 if g == "mixed" else True, list("abc")[: i % 3 + 1]) for g in ("mixed", "passing") for i in range(6)], "task_id string, run_id string, success boolean, names array<string>")
    assert [(r.group_id, r.n_runs) for r in align.concordance(rows).collect()] == [("mixed", 6)]


def test_linkage_takes_the_first_of_the_closest_and_folds_copies():
    rng = np.random.default_rng(3)
    for few in (8, 40):
        table = ["".join(rng.choice(list("abc"), rng.integers(0, 6))) for _ in range(few)]
        sequences = [list(table[k]) for k in rng.integers(0, few, 60)]
        keys = list(dict.fromkeys(map(tuple, sequences)))
        which = np.array([keys.index(tuple(s)) for s in sequences])
        small = np.zeros((len(keys), len(keys)))
        for i in range(len(keys)):
            for j in range(i):
                small[i, j] = small[j, i] = by_path(keys[i], keys[j])
        d = small[np.ix_(which, which)].copy()
        np.fill_diagonal(d, np.inf)
        live, ids, sizes, want = list(range(60)), list(range(60)), [1] * 60, []
        for step in range(59):
            sub = d[np.ix_(live, live)]
            x, y = (live[k] for k in divmod(int(sub.argmin()), len(live)))
            want.append((*sorted((ids[x], ids[y])), d[x, y], sizes[x] + sizes[y]))
            d[x] = d[:, x] = (d[x] * sizes[x] + d[y] * sizes[y]) / (sizes[x] + sizes[y])
            d[x, x], sizes[x], ids[x] = np.inf, sizes[x] + sizes[y], 60 + step
            live.remove(y)
        assert align.linkage(small[np.ix_(which, which)]) == want and align.linked(which, small) == want


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 16)
    monkeypatch.setattr(align, "SMALL_BLOCK", 4)
    rng = np.random.default_rng(4)
    table = [(None if k < 9 else "t", f"r{(k * 37) % 101:03}", [True, False, None][k % 3], ["x"] * 3 if k % 3 == 0 else list("".join(rng.choice(list("abc"), rng.integers(0, 7))))) for k in range(101)]
    runs = spark.createDataFrame(table, "task_id string, run_id string, success boolean, names array<string>")
    got = {(r.group_id, r.run_a, r.run_b): r.distance for r in align.pairwise_distances(runs).collect()}
    want = {(a[0], a[1], b[1]): by_path(a[3], b[3]) for a in table for b in table if a[0] == b[0] and a[1] < b[1]}
    assert got == want
    cut_at = {(r.group_id, r.run_id): r.cluster_id for r in align.clusters(runs, threshold=0.5).collect()}
    heights = sorted((r.group_id or "", r.step, r.height, r.n_left, r.n_right, r.left_rate, r.right_rate) for r in align.splits(runs).collect())
    for group in (None, "t"):
        mine = sorted((r for r in table if r[0] == group), key=lambda r: r[1])
        keys = list(dict.fromkeys(tuple(r[3]) for r in mine))
        d = np.array([[by_path(keys[max(i, j)], keys[min(i, j)]) for j in range(len(keys))] for i in range(len(keys))])
        merges = align.linked(np.array([keys.index(tuple(r[3])) for r in mine]), d)
        assert [cut_at[group, r[1]] for r in mine] == align.cut(merges, len(mine), 0.5)
        members, rows = {k: [k] for k in range(len(mine))}, []
        for step, (a, b, height, _) in enumerate(merges):
            said = [[mine[k][2] for k in members[x] if mine[k][2] is not None] for x in (a, b)]
            rows.append((group or "", step, height, len(members[a]), len(members[b]), *(sum(s) / len(s) if s else None for s in said)))
            members[len(mine) + step] = members[a] + members[b]
        assert rows == [r for r in heights if r[0] == (group or "")]


def test_fisher_keeps_its_digits_on_large_tables(spark):
    tables = [(577, 349, 1252834, 720428), (119_611, 80_212, 1_133_900, 640_465), (40, 60, 20_000, 29_000), (3, 1, 1, 3), (0, 5, 5, 0)]
    got = [r.p for r in spark.createDataFrame(tables, "a long, b long, c long, d long").select(stats.fisher_exact(*map(F.col, "abcd")).alias("p")).collect()]
    for (a, b, c, d), p in zip(tables, got, strict=True):
        row, col, n, f = a + b, a + c, a + b + c + d, lambda x: math.lgamma(x + 1)
        one = lambda x: math.exp(math.fsum((f(col), -f(x), -f(col - x), f(n - col), -f(row - x), -f(n - col - row + x), -f(n), f(row), f(n - row))))  # noqa: E731, B023
        want = min(1.0, math.fsum(v for v in map(one, range(max(0, row + col - n), min(row, col) + 1)) if v <= one(a) + 1e-10))
        assert p == pytest.approx(want, rel=1e-8), (a, b, c, d)
        assert round(p, 6) == round(want, 6)


def test_pairs_are_made_once_for_their_topics(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([(f"{k % 3} then", "edit", "test") for k in range(40)], "context string, preferred string, dispreferred string")
    got = preferences.cluster_pairs(rows.withColumn("context", said("context")))
    assert got.count() <= 40 and made.value == 40
