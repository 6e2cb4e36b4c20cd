from tracefold.functions.labels import with_sequences
from tracefold.sources.transcripts import MESSAGE, mixed_outcomes, transcripts_as_runs


def test_calls_meet_their_results(spark):
    call = lambda i, name, args: (i, name, args)
    messages = [
        ("user", "fix it", None, None),
        ("assistant", "I look first", [call("1", "str_replace_editor", '{"command": "view", "path": "a.py"}')], None),
        ("tool", "text", None, "1"),
        ("assistant", " ", [call("2", "execute_bash", '{"command": "pytest -q"}'), call("3", "str_replace_editor", '{"command": "insert", "path": "a.py"}')], None),
        ("tool", "failed, exit code 1", None, "2"),
        ("assistant", None, [call("4", "finish", "{}")], None),
    ]
    kind = "array<struct<" + ",".join(p.replace(" ", ":", 1) for p in MESSAGE.split(", ")) + ">>"
    rows = spark.createDataFrame([("r", "t", True, messages), ("s", "t", False, []), ("u", "v", True, [])], f"run_id string, task_id string, success boolean, messages {kind}")
    got = {r.run_id: r for r in with_sequences(transcripts_as_runs(rows)).collect()}
    assert got["r"].names == ["read(source)", "test(fail)", "edit(source)", "finish"] and [s.reasoning for s in got["r"].steps] == ["I look first", None, None, None]
    assert got["s"].names == [] and {r.run_id for r in mixed_outcomes(rows).collect()} == {"r", "s"}
    assert with_sequences(transcripts_as_runs(rows, "write")).where("run_id = 'r'").first().names[2] == "write(source)"
