from tracefold.sources.fenced_dialogues import MESSAGES, dialogues_as_runs


def test_replies_and_what_came_of_them(spark):
    said = [
        ("system", "be brief"), ("user", "the issue"),
        ("ai", "I look\n```\nopen src/a.py 10\n```"), ("user", "text"),
        ("ai", "first ```ls``` then\n```bash\nPYTHON reproduce.py\n```\n"), ("user", ""),
        ("ai", "no command here"), ("ai", "```\nsed -i s/a/b/ x\n```"), ("user", "done"), ("user", "an orphan"),
        ("ai", "```\ncreate pytest_new.py\n```"), ("ai", "```\n \n```"), ("ai", None), ("ai", "end ```submit```"),
    ]
    rows = spark.createDataFrame(
        [("r", "owner__name-with-dash-12", True, said), ("s", "plain", None, [("user", "x")]), ("n", "plain", None, None)], f"run_id string, task_id string, success boolean, messages {MESSAGES}")
    (got,) = dialogues_as_runs(rows).collect()
    assert (got.run_id, got.task_family, got.success) == ("r", "owner__name-with-dash", True)
    assert [(s.pos, s.type, s.name, s.file_path, s.action, s.result) for s in got.steps] == [
        (0, "tool", "read", "src/a.py", "open src/a.py 10", "text"), (1, "tool", "test", None, "PYTHON reproduce.py", None), (2, "tool", "action", None, None, None),
        (3, "tool", "edit", None, "sed -i s/a/b/ x", "done"), (4, "tool", "write", "pytest_new.py", "create pytest_new.py", None), (5, "tool", "action", None, None, None),
        (6, "tool", "action", None, None, None), (7, "system", "submit", None, "submit", None),
    ]
    assert [s.reasoning for s in got.steps[:3]] == ["I look\n```\nopen src/a.py 10", "first ```ls``` then\n```bash\nPYTHON reproduce.py", "no command here"]
