"""Runs from logs of tool calls, with what a transcript of the same run adds.

A log has a line a call, ``[tool] Read path``, and one for its end, ``[result] ...``; other lines don't count. A
transcript has a JSON object a line, whose message holds blocks of text, thinking, tool use and tool result. Both are read
within their row: a log of any length is one array expression, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a line of the log begins, the step's type and name, and the field that takes the rest.
LINES = (
    ("Read ", "tool", "read", "file_path"),
    ("Edit ", "tool", "edit", "file_path"),
    ("Write ", "tool", "write", "file_path"),
    ("Glob:", "tool", "search", "pattern"),
    ("Grep:", "tool", "search", "pattern"),
    ("Bash:", "tool", "bash", "command"),
    ("TodoWrite", "system", "plan", None),
    ("Agent", "llm", "subagent", None),
)
#: What makes a command a test (the longer ones hold the shorter), lengths kept, and the calls a transcript names.
TESTS = "test"
KEEP_COMMAND, KEEP_NAME = 200, 50
CALLS = {"Read": "read", "Edit": "edit", "Write": "write", "Glob": "search", "Grep": "search", "Bash": "bash", "TodoWrite": "plan", "Agent": "subagent", "Task": "subagent"}
FIELDS = ("file_path", "pattern", "command", "reasoning", "action", "result")


def tool_lines(log: Column) -> Column:
    """ARRAY<STRUCT<tool, text>> of the lines that count."""
    lines = F.transform(F.split(log, r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: x.startswith("[tool] ") | x.startswith("[result] "))
    return F.transform(kept, lambda x: F.struct(x.startswith("[tool] ").alias("tool"), F.regexp_replace(x, r"^\[\w+\] ", "").alias("text")))


def _step(line: Column, at: Column) -> Column:
    text = line["text"]
    other = F.regexp_replace(F.lower(F.substring(text, 1, KEEP_NAME)), " ", "_")
    kind, name, found = F.when(~line["tool"], "system"), F.when(~line["tool"], "result"), {f: F.when(F.lit(False), "") for f in FIELDS}
    found["result"] = F.when(~line["tool"], text)
    for prefix, type_, called, field in LINES:
        hit = line["tool"] & text.startswith(prefix)
        rest = F.trim(F.substring(text, len(prefix) + 1, 1 << 30))
        kind = kind.when(hit, type_)
        name = name.when(hit & F.lit(field == "command") & F.lower(rest).contains(TESTS), "test").when(hit, called)
        if field:
            found[field] = found[field].when(hit, F.substring(rest, 1, KEEP_COMMAND) if field == "command" else rest)
    return F.struct(at.cast("int").alias("pos"), kind.otherwise("tool").alias("type"), name.otherwise(other).alias("name"), F.lit("ok").alias("status"), *(found[f].alias(f) for f in FIELDS))


def log_steps(log: Column) -> Column:
    """The canonical steps of a log."""
    return F.transform(tool_lines(log), _step)


def transcript_calls(transcript: Column) -> Column:
    """ARRAY<STRUCT<name, reasoning, action, result>>: each call of a transcript with the reasoning since the call before (thinking, else
    text) and the result that bears its id."""
    docs = F.filter(F.transform(F.split(transcript, r"\r?\n"), F.try_parse_json), lambda d: d.isNotNull())
    blocks = F.flatten(F.transform(docs, lambda d: F.coalesce(F.try_variant_get(d, "$.message.content", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))))
    get = lambda b, c: F.try_variant_get(b, f"$.{c}", "string")
    flat = F.transform(blocks, lambda b: F.struct(get(b, "type").alias("kind"), get(b, "name").alias("name"), F.coalesce(get(b, "id"), get(b, "tool_use_id")).alias("id"), get(b, "text").alias("text"), get(b, "thinking").alias("thinking"), get(b, "input").alias("input"), get(b, "content").alias("content")))
    none = "CAST(array() AS array<struct<name:string,id:string,reasoning:string,action:string>>)"
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("thinking"), F.expr(none).alias("calls"))

    def walk(s: Column, b: Column) -> Column:
        call = b["kind"] == "tool_use"
        why = F.when(s["thinking"] != "", s["thinking"]).when(s["text"] != "", s["text"])
        one = F.array(F.struct(b["name"].alias("name"), b["id"].alias("id"), why.alias("reasoning"), b["input"].alias("action")))
        return F.struct(
            F.when(call, "").when(b["kind"] == "text", F.coalesce(b["text"], s["text"])).otherwise(s["text"]).alias("text"),
            F.when(call, "").when(b["kind"] == "thinking", F.coalesce(b["thinking"], s["thinking"])).otherwise(s["thinking"]).alias("thinking"),
            F.when(call, F.concat(s["calls"], one)).otherwise(s["calls"]).alias("calls"),
        )

    calls = F.aggregate(flat, start, walk, lambda s: s["calls"])
    answers = F.filter(flat, lambda b: b["kind"] == "tool_result")
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["reasoning"].alias("reasoning"), c["action"].alias("action"), F.get(F.filter(answers, lambda a: a["id"] == c["id"]), F.lit(0))["content"].alias("result")))


def with_transcript(steps: Column, calls: Column) -> Column:
    """Steps with reasoning, action and result of the calls in the same order, up to the first pair of different names; steps
    that aren't calls are passed over."""
    named = F.create_map(*(F.lit(x) for p in CALLS.items() for x in p))
    is_call = lambda s: s["name"] != "result"
    places = F.transform(steps, lambda s, i: F.size(F.filter(F.slice(steps, 1, i + 1), is_call)) - 1)
    called = lambda s: F.when(s["name"] == "test", "bash").otherwise(s["name"])
    own = F.filter(steps, is_call)
    same = F.zip_with(F.transform(own, called), F.transform(calls, lambda c: F.element_at(named, c["name"])), lambda a, b: F.coalesce(a == b, F.lit(False)))
    good = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")

    def merged(s: Column, k: Column) -> Column:
        call = F.when(is_call(s) & (k < good), F.get(calls, k))
        return F.struct(*(s[c].alias(c) for c in ("pos", "type", "name", "status", "file_path", "pattern", "command")), *(F.coalesce(call[c], s[c]).alias(c) for c in ("reasoning", "action", "result")))

    return F.zip_with(steps, places, merged)


def trials_as_runs(trials: DataFrame) -> DataFrame:
    """``trials``: run_id, task_id, success, log, and transcript where there is one. The task's family is what stands before
    the last run of digits of its id."""
    steps = log_steps(F.coalesce("log", F.lit("")))
    rows = trials.withColumn("__s", steps)
    if "transcript" in trials.columns:
        rows = rows.withColumn("__c", transcript_calls(F.coalesce("transcript", F.lit("")))).withColumn("__s", with_transcript(F.col("__s"), F.col("__c")))
    family = F.regexp_extract("task_id", r"^(.*?)[-_:]?\d+$", 1)
    return rows.select("run_id", "task_id", F.when(family != "", family).otherwise(F.col("task_id")).alias("task_family"), "success", F.col("__s").alias("steps"))


def compliance(logs: DataFrame) -> DataFrame:
    """``logs`` (run_id, log, ...) with the edits of files that aren't tests, how many of them the next call tests, and the share
    (null without edits)."""
    calls = F.transform(F.filter(tool_lines(F.col("log")), lambda x: x["tool"]), lambda x: x["text"])
    rows = logs.withColumn("__t", calls)
    edit = lambda x: x.rlike("^(?:Edit|Write) ") & ~F.lower(F.regexp_replace(x, "^[^ ]+ ", "")).contains("test")
    tested = lambda x: F.coalesce(x.startswith("Bash:") & F.lower(x).contains(TESTS), F.lit(False))
    follows = F.filter(F.transform("__t", lambda x, i: F.when(edit(x), tested(F.get("__t", i + 1)))), lambda f: f.isNotNull())
    rows = rows.withColumn("__f", follows)
    met = F.size(F.filter("__f", lambda f: f))
    return rows.select(*logs.columns, F.size("__f").cast("long").alias("source_edits"), met.cast("long").alias("tested_edits"), F.try_divide(met.cast("double"), F.size("__f").cast("double")).alias("compliance_rate"))


def compliance_outcomes(measured: DataFrame, least: float = 0.5) -> DataFrame:
    """Runs by whether ``least`` of their edits are tested and by outcome: one row of four counts."""
    known = measured.where("compliance_rate IS NOT NULL AND success IS NOT NULL")
    high = F.col("compliance_rate") >= least
    return known.agg(*(F.count_if((high == h) & (F.col("success") == s)).alias(f"{a}_{b}") for a, h in (("high", True), ("low", False)) for b, s in (("pass", True), ("fail", False))))
