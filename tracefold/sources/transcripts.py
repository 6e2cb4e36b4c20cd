"""Runs from chat transcripts with tool calls.

A transcript is an array of messages (role, content, tool_calls: array of id, name, arguments as JSON, and
tool_call_id of results). Each tool call becomes a step; its result is found by id, its reasoning is the
content it came with. Everything is a narrow expression over one row a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"
#: What an editor tool's sub-commands count as; sources differ in 'insert'.
EDITOR = {"view": "read", "create": "write", "str_replace": "edit", "undo_edit": "edit"}
TOOLS = {"execute_bash": "bash", "bash": "bash", "think": "reason", "finish": "finish", "submit": "finish", "web_search": "search"}
FAILED = r"(?i)traceback \(most recent call last\)|\berror:|command not found|no such file"
KEEP_CHARS = 2000


def step_name(tool: Column, sub: Column, insert_is: str = "edit") -> Column:
    table = lambda d: F.create_map(*(F.lit(x) for p in d.items() for x in p))
    editor = F.element_at(table(EDITOR | {"insert": insert_is}), sub)
    return F.when(tool.contains("edit"), F.coalesce(editor, F.lit("edit"))).otherwise(F.coalesce(F.element_at(table(TOOLS), tool), tool))


def result_status(result: Column) -> Column:
    """By exit code where the result tells one, else by words of failure; 'ok' without a result."""
    code = F.regexp_extract(result, r"exit code:? (-?\d+)", 1)
    return F.when(result.isNull(), "ok").when(code != "", F.when(code == "0", "ok").otherwise("error")).when(result.rlike(FAILED), "error").otherwise("ok")


def transcripts_as_runs(rows: DataFrame, insert_is: str = "edit") -> DataFrame:
    """``rows``: run_id, task_id, success, messages."""
    calls = F.flatten(F.transform("messages", lambda m: F.transform(
        F.coalesce(m["tool_calls"], F.expr("CAST(array() AS array<struct<id:string,name:string,arguments:string>>)")), lambda c: F.struct(c.alias("c"), m["content"].alias("why")))))
    results = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(F.filter("messages", lambda m: m["tool_call_id"].isNotNull()), lambda m: m["tool_call_id"])),
        lambda i: F.struct(i.alias("k"), F.get(F.filter("messages", lambda m: m["tool_call_id"] == i), F.lit(0))["content"].alias("v"))))
    found = rows.withColumn("__r", results)

    def step(x: Column, i: Column) -> Column:
        said, result = x["c"]["arguments"], F.element_at("__r", x["c"]["id"])
        sub, path = F.get_json_object(said, "$.command"), F.coalesce(F.get_json_object(said, "$.path"), F.get_json_object(said, "$.file_path"))
        name = step_name(x["c"]["name"], sub, insert_is)
        return F.struct(
            i.cast("int").alias("pos"), F.when(name == "reason", "llm").otherwise("tool").alias("type"), name.alias("name"), result_status(result).alias("status"), path.alias("file_path"),
            F.get_json_object(said, "$.pattern").alias("pattern"), F.when(name == "bash", sub).alias("command"), F.when(F.trim(x["why"]) != "", F.substring(x["why"], 1, KEEP_CHARS)).alias("reasoning"),
            said.alias("action"), F.substring(result, 1, KEEP_CHARS).alias("result"))

    return found.select("run_id", "task_id", "success", F.transform(calls, step).alias("steps"))


def mixed_outcomes(rows: DataFrame, least: int = 1) -> DataFrame:
    """Transcripts of tasks that have at least ``least`` passing and failing ones: a first pass over outcomes only."""
    tasks = rows.groupBy("task_id").agg(F.count_if(F.col("success")).alias("p"), F.count_if(~F.col("success")).alias("f")).where(f"p >= {least} AND f >= {least}")
    return rows.join(tasks.select("task_id"), "task_id", "left_semi")
