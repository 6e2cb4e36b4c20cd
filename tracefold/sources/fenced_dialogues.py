"""Runs from dialogues in which each reply of the model holds a command in a fenced block and the next message what came of it.

A row has messages (role 'ai', 'user' or 'system', and text). A step is one 'ai' message; all is narrow work within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,text:string>>"
#: What a command's first word makes of a step (type, name), the two that name a file, and the parts of a command that
#: make it a test unless its first word is an editor's.
EDITOR_WORDS = {
    "open": ("tool", "read"), "goto": ("tool", "read"), "scroll_down": ("tool", "read"), "scroll_up": ("tool", "read"),
    "edit": ("tool", "edit"), "create": ("tool", "write"), "submit": ("system", "submit"),
    "search_dir": ("tool", "search"), "search_file": ("tool", "search"), "find_file": ("tool", "search"),
}
TESTS = ("pytest", "python -m test", "npm test", "cargo test", "go test", "make test", "unittest", "python test", "python reproduce", "python run_test")
SHELL_WORDS = {w: ("tool", n) for n, words in {"search": "find ls grep rg cat head tail wc", "bash": "cd", "edit": "sed awk patch", "write": "touch mkdir cp mv"}.items() for w in words.split()}
WITH_FILE = ("open", "create")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def command_of(text: Column) -> Column:
    """The last fenced block without its language's line; null where there is none or it is blank."""
    block = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w*\n)?(.*?)```"), F.lit(1)), F.lit(-1))
    return F.nullif(_strip(block), F.lit(""))


def reasoning_of(text: Column) -> Column:
    """What stands before the last fence, or the whole text without one; null where that is blank."""
    before = F.regexp_extract(text, r"(?s)^(.+)```", 1)
    return F.nullif(_strip(F.when(before != "", before).otherwise(text)), F.lit(""))


def _kind(command: Column, part: str) -> Column:
    at = ("type", "name").index(part)
    table = lambda words: F.create_map(*(F.lit(x) for w, kind in words.items() for x in (w, kind[at])))
    low = F.lower(command)
    first = F.element_at(F.split(low, r"\s+"), 1)
    tested = low.rlike("|".join(t.replace(" ", r"\x20") for t in TESTS))
    usual = F.lit(("tool", "bash")[at])
    return F.when(command.isNull(), ("tool", "action")[at]).otherwise(F.coalesce(
        F.element_at(table(EDITOR_WORDS), first), F.when(tested, F.lit(("tool", "test")[at])), F.element_at(table(SHELL_WORDS), first), usual))


def dialogue_steps(messages: Column) -> Column:
    """The canonical steps; a message's result is the text of the user's message right after it."""
    empty = F.expr(f"CAST(array() AS {MESSAGES})")
    all_ = F.coalesce(messages, empty)
    paired = F.transform(all_, lambda m, i: F.struct(m.alias("m"), F.get(all_, i + 1).alias("after")))
    replies = F.filter(paired, lambda p: F.coalesce(p["m"]["role"] == "ai", F.lit(False)))
    read = F.transform(replies, lambda p: F.struct(
        command_of(F.coalesce(p["m"]["text"], F.lit(""))).alias("command"), reasoning_of(F.coalesce(p["m"]["text"], F.lit(""))).alias("reasoning"),
        F.when(p["after"]["role"] == "user", F.nullif(p["after"]["text"], F.lit(""))).alias("result")))

    def step(x: Column, i: Column) -> Column:
        words = F.split(x["command"], r"\s+")
        none = F.lit(None).cast("string")
        return F.struct(
            i.cast("int").alias("pos"), _kind(x["command"], "type").alias("type"), _kind(x["command"], "name").alias("name"), F.lit("ok").alias("status"),
            F.when(F.lower(F.get(words, F.lit(0))).isin(*WITH_FILE), F.get(words, F.lit(1))).alias("file_path"), none.alias("pattern"), none.alias("command"),
            x["reasoning"].alias("reasoning"), x["command"].alias("action"), x["result"].alias("result"))

    return F.transform(read, step)


def task_family(task_id: Column) -> Column:
    """'owner__name' of 'owner__name-123'; the whole id where it has no such form."""
    parts = F.split(task_id, "__")
    name = F.regexp_replace(F.get(parts, F.lit(1)), r"(?s)-[^-]*$", "")
    return F.when(F.size(parts) >= 2, F.concat(F.get(parts, F.lit(0)), F.lit("__"), name)).otherwise(task_id)


def dialogues_as_runs(rows: DataFrame) -> DataFrame:
    """``rows``: run_id, task_id, success, messages. Rows without a reply are no runs."""
    steps = rows.select("run_id", "task_id", task_family(F.col("task_id")).alias("task_family"), "success", dialogue_steps(F.col("messages")).alias("steps"))
    return steps.where(F.size("steps") > 0)
