"""Runs from JSON files and from event tables.

The canonical form is one row a run: run_id, task_id, success (three-valued) and ``steps``, an array of
structs in order (pos, type, name, status, file_path, pattern, command, reasoning, action, result). A run's steps stay in
one row, so every per-run operator is a narrow expression and only grouping by task shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "pos int, type string, name string, status string, file_path string, pattern string, command string, reasoning string, action string, result string"
#: Known step types and their aliases.
KNOWN_TYPES = ("llm", "tool", "system", "memory", "compaction", "judge", "error", "handoff")
TYPE_ALIASES = {"assistant": "llm", "completion": "llm", "function_call": "tool", "retrieval": "tool", "compress": "compaction", "critic": "judge"}


def events_as_runs(events: DataFrame, grain: str = "day") -> DataFrame:
    """Runs derived from an event table: one run for each user and day, or each user (grain 'user')."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.element_at(F.create_map(*(F.lit(x) for p in {"view": "read", "click": "search", "signup": "edit", "purchase": "test", "error": "bash"}.items() for x in p)), F.col("event_type"))
    file = F.when(k % 4 == 0, F.concat(F.lit("mod_"), k.cast("string"), F.lit(".py"))).when(k % 4 == 1, F.concat(F.lit("test_"), k.cast("string"), F.lit(".py"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".md"))).otherwise(F.lit("cfg.json"))
    command = F.element_at(F.array(*map(F.lit, ("grep -r x .", "python run.py", "cat notes.txt", "pytest -q", "cd /srv && git status"))), (k % 5) + 1)
    day = F.date_format("ts", "yyyy-MM-dd")
    run = F.concat_ws(":", F.col("user_id").cast("string"), day) if grain == "day" else F.col("user_id").cast("string")
    task = F.col("user_id") if grain == "day" else F.col("user_id") % 10
    rows = events.select(
        run.alias("run_id"), task.cast("string").alias("task_id"), "ts", "event_id", "value",
        name.alias("name"), F.when(F.col("value") >= 100, "error").otherwise("ok").alias("status"),
        F.when(name.isin("read", "edit"), file).alias("file_path"),
        F.when(name == "search", F.when(k % 2 == 0, "*.py").otherwise("needle")).alias("pattern"),
        F.when(name == "bash", command).alias("command"),
    )
    ordered = rows.groupBy("run_id", "task_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "name", "status", "file_path", "pattern", "command", "value"))).alias("e"))
    last = F.element_at("e", -1)["value"]
    steps = F.transform("e", lambda e, i: F.struct(
        i.cast("int").alias("pos"), F.lit("tool").alias("type"), e["name"].alias("name"), e["status"].alias("status"),
        e["file_path"].alias("file_path"), e["pattern"].alias("pattern"), e["command"].alias("command"),
        *(F.lit(None).cast("string").alias(c) for c in ("reasoning", "action", "result")),
    ))
    return ordered.select("run_id", "task_id", F.when(last >= 10, last < 60).alias("success"), steps.alias("steps"))


def conversations_as_runs(conversations: DataFrame) -> DataFrame:
    """One run for each conversation: roles become step types, texts reasoning; no outcome is known."""
    kind = normal_type(F.when(F.col("role") == "user", "other").otherwise(F.col("role")))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), kind.alias("type"), F.col("role"), F.col("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    steps = F.transform("t", lambda t, i: F.struct(
        i.cast("int").alias("pos"), t["type"].alias("type"), t["role"].alias("name"), F.lit("ok").alias("status"),
        *(F.lit(None).cast("string").alias(c) for c in ("file_path", "pattern", "command")), F.when(t["role"] == "assistant", t["text"]).alias("reasoning"),
        *(F.lit(None).cast("string").alias(c) for c in ("action", "result")),
    ))
    return grouped.select(F.col("conv_id").cast("string").alias("run_id"), F.lit("all").alias("task_id"), F.lit(None).cast("boolean").alias("success"), steps.alias("steps"))


def normal_type(kind):
    """A step type, lower-cased and trimmed, through the aliases; unknown ones are 'other'."""
    low = F.lower(F.trim(kind))
    alias = F.element_at(F.create_map(*(F.lit(x) for p in TYPE_ALIASES.items() for x in p)), low)
    known = F.coalesce(alias, low)
    return F.when(known.isin(*KNOWN_TYPES), known).otherwise("other")


def load_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, rejects) from JSON files, one object each: rejects hold path and reason; of equal run_ids the
    first in path order stays."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.try_parse_json(F.col("value")).alias("doc")
    )
    get = lambda p, t="string": F.try_variant_get("doc", p, t)
    shape = F.when(F.col("doc").isNull(), "not JSON").when(~F.schema_of_variant("doc").startswith("OBJECT"), "not an object")
    lacks = F.array_compact(F.array(*(F.when(get(f"$.{k}", "variant").isNull(), k) for k in ("run_id", "task_id", "steps", "result"))))
    reason = F.coalesce(shape, F.when(F.size(lacks) > 0, F.concat(F.lit("missing: "), F.array_join(lacks, ", "))))
    judged = raw.withColumn("reason", reason)
    good = judged.where("reason IS NULL")
    step = lambda v, p: F.try_variant_get(v, p, "string")
    steps = F.transform(F.coalesce(get("$.steps", "array<variant>"), F.expr("CAST(array() AS array<variant>)")), lambda v, i: F.struct(
        F.coalesce(F.try_variant_get(v, "$.idx", "int"), i).cast("int").alias("idx"), i.cast("int").alias("at"),
        normal_type(F.coalesce(step(v, "$.type"), F.lit("other"))).alias("type"), F.coalesce(step(v, "$.name"), F.lit("unnamed")).alias("name"),
        F.coalesce(step(v, "$.status"), F.lit("ok")).alias("status"), *(step(v, f"$.attrs.{c}").alias(c) for c in ("file_path", "pattern", "command")),
        step(v, "$.output.reasoning").alias("reasoning"), step(v, "$.output.action").alias("action"),
        F.coalesce(F.nullif(step(v, "$.output.result"), F.lit("")), step(v, "$.output.observation")).alias("result"),
    ))
    ordered = F.transform(F.array_sort(steps), lambda s, i: F.struct(i.cast("int").alias("pos"), *(s[c].alias(c) for c in ("type", "name", "status", "file_path", "pattern", "command", "reasoning", "action", "result"))))
    runs = good.select(
        get("$.run_id").alias("run_id"), get("$.task_id").alias("task_id"), *(get(f"$.{c}").alias(c) for c in ("task_family", "agent", "model", "harness", "timestamp")),
        get("$.tags", "map<string,string>").alias("tags"),
        get("$.result.success", "boolean").alias("success"), get("$.result.score", "double").alias("score"), get("$.result.error_type").alias("error_type"),
        ordered.alias("steps"), F.split("path", "/").alias("order"),
    )
    first = first_by(runs, ["run_id"], "order").drop("order")
    return first, judged.where("reason IS NOT NULL").select("path", "reason")


def first_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    columns = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__r"))
    return picked.select(*(F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in rows.columns))


def read_events(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    return events_as_runs(spark.read.parquet(f"{sf_dir}/events.parquet"), grain)
