"""Mixing sources to target weights (operator 8): min-cost flow, then seeded selection.

Documents with the same set of sources form one membership pattern; only patterns and sources, never
documents, enter the flow network. A pattern offers its words once at cost 0, a second time at cost 1,
a third at cost 2 (convex, so repeats come last); each source takes words up to its target. The flow
says how many words of a pattern the mix takes. They are found among its documents in the order of a
seeded hash, laid end to end as often as repetition allows: a document's k-th copy is taken if its
middle lies before that number. Running sums are needed only inside the one hash bucket in which the number falls.

Defined cases: a null source is a source of its own, last in order; a null text has size 0 and is never
taken; a source without words has target 0; repeated rows count as documents each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import materialise, n_words

#: Hash buckets; the running sum inside one of them covers that fraction of a pattern's documents.
BUCKETS = 4096
MAX_COPIES = 3
#: Broadcast the pattern table only up to so many patterns; beyond, Spark joins it by key.
SMALL_PATTERNS = 20_000
_OWN = ("size", "source_size", "target", "taken", "pattern", "place", "bucket", "full", "rest", "last", "before", "at")
WEIGHTS = (5.0, 2.0, 1.0)


def target_sizes(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> dict[str | None, float]:
    """Share all words by weight; a share above ``cap`` times its source stops there and the rest is shared anew."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(patterns: dict[str, tuple[tuple, int]], targets: dict, copies: int = MAX_COPIES) -> dict[tuple[str, object], int]:
    """Words that flow from each pattern to each source. ``patterns``: key -> (sources, words).

    Successive shortest paths with potentials; each augmentation fills an arc, so their number depends
    on patterns and sources alone.
    """
    keys, sources = list(patterns), list(targets)
    start, end = 0, 1 + len(keys) + len(sources)
    arcs: list[list[_Arc]] = [[] for _ in range(end + 1)]

    def connect(a: int, b: int, room: int, cost: int) -> None:
        arcs[a].append(_Arc(b, room, cost, len(arcs[b])))
        arcs[b].append(_Arc(a, 0, -cost, len(arcs[a]) - 1))

    node = {s: 1 + len(keys) + k for k, s in enumerate(sources)}
    for k, key in enumerate(keys):
        members, words = patterns[key]
        for copy in range(copies):
            connect(start, 1 + k, words, copy)
        for s in members:
            connect(1 + k, node[s], words * copies, 0)
    for s in sources:
        connect(node[s], end, round(targets[s]), 0)
    height = [0] * (end + 1)
    while True:
        cost: list[float] = [float("inf")] * (end + 1)
        came: list[tuple[int, int] | None] = [None] * (end + 1)
        cost[start], queue = 0, [(0, start)]
        while queue:
            c, a = heapq.heappop(queue)
            if c > cost[a]:
                continue
            for k, arc in enumerate(arcs[a]):
                if arc.room > 0 and c + arc.cost + height[a] - height[arc.to] < cost[arc.to]:
                    cost[arc.to] = c + arc.cost + height[a] - height[arc.to]
                    came[arc.to] = (a, k)
                    heapq.heappush(queue, (cost[arc.to], arc.to))
        if came[end] is None:
            break
        for a in range(end + 1):
            if cost[a] < float("inf"):
                height[a] += cost[a]
        push, at = None, end
        while at != start:
            a, k = came[at]
            push = arcs[a][k].room if push is None else min(push, arcs[a][k].room)
            at = a
        at = end
        while at != start:
            a, k = came[at]
            arcs[a][k].room -= push
            arcs[at][arcs[a][k].back].room += push
            at = a
    return {(key, sources[arc.to - 1 - len(keys)]): arcs[arc.to][arc.back].room for k, key in enumerate(keys) for arc in arcs[1 + k] if arc.to != start and arc.to > len(keys) and arcs[arc.to][arc.back].room}


def mix_sources(docs: DataFrame, seed: int = 7, members=None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """Per document: doc_id, size, the pattern's size, its target and the words taken; and the flow.

    ``members``: ARRAY column of a document's sources; by default the one in ``source``. For a pattern of
    several sources, source_size and target are the sums over them. ``keep``: columns to carry along.
    """
    spark = docs.sparkSession
    members = F.array(F.col("source")) if members is None else members
    extra = [c for c in keep if c not in ("doc_id", *_OWN)]

    def keyed(*columns: str) -> DataFrame:
        return docs.select(
            *columns,
            F.to_json(F.struct(F.array_sort(F.array_distinct(members)).alias("m")), {"ignoreNullFields": "false"}).alias("pattern"),
            n_words(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("place"),
        ).withColumn("bucket", F.pmod(F.col("place"), F.lit(BUCKETS)).cast("int"))

    sized = materialise(keyed("doc_id"), "sized")
    by_bucket = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    found = by_bucket.groupBy("pattern").agg(F.sum("words").alias("words")).collect()  # one row per pattern
    patterns = {r.pattern: (tuple(json.loads(r.pattern)["m"]), r.words) for r in found}
    sizes: dict = {}
    for members_, words in patterns.values():
        for s in members_:
            sizes[s] = sizes.get(s, 0) + words
    # a document of several sources counts once in what is shared
    total, all_sizes = sum(w for _, w in patterns.values()), sum(sizes.values())
    targets = target_sizes(sizes)
    if all_sizes > total:
        targets = {s: t * total / all_sizes for s, t in targets.items()}
    flow = min_cost_flow(patterns, targets)
    rows = []
    for key, (members_, words) in patterns.items():
        taken = sum(flow.get((key, s), 0) for s in members_)
        full, rest = divmod(taken, words) if words else (0, 0)
        rows.append((key, int(full), int(rest), int(sum(sizes[s] for s in members_)), float(sum(targets[s] for s in members_))))
    plan = spark.createDataFrame(rows, "pattern string, full long, rest long, source_size long, target double")
    side = F.broadcast if len(rows) <= SMALL_PATTERNS else (lambda x: x)
    # the bucket in which a pattern's rest ends, and the words before it
    order = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        by_bucket.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        .join(side(plan), "pattern")
        .where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
        .select("pattern", F.col("bucket").alias("last"), "before")
    )
    cut = materialise(plan.join(ends, "pattern", "left"), "cuts")
    # columns to carry along come from the documents themselves, so that no text is written in between
    rows_in = (keyed("doc_id", *extra) if extra else sized).join(side(cut), "pattern").withColumn("last", F.coalesce(F.col("last"), F.lit(-1)))
    shown = ["doc_id", *extra, "size", "source_size", "target"]
    whole = rows_in.where(F.col("bucket") != F.col("last")).select(*shown, (F.col("size") * (F.col("full") + (F.col("bucket") < F.col("last")).cast("long"))).alias("taken"))
    run = Window.partitionBy("pattern").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = (
        rows_in.where(F.col("bucket") == F.col("last"))
        .withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
        .select(*shown, (F.col("size") * (F.col("full") + (F.col("at") + F.col("size") / 2 < F.col("rest")).cast("long"))).alias("taken"))
    )
    return whole.unionByName(split), flow


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix takes it. Columns named as this
    operator's own are put aside under other names meanwhile."""
    aside = {c: f"__{k}_{c}" for k, c in enumerate(docs.columns) if c in _OWN}
    named = docs.withColumnsRenamed(aside)
    taken, _ = mix_sources(named, seed, keep=tuple(named.columns))
    rows = taken.where("taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return rows.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
