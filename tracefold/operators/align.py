"""Alignment, distances, clusters and concordance of runs.

These are not relational, so they run as Arrow-batched functions: pairs row by row, multiple alignment and
linkage by group, with all runs of a group. Equal label sequences are aligned once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

GAP = None


#: Cells up to which plain lists are faster than arrays; steers speed only.
FEW_CELLS = 100


def _scores(a: list, b: list) -> list[list[int]]:
    """Score matrix of the global alignment, match 1, mismatch and gap -1."""
    n, m = len(a), len(b)
    if n * m <= FEW_CELLS:
        rows = [list(range(0, -m - 1, -1))]
        for i, x in enumerate(a, 1):
            above, last, row = rows[-1], -i, [-i]
            for j, y in enumerate(b):
                last = max(last - 1, above[j] + (1 if x == y else -1), above[j + 1] - 1)
                row.append(last)
            rows.append(row)
        return rows
    score = np.zeros((n + 1, m + 1), np.int32)
    score[:, 0], score[0, :] = -np.arange(n + 1), -np.arange(m + 1)
    same = np.array([[x == y for y in b] for x in a], bool).reshape(n, m)
    slope = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int32)
        best[0] = -i
        best[1:] = np.maximum(score[i - 1, :-1] + np.where(same[i - 1], 1, -1), score[i - 1, 1:] - 1)
        score[i] = np.maximum.accumulate(best + slope) - slope  # gaps in a run along the row
    return score.tolist()


def _aligned(a: list, b: list, score: list[list[int]]) -> tuple[list, list]:
    i, j, left, right = len(a), len(b), [], []
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and score[i][j] == score[i - 1][j] - 1:
            i -= 1
            left.append(a[i])
            right.append(GAP)
        else:
            j -= 1
            left.append(GAP)
            right.append(b[j])
    return left[::-1], right[::-1]


def align_pair(a: list, b: list) -> tuple[list, list]:
    """Global alignment, match 1, mismatch and gap -1; on ties diagonal, then a gap in b, then one in a."""
    return _aligned(a, b, _scores(a, b))


#: Cells of one diagonal that a batch of alignments works on at a time; steers speed and memory only.
BATCH_CELLS = 1 << 18


def _coded(sequences: list) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as columns of codes, padded below, and their lengths."""
    code: dict = {}
    size = np.array([len(s) for s in sequences], np.int64)
    flat = np.array([code.setdefault(v, len(code)) for s in sequences for v in s], np.int64)
    out = np.zeros((int(size.max(initial=0)), len(sequences)), np.uint8 if len(code) < 256 else np.int32)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(size)), size)] = flat
    return out, size


def _batch(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of a batch of pairs, a column each; all score matrices go on by one diagonal at a time.

    A cell holds its score plus i + j, so a gap is free, a match adds 3 and a mismatch 1, and the matched columns
    of the path that ``align_pair`` would take from it: of the diagonal, then the cell above, then the one before.
    """
    count, height, width = len(n), int(n.max()), int(m.max())
    least = 3 * min(height, width)
    kind = np.uint8 if least < 256 else np.uint16 if least < 65536 else np.uint32
    left, back = left[:height], right[:width][::-1].copy()
    score, both = ([np.zeros((height + 1, count), kind) for _ in range(3)] for _ in "ab")
    spare = [np.empty((min(height, width), count), kind) for _ in range(3)]
    flag, ends = np.empty((min(height, width), count), bool), n + m
    order = np.argsort(ends, kind="stable")
    starts = np.searchsorted(ends[order], np.arange(height + width + 2))
    found, met = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for d in range(2, height + width + 1):
        lo, hi = max(1, d - width), min(height, d - 1)
        if lo <= hi:
            k, far, near, now = hi - lo + 1, score[(d - 2) % 3], score[(d - 1) % 3], score[d % 3][lo : hi + 1]
            up, before, (step, mask, other), yes = near[lo - 1 : hi], near[lo : hi + 1], (x[:k] for x in spare), flag[:k]
            np.equal(left[lo - 1 : hi], back[width - d + lo : width - d + hi + 1], out=yes)
            met_here = yes.view(np.uint8) if kind is np.uint8 else yes.astype(kind)
            np.add(met_here, met_here, out=step)
            np.add(step, kind(1), out=step)
            np.add(step, far[lo - 1 : hi], out=step)
            # the paths' matched columns: those above where above is as good as before, else those before
            b_far, b_near, b_now = both[(d - 2) % 3][lo - 1 : hi], both[(d - 1) % 3], both[d % 3][lo : hi + 1]
            np.greater_equal(up, before, out=yes)
            np.negative(yes.view(np.uint8) if kind is np.uint8 else yes.astype(kind), out=mask)
            np.bitwise_xor(b_near[lo - 1 : hi], b_near[lo : hi + 1], out=other)
            np.bitwise_and(other, mask, out=other)
            np.bitwise_xor(b_near[lo : hi + 1], other, out=other)
            np.maximum(up, before, out=now)
            np.greater_equal(step, now, out=yes)
            np.negative(yes.view(np.uint8) if kind is np.uint8 else yes.astype(kind), out=mask)
            np.maximum(step, now, out=now)
            np.add(b_far, kind(1), out=step)
            np.bitwise_xor(step, other, out=step)
            np.bitwise_and(step, mask, out=step)
            np.bitwise_xor(other, step, out=b_now)
        at = order[starts[d] : starts[d + 1]]
        if len(at):
            found[at], met[at] = score[d % 3][n[at], at], both[d % 3][n[at], at]
    columns = ends - met
    return (columns + ends - found) // 2 / np.maximum(columns, 1)


def index_distances(coded: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per pair of column numbers the share of aligned columns that differ, 0 for two empty runs."""
    codes, size = coded
    n, m = size[i], size[j]
    out, at = np.zeros(len(i)), 0
    order = np.lexsort((m, n // 8))[::-1]  # sides of a batch are of about one length: few cells are padding
    while at < len(order):
        part = order[at : at + max(1, BATCH_CELLS // int(n[order[at]] + 8))]
        out[part] = _batch(codes.take(i[part], 1), codes.take(j[part], 1), n[part], m[part])
        at += len(part)
    return out


def pair_distances(xs: list, ys: list) -> np.ndarray:
    """Per pair the share of aligned columns that differ, 0 for two empty runs; the paths are ``align_pair``'s."""
    if sum(len(x) * len(y) for x, y in zip(xs, ys, strict=True)) <= 10 * FEW_CELLS:
        out = np.zeros(len(xs))
        for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
            score = _scores(x, y)
            columns = len(_aligned(x, y, score)[0])
            out[k] = (columns - score[-1][-1]) // 2 / max(columns, 1)
        return out
    place = np.arange(len(xs))
    return index_distances(_coded([*xs, *ys]), place, place + len(xs))


def distance(a: list, b: list) -> float:
    """Share of aligned columns that differ; 0 for two empty runs."""
    return float(pair_distances([a], [b])[0])


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by key over a stated number of partitions, which AQE leaves alone: rows are few here and work a row is much."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Runs of a group that one task compares with as many others; fewer where a group has less than eight such blocks.
BLOCK, SMALL_BLOCK = 256, 64


def _known(names: pa.ListArray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Per row the number of its sequence, and the distinct sequences coded."""
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    labels = names.flatten().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.cumsum(names.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    unique: dict = {}
    which = np.array([unique.setdefault(labels[a:b].tobytes(), len(unique)) for a, b in zip([0, *ends], ends, strict=False)], np.int64)
    return which, _coded([np.frombuffer(s, np.int32).tolist() for s in unique])


def _units(rows: DataFrame, run: str) -> GroupedData:
    """Rows by pairs of blocks of their group."""
    n = F.count(F.lit(1))
    sizes = rows.groupBy(F.col("group_id").alias("g")).agg(F.greatest(F.ceil(n / BLOCK), F.least(F.ceil(n / SMALL_BLOCK), F.lit(8))).cast("long").alias("blocks"))
    copies = rows.withColumn("copies", n.over(Window.partitionBy("group_id", "names")))
    block = F.pmod(F.when(F.col("copies") <= BLOCK, F.xxhash64("names")).otherwise(F.xxhash64(run)), F.col("blocks"))
    dealt = copies.join(sizes, F.equal_null("group_id", "g")).select("group_id", run, "names", "blocks", block.alias("block"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "group_id", run, "names", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return _spread(met, "group_id", "lo", "hi").groupBy("group_id", "lo", "hi")


def pairwise_distances(runs: DataFrame, group: str = "task_id") -> DataFrame:
    """(group_id, run_a, run_b, distance) of all pairs within each group, from the run of lesser id to the other.

    A group's runs are dealt to blocks of some ``BLOCK``, and each pair of blocks is a task's unit: a run is shuffled
    once for each block of its group, no pair carries its sequences. Equal sequences go to one block, unless they are
    more than a block, and those of a unit are aligned once.
    """
    few = runs.select(F.col(group).alias("group_id"), "run_id", "names")
    shape = pa.schema([(c, pa.string()) for c in ("group_id", "run_a", "run_b")] + [("distance", pa.float64())])

    def compare(rows: pa.Table) -> pa.Table:
        which, coded = _known(rows["names"])
        run, lo = rows["run_id"].combine_chunks(), rows["block"].to_numpy() == rows["lo"].to_numpy()
        rank = np.unique(np.array(run.to_pylist(), object), return_inverse=True)[1]
        if rows["lo"][0] == rows["hi"][0]:
            i, j = np.triu_indices(len(rows), 1)
        else:
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(lo), np.flatnonzero(~lo), indexing="ij"))
        i, j = (np.where(rank[i] < rank[j], *p) for p in ((i, j), (j, i)))
        i, j = (x[rank[i] != rank[j]] for x in (i, j))
        pairs, back = np.unique(which[i] * len(coded[1]) + which[j], return_inverse=True)
        d = index_distances(coded, *np.divmod(pairs, len(coded[1])))[back.ravel()]
        group_id = pa.repeat(rows["group_id"][0], len(i))
        return pa.table([group_id, run.take(pa.array(i)), run.take(pa.array(j)), pa.array(d)], schema=shape)

    return _units(few, "run_id").applyInArrow(compare, "group_id string, run_a string, run_b string, distance double")


def consensus_of(rows: list[list]) -> list:
    """Per column the commonest value that isn't a gap; ties go to the first row's."""
    out = []
    for column in zip(*rows, strict=True):
        counts: dict = {}
        for v in column:
            if v is not GAP:
                counts[v] = counts.get(v, 0) + 1
        out.append(max(counts, key=counts.get) if counts else GAP)
    return out


def align_group(sequences: list[list]) -> list[list]:
    """Progressive multiple alignment: the closest pair first, then always the run nearest to the consensus."""
    n = len(sequences)
    if n < 2:
        return [list(s) for s in sequences]
    unique: dict = {}
    which = np.array([unique.setdefault(tuple(s), len(unique)) for s in sequences])
    distinct = list(unique)
    square = _square(sequences)
    square[np.tril_indices(n)] = np.inf
    i, j = divmod(int(square.argmin()), n)
    kept: dict = {}

    def nearest(model: list, left: list) -> int:
        """The first of ``left`` that is nearest to the model; each model meets each sequence once."""
        known = kept.setdefault(tuple(model), np.full(len(distinct), np.nan))
        new = [u for u in np.unique(which[left]) if np.isnan(known[u])]
        if new:
            known[new] = pair_distances([model] * len(new), [distinct[u] for u in new])
        return left[int(known[which[left]].argmin())]

    rows = dict(zip((i, j), align_pair(sequences[i], sequences[j]), strict=True))
    left = [k for k in range(n) if k not in rows]
    while left:
        agreed = consensus_of(list(rows.values()))
        model = [v for v in agreed if v is not GAP]
        k = nearest(model, left)
        left.remove(k)
        base, new = align_pair(model, sequences[k])
        # where the model gets a gap, all rows do; columns that are all gaps stay where they were
        at, columns, out = 0, {r: [] for r in rows}, []
        for x, y in zip(base, new, strict=True):
            if x is not GAP:
                while agreed[at] is GAP:
                    for r in rows:
                        columns[r].append(rows[r][at])
                    out.append(GAP)
                    at += 1
                for r in rows:
                    columns[r].append(rows[r][at])
                at += 1
            else:
                for r in rows:
                    columns[r].append(GAP)
            out.append(y)
        for r in rows:
            columns[r] += rows[r][at:]
        out += [GAP] * (len(agreed) - at)
        rows = {**columns, k: out}
    return [rows[k] for k in range(n)]


def _merge(d: np.ndarray, ids: list[int], sizes: list[int], step: int) -> list[tuple[int, int, float, int]]:
    """Average linkage in place: always the first of the closest pairs by row and column. Of each row the least value
    or a bound below it is known; averages are no less than both their sides, so bounds hold until they are met."""
    np.fill_diagonal(d, np.inf)
    least, stale, merges = d.min(axis=1, initial=np.inf), np.zeros(len(d), bool), []
    for _ in range(len(d) - 1):
        x = int(least.argmin())
        while stale[x]:
            least[x], stale[x] = d[x].min(), False
            x = int(least.argmin())
        y = int(d[x].argmin())
        a, b = d[x], d[y]
        merges.append((*sorted((ids[x], ids[y])), float(a[y]), sizes[x] + sizes[y]))
        stale |= (least == a) | (least == b)
        new = (a * sizes[x] + b * sizes[y]) / (sizes[x] + sizes[y])
        new[[x, y]] = np.inf
        d[x, :] = d[:, x] = new
        d[y, :] = d[:, y] = np.inf
        np.minimum(least, new, out=least)
        least[x], least[y] = new.min(), np.inf
        stale[[x, y]] = False
        sizes[x] += sizes[y]
        ids[x], step = step, step + 1
    return merges


def linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Average linkage of a square distance matrix: (a, b, height, size), new clusters numbered from n."""
    n = len(d)
    return _merge(d.astype(float), list(range(n)), [1] * n, n)


def linked(which: np.ndarray, d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """``linkage`` of sequences, of which ``d`` has the distances of distinct ones, by number in order of appearance;
    changes it. Only equal ones are at distance 0, so they come first, averaged as often as their copies would be."""
    n = step = len(which)
    merges, ids, sizes = [], [], []
    of: list[list[int]] = [[] for _ in d]
    for k, u in enumerate(which.tolist()):
        of[u].append(k)
    for u, members in enumerate(of):
        last, one, row = members[0], d[u].copy(), d[u].copy()
        for size, k in enumerate(members[1:], 1):
            merges.append((*sorted((last, k)), 0.0, size + 1))
            row = (row * size + one) / (size + 1)
            last, step = step, step + 1
        if len(members) > 1:
            d[u, :] = d[:, u] = row
        ids.append(last)
        sizes.append(len(members))
    return merges + _merge(d, ids, sizes, step) if n else []


def cut(merges: list[tuple[int, int, float, int]], n: int, threshold: float) -> list[int]:
    """Cluster numbers, from 0 in order of each cluster's first member, of merges up to ``threshold``."""
    members = {k: [k] for k in range(n)}
    for step, (a, b, height, _) in enumerate(merges):
        if height <= threshold:
            members[n + step] = members.pop(a) + members.pop(b)
    label = {m: k for k, group in enumerate(sorted(members.values(), key=min)) for m in group}
    return [label[k] for k in range(n)]


def _distinct(sequences: list[list]) -> tuple[list[tuple], np.ndarray]:
    unique: dict = {}
    which = np.array([unique.setdefault(tuple(s), len(unique)) for s in sequences], np.int64)
    return list(unique), which


def _distances(keys: list) -> np.ndarray:
    """Square matrix of distances from each of ``keys`` to those before it; some million pairs at a time."""
    d, coded, at = np.zeros((len(keys), len(keys))), _coded(keys), 0
    while at < len(keys):
        to = min(len(keys), at + max(1, (1 << 20) // (at + 1)))
        i, j = np.tril_indices(to - at, at - 1, to)
        i += at
        d[i, j] = d[j, i] = index_distances(coded, i, j)
        at = to
    return d


def _square(sequences: list[list]) -> np.ndarray:
    keys, which = _distinct(sequences)
    return _distances(keys)[np.ix_(which, which)]


def _by_group(runs: DataFrame, group: str, work, schema: str) -> DataFrame:
    rows = runs.select(F.col(group).alias("group_id"), "run_id", "success", "names")

    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run_id", ignore_index=True)
        return work(rows, [list(s) for s in rows["names"]])

    return _spread(rows, "group_id").groupBy("group_id").applyInPandas(apply, schema)


def aligned_cells(runs: DataFrame, group: str = "task_id") -> DataFrame:
    """Long form of each group's multiple alignment; a gap is null."""

    def work(rows, sequences):
        matrix = align_group(sequences)
        width = max(map(len, matrix), default=0)
        at = np.repeat(np.arange(len(matrix)), width)
        values = np.empty(len(at), object)
        values[:] = [v for row in matrix for v in [*row, *[None] * (width - len(row))]]
        told = {c: rows[c].to_numpy(object)[at] for c in ("group_id", "run_id", "success")}
        return pd.DataFrame({"group_id": told["group_id"], "row_idx": at, "run_id": told["run_id"], "success": told["success"], "col": np.tile(np.arange(width), len(matrix)), "value": values})

    return _by_group(runs, group, work, "group_id string, row_idx int, run_id string, success boolean, col int, value string")


def _by_tree(runs: DataFrame, group: str, work, schema: str) -> DataFrame:
    """``work`` on each group's rows by run_id and its merges. Distances of distinct sequences are found by blocks, as in
    ``pairwise_distances``, each from the one that comes later to the earlier; a group's task only joins them."""
    rows = runs.select(F.col(group).alias("group_id"), "run_id", "success", "names")
    once = rows.groupBy("group_id", "names").agg(F.min("run_id").alias("first"))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("first")
        first, own, (which, coded) = rows["first"].combine_chunks(), rows["block"].to_numpy() == rows["lo"].to_numpy(), _known(rows["names"])
        a, b = np.flatnonzero(own), np.arange(len(rows)) if own.all() else np.flatnonzero(~own)
        i, j = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
        d, new = np.zeros(len(i)), i > j if own.all() else np.ones(len(i), bool)
        d[new] = index_distances(coded, which[np.maximum(i, j)[new]], which[np.minimum(i, j)[new]])
        return pa.table({"group_id": rows["group_id"][:1], "a": pa.array([first.take(pa.array(a)).to_pylist()], pa.list_(pa.string())), "b": pa.array([first.take(pa.array(b)).to_pylist()], pa.list_(pa.string())), "d": pa.array([d.tobytes()], pa.binary())})

    parts = _units(once, "first").applyInArrow(compare, "group_id string, a array<string>, b array<string>, d binary")

    def join(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run_id", ignore_index=True)
        keys, which = _distinct(rows.pop("names").tolist())
        place: dict = {}
        for run, u in zip(rows["run_id"], which.tolist(), strict=True):
            place.setdefault(run, u)
        d = np.zeros((len(keys), len(keys)))
        for a, b, part in zip(parts.pop("a"), parts.pop("b"), parts.pop("d"), strict=True):
            at, to = ([place[f] for f in x] for x in (a, b))
            part = np.frombuffer(part).reshape(len(at), len(to))
            d[np.ix_(at, to)] += part
            d[np.ix_(to, at)] += part.T
        return work(rows, linked(which, d))

    return _spread(rows, "group_id").groupBy("group_id").cogroup(parts.groupBy("group_id")).applyInPandas(join, schema)


def clusters(runs: DataFrame, group: str = "task_id", threshold: float = 0.3) -> DataFrame:
    """(group_id, run_id, cluster_id) by average linkage of alignment distances, cut at ``threshold``."""

    def work(rows, merges):
        ids = cut(merges, len(rows), threshold)
        return pd.DataFrame({"group_id": rows["group_id"], "run_id": rows["run_id"], "cluster_id": ids})

    return _by_tree(runs, group, work, "group_id string, run_id string, cluster_id int")


def splits(runs: DataFrame, group: str = "task_id") -> DataFrame:
    """Merges of each group's dendrogram with both sides' sizes and pass rates, highest first."""

    def work(rows, merges):
        sides, out = [(1, int(s is not None), int(bool(s))) for s in rows["success"].astype(object).where(rows["success"].notna(), None)], []  # runs, known, passed
        for step, (a, b, height, _) in enumerate(merges):
            rates = [passed / known if known else None for _, known, passed in (sides[a], sides[b])]
            out.append((rows["group_id"][0], step, height, sides[a][0], sides[b][0], *rates))
            sides.append(tuple(map(sum, zip(sides[a], sides[b], strict=True))))
        return pd.DataFrame(out[::-1], columns=["group_id", "step", "height", "n_left", "n_right", "left_rate", "right_rate"])

    return _by_tree(runs, group, work, "group_id string, step int, height double, n_left int, n_right int, left_rate double, right_rate double")


def kendall_tau(x: np.ndarray, y: np.ndarray) -> tuple[float, float | None]:
    """Tau-b and its two-sided p by the normal approximation with ties; (0, None) under five pairs or without variance."""
    n = len(x)
    if n < 5 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0, None
    dx, dy = (np.sign(v[:, None] - v[None, :])[np.triu_indices(n, 1)] for v in (x, y))
    s, total = float((dx * dy).sum()), n * (n - 1) / 2
    ties = [np.unique(v, return_counts=True)[1].astype(float) for v in (x, y)]
    lost = [float((t * (t - 1) / 2).sum()) for t in ties]
    tau = s / math.sqrt((total - lost[0]) * (total - lost[1]))
    v = [float((t * (t - 1) * (2 * t + 5)).sum()) for t in ties]
    var = (n * (n - 1) * (2 * n + 5) - v[0] - v[1]) / 18 + 4 * lost[0] * lost[1] / (2 * n * (n - 1))
    var += float((ties[0] * (ties[0] - 1) * (ties[0] - 2)).sum()) * float((ties[1] * (ties[1] - 1) * (ties[1] - 2)).sum()) / (9 * n * (n - 1) * (n - 2))
    return tau, math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None


def concordance(runs: DataFrame, group: str = "task_id", least: int = 5) -> DataFrame:
    """Per group whether closeness to the consensus goes with passing: tau-b over runs of known outcome."""

    def work(rows, sequences):
        known = rows["success"].notna().to_numpy()
        if known.sum() < least or rows["success"][known].nunique() < 2:
            return pd.DataFrame(columns=["group_id", "n_runs", "tau", "p_value"], dtype=object)  # Arrow makes chunks of empty floats as strings
        matrix = align_group([s for s, k in zip(sequences, known, strict=True) if k])
        width = max(map(len, matrix), default=0)
        matrix = [r + [GAP] * (width - len(r)) for r in matrix]
        agreed = consensus_of(matrix)
        near = np.array([-sum(a != b for a, b in zip(r, agreed, strict=True)) / max(1, width) for r in matrix])
        tau, p = kendall_tau(near, rows["success"][known].astype(float).to_numpy())
        return pd.DataFrame({"group_id": [rows["group_id"][0]], "n_runs": [int(known.sum())], "tau": [tau], "p_value": [p]})

    return _by_group(runs, group, work, "group_id string, n_runs int, tau double, p_value double")
