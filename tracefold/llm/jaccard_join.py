"""N-gram Jaccard join (operator 2): universe partition and pigeonhole, with exact verification.

Two shingle sets of sizes a <= b link at similarity 4/5 only if they differ in at most H = (a + b) / 9
shingles. Shingles are hashed into segments, more than H of them by size band; if sets differ in at most
H shingles, then for any v with sum over segments of v(i) > H, some segment i differs in fewer than v(i).
So every set is indexed under a signature of each of its segments (and, in one segment of 16, of each
set of that segment less one shingle), and probes only some: v = 0 skips a segment, 1 asks for an equal
one, 2 for one with at most one shingle more or less. The allocation is by cost: segments whose shingles
are all common (or that are empty) are skipped first, paid for by spare segments and then by v = 2
elsewhere. The list of common shingles steers only the cost; results don't depend on it. Sets probe
their own size band and, where partners may be larger, the next. Spare segments that needn't be skipped
are probed too: then a partner must be met in segments with sum of v(i) - H at least, and a set whose
shared signatures altogether don't come to that has no partner there and stops probing.

Candidates are met by blocks. A set's block is its most shared signature that at most BLOCK_SETS sets (of
BLOCK_SHINGLES shingles together) have, or, if one in DENSE of its signatures is more shared than that, a salted
part of the most shared one; blocks that meet many others are merged up to that size, so a group of near
copies is a few blocks. Two blocks meet if a set of the one probes a signature that a set of
the other has indexed, with sizes that can link, and if what they share comes to sum of v(i) - H for any
of the probing sets. For each such pair of blocks, all pairs of their sets are verified on whole sets of
64-bit hashes, through a product of incidence matrices; out come each set's number of links and a
spanning forest, never the pairs. Equal sets are one node throughout, with its copies.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer than
five words is one shingle; repeated rows and equal doc_ids are rows each; a null doc_id is a row with
links like any other, and the component_id of a group is its smallest known doc_id (null if none is
known); very long texts are compared whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import Scratch, release, small_batches, text_or_empty, unused
from tracefold.llm.shingles import distinct, mix, shingles, word_hashes

WIDTH = 5
#: Similarity at least NUM / DEN.
NUM, DEN = 4, 5
BAND_RATIO, SPARE = 1.5, 1.2
#: One segment of so many also has its one-deletion neighbourhood indexed.
DELETED = 16
#: Entries a map task holds before it writes them out; bits of a packed entry for its document and flags.
HOLD, DOC_BITS = 3_000_000, 20
INDEX, PROBE, DOUBLE, NEXT = 1, 2, 4, 8
#: Sets and shingles of a block; pairs of sets that are merged by sorting rather than by a matrix; columns of a matrix at once.
BLOCK_SETS, BLOCK_SHINGLES, FEW_PAIRS, COLUMNS = 512, 1 << 20, 6, 2048
#: A set one of whose so many groups are larger than a block takes a part of the largest one as its block; blocks that
#: meet so many others are merged with them to fewer.
DENSE, MANY = 5, 8
#: A shingle counts as common in this share of documents; so many of the commonest are sent to all tasks.
COMMON_SHARE, COMMON_LEAST, COMMON_MOST = 1 / 2000, 16, 200_000

_BAND, _SEGMENT, _ELEMENT, _GONE, _SET = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))


@lru_cache(1)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band, its last, and its number of segments."""
    first = [1]
    while first[-1] < 1 << 31:
        first.append(max(first[-1] + 1, int(first[-1] * BAND_RATIO)))
    first = np.array(first, np.int64)
    last = np.concatenate([first[1:] - 1, [1 << 40]])
    need = 2 * last // (2 * DEN - 1) + 1
    return first, last, np.where(need > 1, np.ceil(need * SPARE).astype(np.int64) + 1, 1)


def differing(a, b):
    """The most shingles in which linked sets of these sizes differ: they share at least 4/9 of the sum."""
    share = -(-NUM * (a + b) // (NUM + DEN))
    return a + b - 2 * share


def most_differing(a, low, high):
    """The most shingles in which a set of size a differs from linked ones of sizes low to high: ``differing`` steps back by
    one between sums, so the largest size need not have it."""
    return np.maximum(differing(a, high), differing(a, np.maximum(low, high - 1)))


def text_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text number) sorted; sizes; a 64-bit name of each text's set."""
    h, of, _ = word_hashes(texts)
    s, o = shingles(h, of, len(texts), WIDTH)
    s, o, _ = distinct(s, o)
    sizes = np.bincount(o, minlength=len(texts)).astype(np.int64)
    names = np.zeros(len(texts), np.uint64)
    if len(s):
        np.add.at(names, o, mix(s ^ _SET))
    return s, o, sizes, mix(names + sizes.astype(np.uint64) * _BAND)


def _segments(s: np.ndarray, o: np.ndarray, band: np.ndarray, rare: np.ndarray):
    """For sets laid out in segments of their band: first place of each set, element's place, sums, rare elements and all elements of each segment."""
    m = bands()[2][band]
    base = np.concatenate([[0], np.cumsum(m)])
    b = band[o].astype(np.uint64)
    place = base[o] + (((mix(s ^ (b * _BAND)) >> np.uint64(32)) * m[o].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    element = mix(s + _ELEMENT)
    sums = np.zeros(base[-1], np.uint64)
    np.add.at(sums, place, element)
    count = np.bincount(place[rare], minlength=base[-1])
    return base, place, element, sums, count, np.bincount(place, minlength=base[-1])


def _name(sums: np.ndarray, segment: np.ndarray, band: np.ndarray, kind: int = 0) -> np.ndarray:
    return mix(sums + segment.astype(np.uint64) * _SEGMENT + band.astype(np.uint64) * _BAND + np.uint64(kind) * _GONE)


def entries(s: np.ndarray, o: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, flags) of all sets given, and for each set and step (own band, next) the sum of
    v(i) that a partner must be met in; every size must be at least 1."""
    first, last, _ = bands()
    rare = np.ones(len(s), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s
    own = np.searchsorted(first, sizes, side="right") - 1
    most = sizes * DEN // NUM
    out = [[], [], []]
    must = np.zeros((2, len(sizes)), np.int64)

    def put(sig, doc, flags):
        out[0].append(sig)
        out[1].append(doc)
        out[2].append(np.broadcast_to(np.uint8(flags), sig.shape) if np.isscalar(flags) else flags)

    for step in (0, 1):
        members = np.arange(len(sizes)) if step == 0 else np.flatnonzero(most > last[own])
        if not len(members):
            continue
        number = np.full(len(sizes), -1)
        number[members] = np.arange(len(members))
        inside = number[o] >= 0
        es, eo, er = s[inside], number[o[inside]], rare[inside]
        band = own[members] + step
        base, place, element, sums, count, held = _segments(es, eo, band, er)
        doc = np.repeat(np.arange(len(members)), np.diff(base))
        segment = np.arange(base[-1]) - base[doc]
        need = most_differing(sizes[members], np.maximum(sizes[members], first[band]), np.minimum(most[members], last[band])) + 1
        # cheapest segments first: those with the most rare shingles, then with the most of any; empty ones last
        order = np.lexsort((segment, -held, -count, doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - base[doc[order]]
        chosen = (rank < need[doc]) | (count > 0)
        doubled = np.zeros(len(doc), bool)
        neighbours = segment % DELETED == DELETED - 1
        dear = chosen & (count == 0)
        for d in np.unique(doc[dear]).tolist():
            at = slice(base[d], base[d + 1])
            swap = np.flatnonzero(chosen[at] & neighbours[at] & (count[at] >= 2)) + base[d]
            drop = np.flatnonzero(dear[at]) + base[d]
            k = min(len(swap), len(drop))
            doubled[swap[:k]] = True
            chosen[drop[:k]] = False
        must[step, members] = np.bincount(doc, weights=chosen.astype(float) + doubled, minlength=len(members)).astype(np.int64) - need + 1
        sig = _name(sums, segment, band[doc])
        probe = PROBE | NEXT * step
        if step == 0:
            put(sig, members[doc], np.where(doubled, INDEX | PROBE | DOUBLE, np.where(chosen, INDEX | PROBE, INDEX)).astype(np.uint8))
            gone = neighbours[place]
            at = place[gone]
            put(_name(sums[at] - element[gone], segment[at], band[doc[at]], 1), members[doc[at]], INDEX)
        else:
            put(sig[chosen], members[doc[chosen]], np.where(doubled[chosen], probe | DOUBLE, probe).astype(np.uint8))
        if doubled.any():
            at = np.flatnonzero(doubled)  # the other side has one more ...
            put(_name(sums[at], segment[at], band[doc[at]], 1), members[doc[at]], probe | DOUBLE)
            less = doubled[place]  # ... or one less
            at = place[less]
            put(_name(sums[at] - element[less], segment[at], band[doc[at]]), members[doc[at]], probe | DOUBLE)
    return (*(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.uint64, np.int64, np.uint8), strict=True)), must)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its size and node; and shingles that are common within this task, with their counts."""
    release()
    seen, docs = [], 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        s, _, sizes, nodes = text_sets(texts)
        docs += len(texts)
        if len(s):
            seen.append(np.unique(s, return_counts=True))
        if sum(len(x[0]) for x in seen) > HOLD:
            seen = [_heavy(seen, max(2, docs // 4000))]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int64)), batch.column("lost"), batch.column("key"), pa.array(sizes), pa.array(nodes.view(np.int64))], ["kind", "lost", "key", "n", "node"])
    if seen:
        s, c = _heavy(seen, max(4, docs // 1000))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(s), np.int64)), pa.nulls(len(s), pa.bool_()), pa.nulls(len(s), pa.int64()), pa.array(c.astype(np.int64)), pa.array(s.view(np.int64))], ["kind", "lost", "key", "n", "node"])


def _heavy(seen: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    s, c = np.concatenate([x[0] for x in seen]), np.concatenate([x[1] for x in seen])
    order = np.argsort(s)
    s, c = s[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    c = np.add.reduceat(c, at)
    return s[at][c >= least], c[c >= least]


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, all their first bytes first: what neighbours share compresses in the shuffle."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _emit(common_sent, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        common = common_sent.value
        low, inner = np.uint64((1 << DOC_BITS) - 1), np.uint64(0xFFFFFF)
        met: set[int] = set()
        held, nodes, sizes, musts, n_docs, n_held = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            packed, bucket = (np.concatenate([h[k] for h in held]) for k in range(2))
            held.clear()
            node, size, must = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(musts, axis=1).astype(np.uint64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket, np.arange(buckets + 1), sorter=order)
            packed = packed[order]
            del bucket, order
            rows = {"bucket": [], "entries": [], "nodes": []}
            for b in range(buckets):
                own = np.sort(packed[cuts[b] : cuts[b + 1]])
                if len(own):
                    used, local = np.unique(own & low, return_inverse=True)
                    rows["bucket"].append(b)
                    rows["entries"].append(_planes((own & ~low) | local.astype(np.uint64)))
                    used = used.astype(np.int64)
                    rows["nodes"].append(_planes(np.concatenate([node[used], size[used].astype(np.uint64), must[0, used] | (must[1, used] << np.uint64(32))])))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int64()), "entries": pa.array(rows["entries"], pa.binary()), "nodes": pa.array(rows["nodes"], pa.binary())})

        for batch in batches:
            s, o, n, names = text_sets(batch.column("text").to_pylist())
            fresh = np.zeros(len(n), bool)
            for k, (size, name) in enumerate(zip(n.tolist(), names.tolist(), strict=True)):
                if size and name not in met:
                    met.add(name)
                    fresh[k] = True
            if not fresh.any():
                continue
            if held and n_docs + int(fresh.sum()) > 1 << DOC_BITS:
                yield flush()
                held, nodes, sizes, musts, n_docs, n_held = [], [], [], [], 0, 0
            number = np.cumsum(fresh) - 1
            inside = fresh[o]
            sig, doc, flags, must = entries(s[inside], number[o[inside]], n[fresh], common)
            musts.append(must)
            packed = (sig & ~inner) | (flags.astype(np.uint64) << np.uint64(DOC_BITS)) | (doc + n_docs).astype(np.uint64)
            held.append((packed, ((sig & inner) % np.uint64(buckets)).astype(np.int32)))
            nodes.append(names[fresh])
            sizes.append(n[fresh])
            n_docs += int(fresh.sum())
            n_held += len(sig)
            if n_held > HOLD:
                yield flush()
                held, nodes, sizes, musts, n_docs, n_held = [], [], [], [], 0, 0
        if held:
            yield flush()

    return work


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows come bucket by bucket; only one bucket is held."""
    own, rows = None, []
    for batch in batches:
        for b, e, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "entries", "nodes")), strict=True):
            if b != own and rows:
                yield own, rows
                rows = []
            own = b
            rows.append((e, t))
    if rows:
        yield own, rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's entries, those whose signature another set has too, where one side probes and the other is indexed."""
    release()
    low, shift = np.uint64((1 << DOC_BITS) - 1), np.uint64(DOC_BITS)
    for b, rows in _buckets(batches):
        keys, flags, node, size, must = [], [], [], [], []
        for e, t in rows:
            e, t = _numbers(e), _numbers(t).reshape(3, -1)
            at = (e & low).astype(np.int64)
            keys.append(e & ~np.uint64(0xFFFFFF))
            flag = ((e >> shift) & np.uint64(15)).astype(np.uint8)
            flags.append(flag)
            must.append(((t[2][at] >> np.where(flag & NEXT, np.uint64(32), np.uint64(0))) & np.uint64(0xFFFFFFFF)).astype(np.int64))
            node.append(t[0][at])
            size.append(t[1][at].astype(np.int64))
        key = np.concatenate(keys)
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        starts = np.flatnonzero(new)
        many = np.diff(np.concatenate([starts, [len(order)]])) > 1
        order = order[many[np.cumsum(new) - 1]]
        if not len(order):
            continue
        key, flag, n, z, v = (x[order] for x in (key, np.concatenate(flags), np.concatenate(node), np.concatenate(size), np.concatenate(must)))
        order = np.lexsort((n, key))
        key, flag, n, z, v = key[order], flag[order], n[order], z[order], v[order]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (n[1:] != n[:-1])]))
        flag = np.bitwise_or.reduceat(flag, at)  # one entry for each set and signature
        key, n, z, v = key[at], n[at], z[at], v[at]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        sets = np.diff(np.concatenate([starts, [len(key)]]))
        useful = (sets > 1) & ((np.bitwise_or.reduceat(flag, starts) & PROBE) > 0)
        keep = useful[np.cumsum(new) - 1]
        sig = (key[keep] | np.uint64(b)).view(np.int64)
        for at in range(0, len(sig), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(sig[part]), pa.array(n[keep][part].view(np.int64)), pa.array(z[keep][part]), pa.array(flag[keep][part].astype(np.int64)), pa.array(v[keep][part])], ["sig", "node", "n", "flags", "must"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each wanted node, once: other texts may stand under the same doc_id."""
    release()
    met: set[int] = set()
    for batch in batches:
        s, o, _, names = text_sets(batch.column("text").to_pylist())
        cuts = np.searchsorted(o, np.arange(len(names) + 1))
        rows = []
        for k, (name, wanted) in enumerate(zip(names.view(np.int64).tolist(), batch.column("node").to_pylist(), strict=True)):
            if name == wanted and name not in met:
                met.add(name)
                rows.append(k)
        values = [pa.array(s[cuts[k] : cuts[k + 1]].view(np.int64)) for k in rows]
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        flat = pa.concat_arrays(values) if values else pa.array([], pa.int64())
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("block").take(at), batch.column("copies").take(at), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["node", "block", "copies", "shingles"])


def able_entries(shared: DataFrame) -> DataFrame:
    """The entries without probes of sets that can't have a partner, and without groups that have no probe left."""
    probes = shared.where(F.col("flags").bitwiseAND(PROBE) > 0).withColumn("step", F.col("flags").bitwiseAND(NEXT))
    met = probes.groupBy("node", "step").agg(F.sum(F.when(F.col("flags").bitwiseAND(DOUBLE) > 0, 2).otherwise(1)).alias("met"), F.max("must").alias("must"))
    able = met.where("met >= must").select("node", "step", F.lit(True).alias("able"))
    rows = shared.withColumn("step", F.col("flags").bitwiseAND(NEXT)).join(able, ["node", "step"], "left")
    flags = F.when(F.col("able"), F.col("flags")).otherwise(F.col("flags").bitwiseAND(INDEX))
    return rows.select("sig", "node", "n", flags.alias("flags"), "must").where("flags > 0")


def block_of(groups: DataFrame) -> DataFrame:
    """(node, block) from entries with their group's ``sets`` and ``total`` shingles. Sets of which one group in
    DENSE at least is larger than a block are near copies of many: their blocks are parts of their largest group."""
    group = F.struct("sets", "total", "sig")
    fits = (F.col("sets") <= BLOCK_SETS) & (F.col("total") <= BLOCK_SHINGLES)
    best = groups.groupBy("node").agg(F.max(F.when(fits, group)).alias("fit"), F.max(group).alias("largest"), F.count_if(fits).alias("small"), F.count(F.lit(1)).alias("all"))
    parts = F.ceil(F.greatest(F.col("largest.sets") / BLOCK_SETS, F.col("largest.total") / BLOCK_SHINGLES)).cast("long")
    part = F.xxhash64("largest.sig", F.pmod(F.xxhash64(F.coalesce("fit.sig", "node")), parts))
    return best.select("node", F.when(DENSE * (F.col("all") - F.col("small")) < F.col("all"), F.xxhash64("fit.sig", F.lit(-1).cast("long"))).otherwise(part).alias("block"))


def block_pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of blocks, once each, that can hold linked sets."""
    bit = lambda flag: F.col("flags").bitwiseAND(flag)
    held = entries.groupBy("sig", "block").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.when(bit(INDEX) > 0, F.col("n"))).alias("y_least"), F.max(F.when(bit(INDEX) > 0, F.col("n"))).alias("y_most"),
        *(f(F.when((bit(PROBE) > 0) & (bit(NEXT) == NEXT * step), c)).alias(f"{name}_{step}") for step in (0, 1)
          for name, f, c in (("x_least", F.min, F.col("n")), ("x_most", F.max, F.col("n")), ("must", F.min, F.col("must")), ("v", F.max, F.when(bit(DOUBLE) > 0, 2).otherwise(1)))),
    )
    one = F.explode(F.array(*(F.struct(F.lit(step).alias("step"), *(F.col(f"{c}_{step}").alias(c) for c in ("x_least", "x_most", "must", "v"))) for step in (0, 1))))
    probing = held.select("sig", F.col("block").alias("x"), one.alias("p")).where("p.v IS NOT NULL").select("sig", "x", "p.*")
    indexed = held.where("y_least IS NOT NULL").select("sig", F.col("block").alias("y"), "members", "y_least", "y_most")
    met = probing.join(indexed, "sig").where(f"(x <> y OR members > 1) AND x_least <= y_most AND {NUM} * y_least <= {DEN} * x_most")
    enough = met.groupBy("x", "y", "step").agg(F.sum("v").alias("met"), F.min("must").alias("must")).where("met >= must")
    return enough.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def merged_blocks(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, into): blocks that meet at least MANY are dealt to parts, of the size of a block, of what gathers
    around the most met block they meet; others stay."""
    ends = pairs.select("a", "b").unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.groupBy("a").agg(F.count(F.lit(1)).alias("met"))
    hub = ends.join(degree.select(F.col("a").alias("b"), F.col("met").alias("d")), "b").groupBy("a").agg(F.max(F.struct("d", "b")).alias("hub"))
    many = degree.where(F.col("met") >= MANY).join(hub, "a").select(F.col("a").alias("block"), F.col("hub.b").alias("hub"))
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    sized = many.join(sizes, "block")
    parts = sized.groupBy("hub").agg(F.ceil(F.greatest(F.sum("sets") / BLOCK_SETS, F.sum("total") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    return sized.join(parts, "hub").select("block", F.xxhash64("hub", F.pmod(F.xxhash64("block"), F.col("parts")), F.lit(1)).alias("into"))


def _together(s: np.ndarray, owner: np.ndarray, n_left: int, n_right: int, same: bool) -> np.ndarray:
    """Sizes of all intersections of left with right sets; owners are numbered left first, then right (none if ``same``)."""
    order = np.argsort(s, kind="stable")
    s, owner = s[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    times = np.diff(np.concatenate([starts, [len(s)]]))
    starts, times = starts[times > 1], times[times > 1]
    out = np.zeros((n_left, n_left if same else n_right))
    if not len(starts):
        return out
    # shingles that the same sets have are one column, weighed by their number
    lanes = mix(np.arange(1, n_left + n_right + 1, dtype=np.uint64) * _SET)
    run = np.concatenate([[np.uint64(0)], np.cumsum(lanes[owner])])
    _, first, weight = np.unique(run[starts + times] - run[starts], return_index=True, return_counts=True)
    starts, times = starts[first], times[first]
    for low in range(0, len(starts), COLUMNS):
        at, many = starts[low : low + COLUMNS], times[low : low + COLUMNS]
        column = np.repeat(np.arange(len(at)), many)
        row = owner[np.repeat(at - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        held = np.zeros((n_left + n_right, len(at)))
        held[row, column] = 1
        right = held[:n_left] if same else held[n_left:]
        out += (held[:n_left] * weight[low : low + COLUMNS]) @ right.T
    return out


def _linked(n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that have ``both`` shingles in common are similar enough."""
    return DEN * both >= NUM * (n + m - both)


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    left, out = np.ones(len(link), bool), []
    for start in range(len(link)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            fresh = np.flatnonzero(link[at] & left)
            left[fresh] = False
            out += [(at, k) for k in fresh.tolist()]
            queue += fresh.tolist()
    return out


class _Found:
    """Links found in a task: numbers for each node, and edges that join what they join."""

    def __init__(self):
        self.few: list = []
        self.held = 0
        self.rows: list[list] = [[], [], []]

    def put(self, node, other, links):
        for own, x in zip(self.rows, (node, other, links), strict=True):
            own.append(x)

    def pair(self, left: list, right: list, same: bool) -> None:
        """left, right: (node, copies, shingles) of both blocks, ``right`` empty if they are one."""
        couples = [(x, y) for k, x in enumerate(left) for y in (left[k + 1 :] if same else right)] if len(left) * max(len(left) if same else len(right), 1) <= 2 * FEW_PAIRS else None
        if couples is not None and len(couples) <= FEW_PAIRS:
            for x, y in couples:
                a, b = sorted((len(x[2]), len(y[2])))
                if NUM * b <= DEN * a:
                    self.few.append((x, y))
                    self.held += a + b
            if self.held > 1 << 20:
                self.merge()
            return
        sets = [x[2] for x in (*left, *right)]
        sizes = np.array([len(x) for x in sets], np.int64)
        nodes, copies = (np.array([x[k] for x in (*left, *right)], np.int64) for k in (0, 1))
        m = len(left)
        both = _together(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), m, len(right), same)
        link = _linked(sizes[:m, None], (sizes[:m] if same else sizes[m:])[None, :], both)
        if same:
            np.fill_diagonal(link, False)
            whole, counts = link, link @ copies
        else:
            whole = np.zeros((len(sets), len(sets)), bool)
            whole[:m, m:], whole[m:, :m] = link, link.T
            counts = whole @ copies
        some = np.flatnonzero(counts)
        self.put(nodes[some], np.full(len(some), -1), counts[some])
        edges = np.array(_forest(whole), np.int64).reshape(-1, 2)
        self.put(nodes[edges[:, 0]], nodes[edges[:, 1]], np.zeros(len(edges), np.int64))

    def merge(self) -> None:
        """All pairs kept so far at once: shingles of both sets sorted, equal neighbours counted."""
        if not self.few:
            return
        n, m = (np.array([len(p[k][2]) for p in self.few], np.int64) for k in (0, 1))
        s = np.concatenate([x for p in self.few for x in (p[0][2], p[1][2])])
        of = np.repeat(np.arange(len(self.few)), n + m)
        order = np.lexsort((s, of))
        s, of = s[order], of[order]
        both = np.bincount(of[1:][(s[1:] == s[:-1]) & (of[1:] == of[:-1])], minlength=len(self.few))
        for k in np.flatnonzero(_linked(n, m, both)).tolist():
            (x, x_copies, _), (y, y_copies, _) = self.few[k]
            self.put([x, y, x], [-1, -1, y], [y_copies, x_copies, 0])
        self.few, self.held = [], 0

    def batch(self) -> pa.RecordBatch:
        node, other, links = (np.concatenate([np.asarray(x, np.int64) for x in own]) if own else np.zeros(0, np.int64) for own in self.rows)
        self.rows = [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other, mask=links > 0), pa.array(links)], ["node", "other", "links"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by pair of blocks (a, b), left block first. Out come rows (node, links) and edges (node, other, 0)."""
    release()
    found, own, sides = _Found(), None, ([], [])
    for batch in batches:
        a, b, side, node, copies = (batch.column(c).to_pylist() for c in ("a", "b", "side", "node", "copies"))
        lists = batch.column("shingles")
        flat, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for k in range(len(a)):
            if (a[k], b[k]) != own:
                if own:
                    found.pair(*sides, own[0] == own[1])
                own, sides = (a[k], b[k]), ([], [])
            sides[side[k]].append((node[k], copies[k], flat[cuts[k] : cuts[k + 1]]))
        if len(found.rows[0]) > 256:
            yield found.batch()
    if own:
        found.pair(*sides, own[0] == own[1])
    found.merge()
    yield found.batch()


def compared(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Numbers of links and a forest of edges, of all pairs of blocks."""
    ends = pairs.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    met = ends.join(sets, "block").select("a", "b", "side", "node", "copies", "shingles")
    return met.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(_compare, "node long, other long, links long")


def linked_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): alternating large-star and small-star until nothing changes."""
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = scratch.table(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(now)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(lost, key, text): the doc_id, or for a null one a hash of its text."""
    given = F.col("doc_id").cast("long")
    return docs.select(given.isNull().alias("lost"), F.coalesce(given, F.xxhash64(text_or_empty())).alias("key"), text_or_empty().alias("text"))


def component_rows(docs: DataFrame) -> DataFrame:
    """Per document: lost, key, n, node, root, copies, lowest (the component's smallest known doc_id) and others (linked documents)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark, 200)
    scratch, parts = Scratch(spark, "jaccard"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed_texts(docs)
    scanned = scratch.table(rows.mapInArrow(_scan, "kind long, lost boolean, key long, n long, node long"), "scan")
    table = scanned.where("kind = 0").select("lost", "key", "n", "node")
    n_docs = table.count()
    heavy = scanned.where("kind = 1").groupBy("node").agg(F.sum("n").alias("c")).where(F.col("c") >= max(COMMON_LEAST, n_docs * COMMON_SHARE))
    common = np.array([r.node for r in heavy.orderBy(F.desc("c")).limit(COMMON_MOST).select("node").collect()], np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(np.sort(common))
    dealt = rows.select("text").mapInArrow(_emit(sent, parts), "bucket long, entries binary, nodes binary").repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    shared = scratch.table(dealt.mapInArrow(_shared, "sig long, node long, n long, flags long, must long"), "shared")
    able = scratch.table(able_entries(shared), "able")
    scratch.drop("shared")
    of_node = F.struct("lost", "key")
    names = table.where("n > 0").groupBy("node").agg(F.min(F.when(~F.col("lost"), F.col("key"))).alias("least"), F.min(of_node).alias("at"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    groups = able.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"), F.bit_or("flags").alias("any")).where((F.col("any").bitwiseAND(PROBE) > 0) & (F.col("sets") > 1))
    live = able.join(groups.drop("any"), "sig")
    blocks = scratch.table(block_of(live).join(names.select("node", "at", "n", "copies"), "node"), "blocks")
    entries = able.join(groups.select("sig"), "sig", "left_semi").join(blocks.select("node", "block"), "node")
    pairs = scratch.table(block_pairs(entries), "pairs")
    scratch.drop("able")
    into = scratch.table(merged_blocks(pairs, blocks), "into")
    one = pairs.join(into.select(F.col("block").alias("a"), F.col("into").alias("x")), "a", "left").join(into.select(F.col("block").alias("b"), F.col("into").alias("y")), "b", "left")
    one = one.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    pairs = scratch.table(one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    blocks = blocks.join(into, "block", "left").withColumn("block", F.coalesce("into", "block")).drop("into")
    if pairs.isEmpty():
        return table.join(names.select("node", "copies", F.col("least").alias("lowest")), "node", "left").select("lost", "key", "n", "node", F.col("node").alias("root"), "copies", "lowest", F.lit(0).cast("long").alias("others"))
    met = pairs.select(F.col("a").alias("block")).unionByName(pairs.select(F.col("b").alias("block"))).distinct()
    wanted = blocks.join(met, "block", "left_semi").select("node", "block", "copies", "at.lost", "at.key")
    sets = scratch.table(rows.join(wanted, ["lost", "key"]).select("text", "node", "block", "copies").mapInArrow(_sets, "node long, block long, copies long, shingles array<long>"), "sets")
    links = scratch.table(compared(pairs, sets, parts), "links")
    scratch.drop("sets", "pairs", "blocks", "into")
    others = links.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("others"))
    comp = linked_components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    rooted = scratch.table(names.drop("n").join(comp, "node", "left").join(others, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "copies", F.coalesce("others", F.lit(0)).alias("others")), "rooted")
    scratch.drop("links", "edges")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("lowest"))
    return table.join(rooted.join(lowest, "root").drop("least"), "node", "left").select("lost", "key", "n", "node", F.coalesce("root", "node").alias("root"), "copies", "lowest", "others")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), n_links.

    n_links counts all other documents that are similar enough, each copy of a text by itself.
    """
    given = F.when(~F.col("lost"), F.col("key"))
    wordy = F.col("n") > 0
    return component_rows(docs).select(
        given.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(wordy, F.col("lowest")).otherwise(given).alias("component_id"),
        F.when(wordy, F.col("others") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def _node_of(text: str) -> Column:
    @F.pandas_udf("long")
    def nodes(texts: pd.Series) -> pd.Series:
        return pd.Series(text_sets([t or "" for t in texts])[3].view(np.int64))

    return nodes(F.col(text))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then of the least
    text; different texts under one doc_id are apart unless linked. Texts without words link with nothing
    and all stay."""
    lost, key, node, only = (unused(docs, name) for name in ("lost", "key", "node", "only"))
    parts = component_rows(docs).where("n > 0")
    least = parts.groupBy("root").agg(F.min(F.struct("lost", "key", "node")).alias("c")).select("c.*")
    rows_of = parts.groupBy("lost", "key").agg((F.count(F.lit(1)) == 1).alias("only"))
    chosen = least.join(rows_of, ["lost", "key"]).select(F.col("lost").alias(lost), F.col("key").alias(key), F.col("node").alias(node), F.col("only").alias(only))
    chosen = Scratch(docs.sparkSession, "jaccard").table(chosen, "chosen")
    given = F.col("doc_id").cast("long")
    keyed = docs.withColumn(lost, given.isNull()).withColumn(key, F.coalesce(given, F.xxhash64(text_or_empty())))
    wordy = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    alone = keyed.where(wordy).join(chosen.where(F.col(only)).select(lost, key), [lost, key], "left_semi").select(*docs.columns)
    # several rows of one doc_id: the one with the chosen set, and one of equal ones
    several = keyed.where(wordy).join(chosen.where(~F.col(only)).select(lost, key, F.col(node).alias(node + "_")), [lost, key]).where(_node_of("text") == F.col(node + "_"))
    one = several.groupBy(lost, key, node + "_").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns)))).alias(node)).select(f"{node}.*")
    return alone.unionByName(one).unionByName(docs.where(~wordy))
