"""Document fingerprints (operator 3): consistent weighted sampling.

Terms are runs of two lower-cased words (a text of one word has that word); a term weighs as often as it
occurs times its bytes, so likeness counts text rather than words. For sample k and term x, r and c are
draws from Gamma(2, 1) and b from [0, 1), fixed by (x, k); with t = floor(ln w / r + b), the sample is
the term of least ln c - r (t - b) - r, together with its t. Two documents share a sample with
the probability of their generalised Jaccard similarity: sum of lesser weights over sum of greater.

Documents meet their successors without a global sort. Their order is (doc_id, hash of the text), so that
many documents of one doc_id are split too. Cuts come from a hash-chosen sample of some SAMPLED keys a
bucket; any cuts give right results, they only steer the balance. One aggregation finds each bucket's
first key exactly; documents with that key also go to the bucket before it that has rows (the very first
key to the last bucket), and each bucket is sorted and read by itself.

Defined cases: a null text is empty; texts without words have one fixed fingerprint, like each other (1)
and unlike any other (0); null doc_ids sort first; equal doc_ids are ordered by a hash of the text; repeated
rows follow each other; very long texts are one part by themselves; a single document is its own
successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import release, small_batches, text_or_empty
from tracefold.llm.shingles import mix, shingles, word_hashes

SAMPLES = 64
#: Quantiles of Gamma(2, 1) that draws are taken from, and rows of (term, sample) that are held at once.
QUANTILES, BLOCK, HELD = 1 << 16, 1 << 12, 1 << 16
EMPTY = np.uint16(0)
#: Keys sampled for each bucket.
SAMPLED = 48


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) e^-x, by Newton's method."""
    p = (np.arange(QUANTILES) + 0.5) / QUANTILES
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_R = _gamma2().astype(np.float32)
_LOG_C = np.log(_gamma2()).astype(np.float32)
_B = ((np.arange(QUANTILES) + 0.5) / QUANTILES).astype(np.float32)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max


def _samples(term: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """[term, sample]: in the upper half the value to minimise in sortable form, in the lower a digest of (term, t)."""
    h = term[:, None] * _SEEDS[None, :]
    h ^= h >> np.uint64(32)
    h *= _SPREAD
    lanes = h.view(np.uint16).reshape(*h.shape, 4)
    r = _R.take(lanes[:, :, 3])
    b = _B.take(lanes[:, :, 1])
    t = np.floor(log_w[:, None] / r + b)
    a = _LOG_C.take(lanes[:, :, 2])
    a -= r * (t - b + np.float32(1))
    bits = a.view(np.int32)
    key = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32
    digest = (term[:, None] >> np.uint64(32)).astype(np.uint32) + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
    return key | digest.astype(np.int64)


def signatures(texts: list[str]) -> np.ndarray:
    """[text, sample] of 16 bits each. Texts that share terms are best given together."""
    h, of, size = word_hashes(texts)
    out = np.full((len(texts), SAMPLES), _NONE, np.int64)
    if len(h):
        s, owner = shingles(h, of, len(texts), 2)
        # bytes of a term: of both words; shingles() gives runs of two in order, then single words
        pair = np.flatnonzero(of[:-1] == of[1:])
        single = np.flatnonzero(np.bincount(of, minlength=len(texts)) == 1)
        first = np.searchsorted(of, single)
        chars = np.concatenate([size[pair] + size[pair + 1], size[first]])
        order = np.lexsort((s, owner))
        s, owner, chars = s[order], owner[order], chars[order]
        new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])]))
        s, owner, weight = s[new], owner[new], np.add.reduceat(chars, new)
        log_w = np.log(weight).astype(np.float32)
        _, at, back = np.unique(s ^ (weight.astype(np.uint64) * _SPREAD), return_index=True, return_inverse=True)
        known = None
        if len(at) <= HELD:  # terms met again with the same weight are drawn once
            known = np.concatenate([_samples(s[at[low : low + BLOCK]], log_w[at[low : low + BLOCK]]) for low in range(0, len(at), BLOCK)])
        for low in range(0, len(s), BLOCK):
            part = slice(low, low + BLOCK)
            got = known[back[part]] if known is not None else _samples(s[part], log_w[part])
            doc = owner[part]
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[starts]] = np.minimum(out[doc[starts]], np.minimum.reduceat(got, starts, axis=0))
    sig = (mix((out & 0xFFFFFFFF).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    sig = np.where(sig == EMPTY, np.uint16(1), sig)
    sig[out[:, 0] == _NONE] = EMPTY
    return sig


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def hexed(sig: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sig]


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many characters of the following document, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _answer(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, which is only the successor of the one before."""
    n = len(texts) - 1
    edited = [edited_text(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    both = signatures([*texts, *edited])
    own, new = both[: n + 1], both[n + 1 :]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids[:n], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": hexed(own[:n]),
        "edited_fingerprint": hexed(new),
        "near_edited": likeness(own[:n], new),
        "near_next": likeness(own[:n], own[1:]),
    })


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, head, order); a bucket's own rows end with the successor of its last one."""
    release()
    bucket, ids, texts, size, done = None, [], [], 0, False
    for batch in batches:
        for own, head, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "head", "doc_id", "text")), strict=True):
            if own != bucket:
                bucket, ids, texts, size, done = own, [], [], 0, False
            if done:
                continue
            ids.append(doc)
            texts.append(text)
            size += len(text)
            done = bool(head)
            if len(texts) > 1 and (done or size > 1 << 16):
                yield _answer(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def bucket_heads(keys: DataFrame, parts: int) -> tuple[list[tuple], list[int | None], list[tuple | None]]:
    """Cuts between buckets; each bucket's first key (known, doc_id, hash), None without rows; the bucket its head also goes to."""
    n_rows = keys.count()
    every = max(1, n_rows // (SAMPLED * parts))
    # some SAMPLED distinct keys a bucket, whatever the table's size
    sample = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64("doc_id", "hash", F.lit(7)), F.lit(every)) == 0).distinct().collect())
    cuts = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    found = keys.withColumn("bucket", bucket_of(cuts)("known", "doc_id", "hash")).groupBy("bucket").agg(F.min(F.struct("known", "doc_id", "hash")).alias("first"))
    heads: list[tuple | None] = [None] * (len(cuts) + 1)
    for r in found.collect():  # a row a bucket
        heads[r.bucket] = tuple(r.first)
    full = [k for k, h in enumerate(heads) if h is not None]
    before: list[int | None] = [None] * len(heads)
    for at, k in enumerate(full):
        before[k] = full[at - 1]
    return cuts, before, heads


def bucket_of(cuts: list[tuple]):
    @F.pandas_udf("int")
    def place(known: pd.Series, doc: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, key) for key in zip(known.tolist(), doc.tolist(), code.tolist(), strict=True)], dtype="int32")

    return place


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, its fingerprint, that of the edited text, and both likenesses."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("given"), text_or_empty().alias("text"))
    # never a null in Python: a batch of ids that has one would be read as floating point
    rows = rows.select(F.col("given").isNotNull().cast("int").alias("known"), F.coalesce("given", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, before, heads = bucket_heads(rows.drop("text"), parts)

    @F.pandas_udf("array<int>")
    def places(known: pd.Series, doc: pd.Series, code: pd.Series) -> pd.Series:
        out = []
        for key in zip(known.tolist(), doc.tolist(), code.tolist(), strict=True):
            own = bisect_right(cuts, key)
            out.append([2 * own, 2 * before[own] + 1] if key == heads[own] else [2 * own])
        return pd.Series(out, dtype=object)

    dealt = rows.withColumn("place", F.explode(places("known", "doc_id", "hash"))).withColumn("bucket", F.shiftright("place", 1))
    ordered = dealt.repartitionById(parts, "bucket").sortWithinPartitions("place", "known", "doc_id", "hash")
    given = F.when(F.col("known") == 1, F.col("doc_id")).alias("doc_id")
    return ordered.select("bucket", F.col("place").bitwiseAND(1).alias("head"), given, "text").mapInArrow(
        _follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
