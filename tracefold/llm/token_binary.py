"""Token-ID / binary output (operator 1).

Layout of an output folder: for each shard a flat file of unsigned integers (``.bin``, 16 bits where
the vocabulary fits, else 32, little endian), the 64-bit offset of each document in it (``.idx``, one
more than documents) and the document ids (``.doc``, 64 bits), plus ``manifest.json`` with each
shard's base: the ids of all shards before it, by prefix sum. A document's global start is base +
offset, so no file is rewritten once bases are known, and readers memory-map what they need.

Defined cases: a null text is empty (it still gets the end id); null doc_ids sort first, their number is
in the manifest and they are read back as null; repeated rows and equal doc_ids stay, in order of a hash
of the text; very long texts are encoded whole, one at a time; an empty table gives an empty manifest and
no rows; other columns are ignored.

A text's units are encoded by the tokenizers library, each distinct one of a batch once, many in a row as one text,
and looked up if met before: this vocabulary's pre-tokenizer never joins what stands before a single space or line feed
between two visible characters with what follows, so such units encode alike in any text.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import resident, small_batches, text_or_empty

#: Units longer than this are not kept, and the cache starts anew beyond so many units.
KEEP_CHARS, KEEP_UNITS, SEEN = 32, 600_000, 1 << 23
#: Units met once lately whose ids are at hand should they come again.
YOUNG = 400_000
#: Units that go to the library as one text.
JOINED = 512
#: Texts whose distinct units are encoded together, unless their characters come to more first.
BATCH_TEXTS, BATCH_CHARS = 400, 1 << 22


class UnitEncoder:
    """Encodes whole texts through the library, each distinct unit of a batch once.

    Names in the cache: ``w`` is the unit " w" inside a text, `` w`` the unit "w" at its start or after a
    line feed. Names that are empty or have white space at an end are never kept, so a text that has one
    is always told by what it misses, and is cut into longer units.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.vocab_size = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        #: Bytes of each token: a byte-level token has a character for each.
        self.n_bytes = np.zeros(max(self.lib.get_vocab().values(), default=0) + 1, np.int64)
        for token, i in self.lib.get_vocab().items():
            self.n_bytes[i] = len(token)
        self.cache: dict[str, bytes] = {}
        #: Marks of what has been missed once: only what comes again is kept.
        self.missed = bytearray(SEEN)
        self.young: dict[str, bytes] = {}
        self.spaced = self._checks_out()

    def _checks_out(self) -> bool:
        """Whether units may be encoded apart: byte-level splitting without a prefix or normalizer."""
        rules = json.loads(self.lib.to_str())
        pre = rules.get("pre_tokenizer") or {}
        return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not rules.get("normalizer")

    def _lib(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, names: list[str]) -> list[bytes]:
        """Ids of units by their names, JOINED in a call: as in a text, each follows a space or line feed, and the
        tokens' bytes tell where it ends."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        for low in range(0, len(names), JOINED):
            part = names[low : low + JOINED]
            first = [n[0] == " " for n in part]
            spelled = ["\n" + n[1:] if f else " " + n for n, f in zip(part, first, strict=True)]
            ids = np.array(self.lib.encode_batch_fast(["".join(spelled)], add_special_tokens=False)[0].ids, np.int64)
            stops = np.cumsum(self.n_bytes[ids])
            ends = np.cumsum(list(map(len, map(str.encode, spelled))))
            cuts = np.searchsorted(stops, ends, side="right")
            if not len(ids) or stops[-1] != ends[-1] or (stops[cuts - 1] != ends).any():
                out += self._lib([w[f:] for w, f in zip(spelled, first, strict=True)])
                continue
            data = ids.astype(self.dtype).tobytes()
            starts = np.concatenate([[0], cuts[:-1]]) + np.array(first)  # without the line feed's token
            out += [data[a:b] for a, b in zip((starts * width).tolist(), (cuts * width).tolist(), strict=True)]
        return out

    @staticmethod
    def _gaps(codes: list[bytes | None]) -> list[int]:
        """Places without a code."""
        out, at = [], -1
        try:
            while True:
                at = codes.index(None, at + 1)
                out.append(at)
        except ValueError:
            return out

    @staticmethod
    def units(parts: list[str]) -> list[str]:
        """Parts of a text split at spaces, rejoined wherever white space meets white space."""
        out, last_open = [], True
        for k, p in enumerate(parts):
            if k == 0:
                out.append(p)
            elif last_open or p == "" or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(" " + p)
            last_open = p == "" or p[-1].isspace()
        return out

    @staticmethod
    def _odd(names: Collection[str]) -> set[str]:
        """Names that are empty or have white space at an end, besides the one space in front that marks a start."""
        return {n for n, bare in zip(names, map(str.strip, names), strict=True) if n != bare and (n[0] != " " or len(bare) != len(n) - 1) or not bare}

    def _lines(self, name: str) -> list[str] | None:
        """Names of what stands between single line feeds of a unit, if nothing else but they is white space there."""
        names = name.replace("\n", "\n ").split("\n")
        return None if self._odd(names) else names

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian bytes of ``dtype``."""
        if not self.spaced:
            return self._lib(texts)
        cache = self.cache
        if len(cache) > KEEP_UNITS:
            cache.clear()
            self.missed = bytearray(SEEN)
        plans: list[list[str] | None] = []
        for text in texts:
            if any(s in text for s in self.special):
                plans.append(None)
            else:
                first, *rest = text.split(" ")
                plans.append([" " + first, *rest])
        met = [names and list(map(cache.get, names)) for names in plans]
        gaps = {k: at for k, codes in enumerate(met) if codes and (at := self._gaps(codes))}
        missing = set().union(*(map(plans[k].__getitem__, at) for k, at in gaps.items()))
        odd = self._odd(missing)
        missing -= odd
        lines = {n: parts for n in missing if "\n" in n and (parts := self._lines(n))}
        missing.difference_update(lines)
        for parts in lines.values():
            missing.update(p for p in parts if p not in cache)
        young = self.young
        again = {n: young.pop(n) for n in missing if n in young}
        cache.update(again)
        missing.difference_update(again)
        fresh = dict(zip(missing, self._apart(list(missing)), strict=True))
        if lines:
            feed = self._lib(["\n"])[0]
            joined = {n: feed.join([cache[p] if p in cache else fresh[p] for p in parts]) for n, parts in lines.items()}
        else:
            joined = {}
        known = fresh | again | joined
        whole: dict[str, bytes] = {}
        if odd:
            uneven = [k for k, at in gaps.items() if not odd.isdisjoint(map(plans[k].__getitem__, at))]
            for k in uneven:
                plans[k] = self.units([plans[k][0][1:], *plans[k][1:]])
            units = list(set().union(*(plans[k] for k in uneven)))
            whole = dict(zip(units, self._lib(units), strict=True))
            for k in uneven:
                met[k] = [whole[u] for u in plans[k]]
                del gaps[k]
        own = iter(self._lib([t for t, names in zip(texts, plans, strict=True) if names is None]))
        out = []
        for k, codes in enumerate(met):
            if codes is None:
                out.append(next(own))
                continue
            for at in gaps.get(k, ()):
                codes[at] = known[plans[k][at]]
            out.append(b"".join(codes))
        missed = self.missed
        if len(young) > YOUNG:
            young.clear()
        for n, code in fresh.items():  # only what is missed a second time is kept, so that units met once don't crowd the cache
            if len(n) > KEEP_CHARS or "\n" in n:
                continue
            at = hash(n) & (SEEN - 1)
            if missed[at]:
                cache[n] = code
            else:
                missed[at] = 1
                young[n] = code
        return out


def encoder(path: str) -> UnitEncoder:
    return resident(("token_binary", path), lambda: UnitEncoder(path))


def bounded(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in parts of bounded number and length; a longer text is a part by itself."""
    part, size = [], 0
    for text in texts:
        if part and (len(part) >= BATCH_TEXTS or size + len(text) > BATCH_CHARS):
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _writer(path: str, out: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, store = encoder(path), pafs.FileSystem.from_uri(out)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        folder = f"{store[1]}/shard-{shard:07d}"
        temp, end = f"{folder}.tmp-{attempt}", np.array([end_id], code.dtype).tobytes()
        lengths, ids, nulls, sink = [], [], 0, None
        for batch in batches:
            if sink is None:
                sink = store[0].open_output_stream(f"{temp}.bin")
            texts = batch.column("text").to_pylist()
            for part in bounded(texts):
                for data in code.encode(part):
                    sink.write(data + end)
                    lengths.append(len(data) // code.dtype.itemsize + 1)
            nulls += batch.column("doc_id").null_count
            ids.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        for kind, data in (("idx", offsets), ("doc", np.concatenate(ids).astype("<i8"))):
            with store[0].open_output_stream(f"{temp}.{kind}") as f:
                f.write(data.tobytes())
        for kind in ("bin", "idx", "doc"):  # a repeated attempt replaces equal files
            store[0].move(f"{temp}.{kind}", f"{folder}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])], "width": [code.dtype.itemsize], "n_null": [nulls]})

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0) -> dict:
    """Encode ``docs`` (doc_id, text) into shards under the URI ``out``; return the manifest.

    One range shuffle on (doc_id, hash of the text) puts documents in order; only one row per shard,
    never per document, comes back for the prefix sums.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = pafs.FileSystem.from_uri(out)
    place[0].create_dir(place[1], recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    shards = dealt.mapInArrow(_writer(tokenizer_path, out, end_id), "shard long, n_docs long, n_tokens long, width long, n_null long").collect()
    base, listed = 0, []
    for s in sorted(shards, key=lambda s: s.shard):
        listed.append({"shard": s.shard, "base": base, "n_docs": s.n_docs, "n_tokens": s.n_tokens, "width": s.width, "n_null": s.n_null})
        base += s.n_tokens
    manifest = {"path": out, "end_id": end_id, "n_tokens": base, "shards": listed}
    with place[0].open_output_stream(f"{place[1]}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _span(store, path: str, dtype: str, low: int, high: int) -> np.ndarray:
    """Items [low, high) of a file: through a memory map on local disks, by a ranged read elsewhere."""
    width = np.dtype(dtype).itemsize
    if low >= high:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", low * width, (high - low,))
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at((high - low) * width, low * width), dtype)


def _reader(out: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/shard-{row['shard']:07d}"
                for low in range(0, row["n_docs"], 1024):
                    high = min(low + 1024, row["n_docs"])
                    at, doc = _span(store, f"{name}.idx", "<u8", low, high + 1).astype(np.int64), _span(store, f"{name}.doc", "<i8", low, high)
                    ids = _span(store, f"{name}.bin", f"<u{row['width']}", int(at[0]), int(at[-1]))
                    cuts = (at - at[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                    null = np.arange(low, high) < row["n_null"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(doc), mask=null), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(spark: SparkSession, manifest: dict) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.createDataFrame([(s["shard"], s["base"], s["width"], s["n_docs"], s["n_null"]) for s in manifest["shards"]], "shard long, base long, width long, n_docs long, n_null long")
    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(_reader(manifest["path"]), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_slice(manifest: dict, start: int, stop: int) -> np.ndarray:
    """Global ids [start, stop) through the memory maps, as a training loader would take them."""
    store, root = pafs.FileSystem.from_uri(manifest["path"])
    parts = []
    for s in manifest["shards"]:
        low, high = max(start, s["base"]), min(stop, s["base"] + s["n_tokens"])
        if low < high:
            parts.append(np.asarray(_span(store, f"{root}/shard-{s['shard']:07d}.bin", f"<u{s['width']}", low - s["base"], high - s["base"])))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
