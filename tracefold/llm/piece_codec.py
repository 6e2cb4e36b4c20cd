"""SentencePiece encoding and decoding (operator 5): exact merge-type encoding by backtracking.

A sequence of pieces is what merging gives if and only if each two neighbours, concatenated and merged
anew, come out as the same two pieces: merges that cross a boundary would show in that pair first. So
the encoder never merges a text. An Aho-Corasick automaton finds the pieces at each position; the
longest compatible one is taken; where none fits, the position is marked in a bitfield of failed
positions (a prefix has one valid encoding at most, so a failed position need not be tried again) and
the last piece gives way to its next shorter one.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become byte pieces;
repeated rows each get their row; an empty table gives no rows; other columns are kept as they are, but
for columns named as the results, which the results replace.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import resident, small_batches
from tracefold.llm.piece_model import META, PieceModel

#: Longer words are not kept, each cache starts anew beyond its number, and so many marks are of words met once.
KEEP_CHARS, KEEP_WORDS, KEEP_PAIRS, SEEN = 32, 500_000, 1_000_000, 1 << 23


class PieceCodec:
    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.lib, self.ids, self.score = self.model.lib, self.model.ids, self.model.score
        self.found = self.model.automaton(lambda p: (len(p), p))
        self.kept: dict[str, tuple[int, ...]] = {}
        #: Only words that come again are kept: most that differ are met once.
        self.met = bytearray(SEEN)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text_of = [str(i) for i in range(self.lib.get_piece_size())]
        self.cut = "\n" if "\n" not in self.model.joining else None

    def merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours whose union scores best, the leftmost of equals, until none is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a``: merging their union gives them back. ``a`` is empty at the start."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def pieces(self, word: str) -> list[str]:
        n = len(word)
        at: list[list[str]] = [[] for _ in range(n)]
        for end, (length, piece) in self.found.iter(word):
            at[end - length + 1].append(piece)
        for k in range(n):
            at[k].reverse()  # found by end, so shorter first
            if not at[k] or len(at[k][-1]) > 1:
                at[k].append(word[k])
        path: list[str] = []
        nexts, failed, pos = [0] * (n + 1), 0, 0
        while pos < n:
            last, choices = path[-1] if path else "", at[pos]
            k = nexts[pos]
            while k < len(choices) and (failed >> (pos + len(choices[k])) & 1 or not self.fits(last, choices[k])):
                k += 1
            nexts[pos] = k + 1
            if k < len(choices):
                path.append(choices[k])
                pos += len(choices[k])
                nexts[pos] = 0
            else:
                failed |= 1 << pos
                pos -= len(path.pop())
        return path

    def word_ids(self, word: str) -> tuple[int, ...]:
        ids, other = self.ids, self.model.other
        return tuple(chain.from_iterable((ids[p],) if p in ids else other(p) for p in self.pieces(word)))

    def _split(self, word: str) -> tuple[int, ...]:
        """Ids of a unit, cut further beside characters that always stand alone."""
        if self.cut and self.cut in word:
            out: list[int] = []
            for k, line in enumerate(word.split(self.cut)):
                if k:
                    out += self.model.other(self.cut) if self.cut not in self.ids else (self.ids[self.cut],)
                if line:
                    out += self._lookup(line)
            return tuple(out)
        return self.word_ids(word)

    def _lookup(self, word: str) -> tuple[int, ...]:
        code = self.kept.get(word)
        if code is None:
            code = self._split(word)
            mark = hash(word) & (SEEN - 1)
            if not self.met[mark]:
                self.met[mark] = 1
            elif len(word) <= KEEP_CHARS and "\n" not in word:
                self.kept[word] = code
        return code

    def encode(self, text: str) -> list[int]:
        if len(self.kept) > KEEP_WORDS:
            self.kept.clear()
            self.met = bytearray(SEEN)
        if len(self.pairs) > KEEP_PAIRS:
            self.pairs.clear()
        words = self.model.words(self.lib.normalize(text)) if text else []
        codes = list(map(self.kept.get, words))
        if None in codes:
            codes = [self._lookup(w) if c is None else c for w, c in zip(words, codes, strict=True)]
        return list(chain.from_iterable(codes))


def codec(path: str) -> PieceCodec:
    return resident(("piece_codec", path), lambda: PieceCodec(path))


def encode_column(text: Column, path: str) -> Column:
    """Ids of each text: ARRAY<INT>."""

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        code = codec(path)
        return pd.Series([code.encode(t or "") for t in texts], dtype=object)

    return encoded(text)


def round_trip(text: Column, path: str) -> Column:
    """Encode, decode with the library, and digest both: STRUCT<n_tokens, ids_sha256, decoded_sha256>."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        code, rows = codec(path), []
        for t in texts:
            ids = code.encode(t or "")
            names = code.text_of
            decoded = code.lib.decode(ids) if ids else ""
            rows.append((len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    small_batches(docs.sparkSession)
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    keep = [c for c in docs.columns if c not in names]
    done = docs.select(*keep, round_trip(F.col("text"), path).alias("__piece"))
    return done.select(*keep, *(F.col("__piece")[n].alias(n) for n in names))
