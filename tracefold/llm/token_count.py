"""Token counts (operator 9): count-only Viterbi over a unigram vocabulary.

The Aho-Corasick automaton enumerates, for each end position, the pieces that end there, longest first;
the dynamic programme carries only the best score and the piece count. Tie rule of the public unigram
tokenizers: starts are tried in ascending order and a later candidate must score strictly higher, so of
equal scores the longer last piece wins. A character without a piece of its own costs the lowest score
minus 10 and counts as its UTF-8 bytes where the vocabulary has byte pieces, else as one. Words are
scored apart, with doubles.

Defined cases: null and empty texts count 0 with score 0; repeated rows each get their row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import resident, small_batches
from tracefold.llm.piece_model import PieceModel

UNKNOWN_PENALTY = 10.0
KEEP_CHARS, KEEP_WORDS = 32, 500_000


class UnigramCounter:
    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.found = self.model.automaton(lambda p: (len(p), self.model.score[p]))
        self.unknown = min(self.model.score.values()) - UNKNOWN_PENALTY
        self.kept: dict[str, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """Pieces on the best path through ``word``, and its score."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        single = [False] * n
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.found.iter(word):
            ends[end].append(match)
            if match[0] == 1:
                single[end] = True
        for end in range(n):
            top, of = None, 0
            for length, score in ends[end]:
                start = end + 1 - length
                total = best[start] + score
                if top is None or total > top:
                    top, of = total, pieces[start] + 1
            if not single[end]:
                total = best[end] + self.unknown
                if top is None or total > top:
                    top, of = total, pieces[end] + len(self.model.other(word[end]))
            best[end + 1], pieces[end + 1] = top, of
        return pieces[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        if len(self.kept) > KEEP_WORDS:
            self.kept.clear()
        tokens, score = 0, 0.0
        for word in self.model.words(self.model.lib.normalize(text)) if text else []:
            got = self.kept.get(word)
            if got is None:
                got = self.count(word)
                if len(word) <= KEEP_CHARS:
                    self.kept[word] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


def counter(path: str) -> UnigramCounter:
    return resident(("token_count", path), lambda: UnigramCounter(path))


def token_count(text: Column, path: str) -> Column:
    """STRUCT<n_tokens, score> of each text."""

    @F.pandas_udf("n_tokens long, score double")
    def counted(texts: pd.Series) -> pd.DataFrame:
        c = counter(path)
        return pd.DataFrame([c.text(t or "") for t in texts], columns=["n_tokens", "score"])

    return counted(text)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and score of each whole text."""
    small_batches(docs.sparkSession)
    done = docs.select("doc_id", token_count(F.col("text"), path).alias("__count"))
    return done.select("doc_id", F.col("__count.n_tokens").alias("n_tokens"), F.col("__count.score").alias("score"))
