"""Toxicity (operator 4): subsequence string-kernel SVM with Nystroem landmarks, trained on labelled sentences.

Two words are alike by all their common subsequences of three characters, each weighed by DECAY to the
power of the stretch it spans in either word (normalised to 1 for equal words), so gaps and inserted characters
cost some likeness but don't break it. A word with other characters between its letters is also looked at without
them, and letters written apart ("a b c d") as the word they spell; words longer than WINDOW are looked at by
windows that overlap by half, all of them. Likenesses count from FLOOR up. A sentence's likeness to a landmark
is that of its likest word, to the power SHARP. The support vector machine is the Nystroem one: linear in
K(sentence, landmarks) with K(landmarks, landmarks) as the norm of its weights, none of them negative. A
document's score is the logistic calibration of the decision of its highest sentence.

Labels mark documents, so the sentences of toxic documents are bags: training begins with the sentence of
each that is most like words of toxic documents, and goes on with the one that the machine itself places
highest, until that doesn't change; all sentences of clean documents are negative. Landmarks are words far more
frequent in toxic than in clean documents, and each of those words by itself, whole and with a character
inserted, is a positive sentence too. Training takes, in order of a hash, at most MAX_LABELLED documents and MAX_CHARS characters of each label, in one task.

Defined cases: null and empty texts have no sentence with a known word and get the score of such texts;
without toxic and clean labelled documents every score is 0; a document that labels call both toxic and
clean is toxic, and of several texts under one doc_id training takes the least; repeated rows each get
their score; very long texts are scored whole; an empty table gives no rows; columns named as the
results are replaced, others are kept.
"""

from __future__ import annotations

import pickle
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import release, resident, small_batches, trim

#: At most so many labelled documents, and characters of them, of each label are trained on.
MAX_LABELLED, MAX_CHARS = 2000, 12_000_000
DECAY, FLOOR, WINDOW = 0.65, 0.35, 20
#: Power of a normalised likeness, weight of the norm against the loss.
SHARP, RIDGE, SEED = 1.5, 1e-3, 4
#: Landmarks, no two of which are more alike than that.
INSULTS, DIVERSE = 72, 0.85
LEAST_DOCS, LEAST_ODDS = 3, 3.0
#: Times that the sentences of toxic documents are chosen anew, and words whose kernel is taken at once.
ROUNDS, CHUNK = 4, 20_000
EDGE = ".,;:!?\"'()[]{}<>*#$%&|@+-_=/\\~`…«»¡¿„“”‚‘’"
#: Words that are kept, and marks of those met once.
KEEP_WORDS, SEEN = 250_000, 1 << 23
#: Sentences end at their marks and at line ends, but not after a single letter.
SENTENCE = re.compile(r"(?<=\S\S[.!?…])\s+|[\r\n]+")


def word_of(token: str) -> str:
    return token.strip(EDGE)


@lru_cache(64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all three characters, in order, in a word of ``n``; their weights."""
    at = np.array(list(combinations(range(n), 3)), np.int32).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def self_kernel(words: list[str]) -> np.ndarray:
    """Unnormalised kernel of each word with itself; all words must have the same length."""
    at, weight = triples(len(words[0]))
    codes = np.array([[ord(c) for c in w] for w in words], np.int64)
    key = (codes[:, at[:, 0]] << 42) | (codes[:, at[:, 1]] << 21) | codes[:, at[:, 2]]
    order = np.argsort(key, axis=1)
    key, w = np.take_along_axis(key, order, 1), weight[order].astype(float)
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] != key[:, :-1]
    starts = np.flatnonzero(new)
    square = np.add.reduceat(w.ravel(), starts) ** 2  # equal subsequences add up before they are squared
    return np.add.reduceat(square, np.searchsorted(starts, np.arange(len(words)) * key.shape[1]))


class Landmarks:
    """Explicit 3-subsequence features of the landmark words, for words by the batch."""

    def __init__(self, words: list[str]):
        self.words = words
        self.chars = {c: k + 1 for k, c in enumerate(sorted({c for w in words for c in w}))}
        self.base = len(self.chars) + 1
        found: dict[int, dict[int, float]] = {}
        for m, w in enumerate(words):
            codes = [self.chars[c] for c in w]
            for i, j, k in triples(len(w))[0].tolist():
                at = (codes[i] * self.base + codes[j]) * self.base + codes[k]
                own = found.setdefault(at, {})
                own[m] = own.get(m, 0.0) + DECAY ** (k - i + 1)
        self.slot = np.zeros(self.base**3, np.int32)
        self.weight = np.zeros((len(found) + 1, len(words)), np.float32)
        for n, (at, own) in enumerate(sorted(found.items())):
            self.slot[at] = n + 1
            for m, x in own.items():
                self.weight[n + 1, m] = x
        self.norm = np.sqrt([self_kernel([w])[0] for w in words]).astype(np.float32) if words else np.zeros(0, np.float32)
        #: The most that a subsequence adds to any landmark's likeness.
        self.peak = (self.weight / self.norm).max(axis=1) if words else np.zeros(1, np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Normalised kernel [word, landmark], 0 below FLOOR. A long word takes the greatest over its windows."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for k, w in enumerate(words):
            for at in range(0, max(1, len(w) - WINDOW + WINDOW // 2), WINDOW // 2) if len(w) > WINDOW else (0,):
                part = w[at : at + WINDOW]
                if len(part) >= 3:
                    by_length.setdefault(len(part), []).append((k, part))
        get = self.chars.get
        for n, parts in by_length.items():
            at, span = triples(n)
            step = max(1, 400_000 // len(at))
            for low in range(0, len(parts), step):
                some = parts[low : low + step]
                # characters of no landmark are 0, and no slot is set under a 0
                codes = np.array([[get(c, 0) for c in w] for _, w in some], np.int32)
                slot = self.slot[(codes[:, at[:, 0]] * self.base + codes[:, at[:, 1]]) * self.base + codes[:, at[:, 2]]]
                # repeated subsequences only raise a word's own norm: most words can't reach FLOOR
                least = FLOOR * np.sqrt((span**2).sum())
                able = np.flatnonzero(self.peak[slot] @ span >= 0.999 * least)
                slot = slot[able]
                word, triple = np.nonzero(slot)
                if not len(word):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                raw = np.add.reduceat(self.weight[slot[word, triple]] * span[triple][:, None], starts, axis=0) / self.norm
                reach = raw.max(axis=1) >= least
                hit, raw = able[word[starts][reach]], raw[reach]
                if not len(hit):
                    continue
                raw /= np.sqrt(self_kernel([some[h][1] for h in hit])).astype(np.float32)[:, None]
                raw[raw < FLOOR] = 0
                for h, row in zip(hit, raw, strict=True):
                    k = some[h][0]
                    np.maximum(out[k], row, out=out[k])
        return out


@dataclass
class ToxicityModel:
    landmarks: list[str]
    alpha: np.ndarray
    bias: float
    slope: float
    offset: float

    @property
    def trained(self) -> bool:
        return bool(self.landmarks)


def likenesses(marks: Landmarks, words: list[str]) -> np.ndarray:
    return marks.rows(words) ** SHARP


def kernel_rows(marks: Landmarks, tokens: list[str]) -> np.ndarray:
    """Kernel of each token, as written and without what isn't a letter or digit: the greater of both."""
    words = [word_of(t) for t in tokens]
    plain = [w if w.isalnum() else "".join(c for c in w if c.isalnum()) for w in words]
    rows = marks.rows(words)
    other = [k for k, (w, p) in enumerate(zip(words, plain, strict=True)) if w != p]
    if other:
        rows[other] = np.maximum(rows[other], marks.rows([plain[k] for k in other]))
    return rows


def tokens_of(text: str) -> list[str]:
    """Lower-cased words; three or more single characters in a row also count as the word they spell."""
    out = text.lower().split()
    run: list[str] = []
    spelled: list[str] = []
    if 1 in map(len, out):
        for t in [*out, "."]:
            w = word_of(t) if len(t) < 4 else t
            if len(w) == 1:
                run.append(w)
                continue
            if len(run) > 2:
                spelled += ["".join(run[at : at + WINDOW]) for at in range(0, len(run), WINDOW // 2)]
            run = []
    return out + spelled if spelled else out


class Sentences:
    """Kernel rows of sentences. A word's row is kept if it has any likeness; that it has none is kept once the word
    comes again, so that words met once, most of all that differ, don't fill the worker's memory."""

    def __init__(self, landmarks: list[str]):
        self.marks = Landmarks(landmarks)
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.met = bytearray(SEEN)
        self.store, self.used = np.zeros((1024, len(self.marks.words)), np.float32), 1

    def _learn(self, fresh: list[str]) -> None:
        for low in range(0, len(fresh), CHUNK):
            part = fresh[low : low + CHUNK]
            rows = kernel_rows(self.marks, part) ** SHARP
            alike = rows.any(axis=1)
            at = np.where(alike, self.used + np.cumsum(alike) - 1, 0)
            end = self.used + int(alike.sum())
            while end > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.store[self.used : end] = rows[alike]
            self.used = end
            for word, k in zip(part, at.tolist(), strict=True):
                mark = hash(word) & (SEEN - 1)
                if k or self.met[mark]:
                    self.kept[word] = k
                else:
                    self.met[mark] = 1

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[sentence, landmark] of the sentences with any likeness; the number of each one's text."""
        if len(self.kept) > KEEP_WORDS:
            self._forget()
        tokens, ends, text = [], [], []
        for k, t in enumerate(texts):
            for sentence in SENTENCE.split(t):
                if sentence:
                    tokens += tokens_of(sentence)
                    ends.append(len(tokens))
                    text.append(k)
        self._learn(list(set(tokens).difference(self.kept)))
        at = np.fromiter(map(self.kept.get, tokens, repeat(0)), np.int64, len(tokens))
        hit = np.flatnonzero(at)
        if not len(hit):
            return np.zeros((0, len(self.marks.words)), np.float32), np.zeros(0, np.int64)
        sentence = np.searchsorted(np.array(ends), hit, side="right")
        starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        return np.maximum.reduceat(self.store[at[hit]], starts, axis=0), np.array(text)[sentence[starts]]


class Scorer:
    """Scores whole texts."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.sentences = Sentences(model.landmarks)

    def decisions(self, texts: list[str]) -> np.ndarray:
        """The highest decision of any sentence, for each text."""
        rows, of = self.sentences.rows(texts)
        out = np.full(len(texts), self.model.bias)
        np.maximum.at(out, of, rows @ self.model.alpha + self.model.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model.trained:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-(self.model.slope * _squashed(self.decisions(texts)) + self.model.offset)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, kernel: np.ndarray, start: np.ndarray | None = None, steps: int = 1500) -> np.ndarray:
    """SVM with squared hinge loss over rows of likenesses to the landmarks, whose ``kernel`` is the norm; by projected
    gradient steps with restarted momentum. Weights are at least 0, so no word makes a sentence less toxic. The last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.zeros((x.shape[1], x.shape[1]))
    ridge[:-1, :-1] = RIDGE * kernel
    w = last = np.zeros(x.shape[1]) if start is None else start
    rate = 1 / (2 * np.linalg.norm((x * weight[:, None]).T @ x, 2) + np.linalg.norm(ridge, 2))
    for k in range(steps):
        at = k % 200
        look = w + (at / (at + 3)) * (w - last)
        gap = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (ridge @ look - 2 * x.T @ (weight * y * gap))
        new[:-1] = np.maximum(new[:-1], 0)
        last, w = w, new
    return w


def _squashed(x: np.ndarray) -> np.ndarray:
    """Decisions, in order, that grow by their logarithm beyond the margin."""
    return np.where(np.abs(x) <= 1, x, np.sign(x) * (1 + np.log(np.maximum(np.abs(x), 1))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the labels' odds, with prior-smoothed targets, by Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        w += np.clip(np.linalg.solve(h, z.T @ (weight * (target - p)) - 1e-4 * w), -5, 5)
    return float(w[0]), float(w[1])


def landmarks_of(texts: list[str], toxic: list[int]) -> tuple[list[str], list[str], np.ndarray]:
    """Landmarks; words far more frequent in toxic documents, by evidence, and the number of toxic documents of each."""
    pos, neg = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        (pos if label else neg).update({w for t in set(tokens_of(text)) if 3 <= len(w := word_of(t)) <= WINDOW})
    n_pos, n_neg = sum(toxic), len(toxic) - sum(toxic)
    odds = {w: np.log((a + 0.5) / (n_pos + 1)) - np.log((neg[w] + 0.5) / (n_neg + 1)) for w, a in pos.items() if a >= LEAST_DOCS}
    # documents times log odds: words of copied documents come along with little of it
    found = sorted((w for w in odds if odds[w] >= LEAST_ODDS), key=lambda w: (-pos[w] * odds[w], w))[: 6 * INSULTS]
    if not found:
        return [], [], np.zeros(0)
    top = pos[found[0]] * odds[found[0]]
    found = [w for w in found if pos[w] * odds[w] >= 0.02 * top]
    alike = Landmarks(found).rows(found)
    chosen: list[int] = []
    for k in range(len(found)):
        if len(chosen) < INSULTS and (not chosen or alike[k, chosen].max() < DIVERSE):
            chosen.append(k)
    return [found[k] for k in chosen], found, np.array([pos[w] for w in found], float)


def train(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Fit on the sentences of labelled texts."""
    y = np.array(toxic)
    none = ToxicityModel([], np.zeros(0, np.float32), 0.0, 1.0, 0.0)
    words, telling, times_telling = landmarks_of(texts, toxic) if (y == 1).any() and (y == 0).any() else ([], [], np.zeros(0))
    if not words:
        return none
    sentences = Sentences(words)
    parts = [(*sentences.rows(texts[low : low + 64]), low) for low in range(0, len(texts), 64)]
    raw, of = np.concatenate([p[0] for p in parts]).astype(np.float64), np.concatenate([p[1] + p[2] for p in parts])
    own = y[of] == 1
    # equal sentences of clean documents are one, with their number; a sentence like no landmark is another
    clean, times = np.unique(raw[~own], axis=0, return_counts=True) if (~own).any() else (raw[:0], np.zeros(0))
    bags, bag = raw[own], of[own]
    if not len(bags):
        return none
    # a telling word is a sentence too, as it stands and with a character inserted
    r = random.Random(SEED)
    inserted = [w[:k] + r.choice(string.ascii_lowercase) + w[k:] for w in telling for k in (r.randrange(1, len(w)),)]
    alone = likenesses(sentences.marks, telling + inserted).astype(np.float64)
    values, vectors = np.linalg.eigh(likenesses(sentences.marks, words).astype(np.float64))
    kernel = vectors @ np.diag(np.maximum(values, 1e-3)) @ vectors.T
    starts = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
    stops = np.concatenate([starts[1:], [len(bag)]])
    evidence = np.concatenate([times_telling, times_telling])
    value, w, before = bags.max(axis=1), None, None
    for _ in range(ROUNDS):
        chosen = np.array([a + int(np.argmax(value[a:b])) for a, b in zip(starts, stops, strict=True)])
        if before is not None and (chosen == before).all():
            break
        before = chosen
        x = np.concatenate([bags[chosen], alone, clean, np.zeros((1, len(words)))])
        label = np.concatenate([np.ones(len(chosen) + len(alone)), -np.ones(len(clean) + 1)])
        weight = np.concatenate([np.full(len(chosen), 0.25 / len(chosen)), 0.25 * evidence / evidence.sum(), 0.4 * times / max(1, times.sum()), [0.1]])
        w = _svm(x, label, weight, kernel, w)
        value = bags @ w[:-1] + w[-1]
    model = ToxicityModel(words, w[:-1].astype(np.float32), float(w[-1]), 1.0, 0.0)
    highest = np.full(len(texts), model.bias)
    np.maximum.at(highest, of, raw @ model.alpha + model.bias)
    # calibrated on documents, and for a fifth of the toxic ones' weight on the telling words alone
    x = np.concatenate([highest, alone @ model.alpha + model.bias])
    weight = np.concatenate([np.ones(len(y)), 0.2 * y.sum() * evidence / evidence.sum()])
    model.slope, model.offset = _logistic(_squashed(x), np.concatenate([y, np.ones(len(alone), int)]), weight)
    return model


def _train_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    texts, toxic, size = [], [], Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            size[label] += len(text)
            if size[label] <= MAX_CHARS:
                texts.append(text)
                toxic.append(label)
    model = pickle.dumps(train(texts, toxic))
    del texts
    trim()
    yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, train_where: Column | None = None) -> ToxicityModel:
    """Train on a bounded sample of the documents among ``labels`` (doc_id, toxic) that ``train_where`` admits."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    if train_where is not None:
        known = known.where(train_where)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = []
    for label in (1, 0):
        picked += known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()
    if not picked:
        return train([], [])
    # bounded: twice MAX_LABELLED ids, and as many texts in one task
    few = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    # one row: the model
    return pickle.loads(rows.mapInArrow(_train_once, "model binary").first().model)


def score_documents(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        key = sent.id if hasattr(sent, "id") else id(sent.value)
        scorer = resident(("toxicity", key), lambda: Scorer(sent.value))
        return pd.Series(scorer.scores([t or "" for t in texts]))

    return docs.select(*(c for c in docs.columns if c != name), score(F.col("text")).alias(name))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
