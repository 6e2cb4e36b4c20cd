"""64-bit hashes of words and word shingles for many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        have = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 2 * len(have)), base, np.uint64))])
        if len(have) <= 1 << 24:
            _powers[kind] = have
    return have[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, bytes) of each word, in order. A-Z count as a-z; words end at ASCII white space."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b" ".join([*raw, b""]) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _power("up", _STEP, len(data)))])
    h = mix((run[ends] - run[starts]) * _power("down", _BACK, len(data))[starts] + (ends - starts).astype(np.uint64))
    of = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return h, of, ends - starts


def shingles(h: np.ndarray, of: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``width`` words; a shorter text's whole sequence is one."""
    if not len(h):
        return h, of
    counts = np.bincount(of, minlength=n_texts)
    out, owner = [], []
    n = len(h) - width + 1
    if n > 0:
        full = of[:n] == of[width - 1 :]
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s += h[k : n + k] * _PLACES[k]
        out.append(mix(s[full]))
        owner.append(of[:n][full])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for size in range(1, width):
        texts = np.flatnonzero(counts == size)
        if len(texts):
            s = np.full(len(texts), np.uint64(size) * _PLACES[15], np.uint64)
            for k in range(size):
                s += h[first[texts] + k] * _PLACES[k]
            out.append(mix(s))
            owner.append(texts)
    return np.concatenate(out) if out else h[:0], np.concatenate(owner) if owner else of[:0]


def distinct(s: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, times), sorted by text and hash."""
    if not len(s):
        return s, of, of
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])])
    at = np.flatnonzero(new)
    return s[at], of[at], np.diff(np.concatenate([at, [len(s)]]))
