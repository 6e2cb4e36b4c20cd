"""Secret scans (operator 6): candidates by pattern, false positives removed by a random forest.

Candidates are values assigned to a telling name (password = ..., token: "..."), keys in the published
forms of some providers, private-key headers, and long runs of key characters that hold a digit. The
forest sees a candidate's length, alphabet, character transitions and entropy, how much of it common
letter pairs and words cover, whether it looks like a path, address, identifier or date, and the words
beside it. It is trained on labelled findings: kinds of true and false ones written as rules below and
filled from a seeded generator, since the tables have no labels for secrets.

Defined cases: null and empty texts have no candidates; overlapping secrets are one, from the
first's start to the last's end; values are taken whole, however long; whole texts are scanned; repeated
rows each get their row; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import release, small_batches, unused

SEED, FINDINGS, TREES, DEPTH, LEAST_LEAF, AT_LEAST = 11, 2400, 40, 9, 3, 0.5
MASK = "[SECRET]"
NEAR = 40
#: Values longer than any labelled finding are secrets if they or so many first characters look like one.
HEAD = {"assigned": 200, "form": 72}

NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?secret)"
ASSIGNED = re.compile(rf"(?i){NAMES}[\"']?\s{{0,3}}(?:[:=]|=>|:=)\s{{0,3}}[\"']?([^\s\"',;<>]{{6,}}+)")
#: Published forms of provider keys, and private-key headers.
FORMS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
RUN = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
TELLING = re.compile(rf"(?i){NAMES}|key|login|signin")
MISLEADING = re.compile(r"(?i)\b(?:commit|sha\d*|md5|digest|checksum|hash|uuid|guid|revision|etag|version|example|sample|dummy|placeholder|fake|test|id|isbn|order|invoice|phone|date|file|path|url)\b")
#: Common English words and letter pairs that readable identifiers are made of.
COMMON = ("the and for that with this you not are from have all your new user name value data test example file path home "
          "time date code list item index page main table default config service server client request response message "
          "error object string number change update delete create password secret token key admin root my key here insert").split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ie un der ung qu ue ci os".split()


def spans(text: str) -> list[tuple[int, int, str]]:
    """Candidate (start, end, kind), possibly overlapping."""
    out = [(m.start(), m.end(), "form") for m in FORMS.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(1), m.end(1), "assigned") for m in ASSIGNED.finditer(text)]
    for m in RUN.finditer(text):
        run = m.group().rstrip(".-=/")
        if any(c.isdigit() for c in run) and len(run) >= 16:
            out.append((m.start(), m.start() + len(run), "run"))
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    n = len(s)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    counts = {k: classes.count(k) for k in "dulo"}
    freq = np.array([s.count(c) for c in set(s)]) / n
    low = s.lower()
    covered = np.zeros(n, bool)
    for w in COMMON:
        if len(w) > 2 and w in low:
            for m in re.finditer(w, low):
                covered[m.start() : m.end()] = True
    letters = re.findall(r"[a-z]{2,}", low)
    pairs = [w[k : k + 2] for w in letters for k in range(len(w) - 1)]
    beside = (before[-24:] + " " + after[:12]).lower()
    return [
        n,
        counts["d"] / n,
        counts["u"] / n,
        counts["l"] / n,
        counts["o"] / n,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / max(1, n - 1),
        float(-(freq * np.log2(freq)).sum()),
        float(freq.max()),
        covered.mean(),
        sum(p in PAIRS for p in pairs) / max(1, len(pairs)),
        len(pairs) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", low))),
        float(s.count("/") + s.count(".")) / n,
        float("://" in before[-10:] or "www." in low or bool(re.search(r"\.(?:com|org|net|html?|py|js|json|txt|png|jpg|md)\b", low)) or before.endswith(("/", "@"))),
        float(bool(TELLING.search(beside))),
        float(bool(MISLEADING.search(beside))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(kind == "assigned"),
        float(kind == "form"),
        float(bool(re.fullmatch(r"[\d\W_]+", s))),
        float(len(set(low)) <= 4 or bool(re.search(r"(?:x{4}|\*{3}|0{6}|1234|\.\.\.|your|change|example|<|\$\{)", low))),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label): rules for kinds of findings, filled by a seeded generator."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: r.choice(COMMON) if r.random() < 0.5 else "".join(r.choice(PAIRS) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    name = lambda: r.choice(["password", "passwd", "token", "secret", "api_key", "API_KEY", "auth", "client_secret", "access_key", "apikey"])
    sep, quote = lambda: r.choice(["=", " = ", ": ", ":"]), lambda: r.choice(["", '"', "'"])
    mixed = lambda k: pick(alnum, k - 1) + r.choice(string.digits)

    def assigned(value: str) -> tuple[str, str]:
        q = quote()
        return f"{name()}{sep()}{q}", value

    true = [
        lambda: assigned(pick(hexes, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: assigned(mixed(r.randint(12, 44))),
        lambda: assigned(pick(alnum + "!@#%^&*", r.randint(8, 20)) + r.choice("0123456789")),
        lambda: ("", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)),
        lambda: (r.choice(["", "key ", "export KEY="]), "ghp_" + pick(alnum, 36)),
        lambda: ("", "sk_live_" + pick(alnum, 24)),
        lambda: ("", "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24)),
        lambda: ("", "AIza" + pick(alnum + "_-", 35)),
        lambda: ("", "-----BEGIN RSA PRIVATE KEY-----"),
        lambda: (r.choice(["token ", "secret ", "bearer ", "Authorization: Bearer "]), mixed(r.randint(24, 48))),
        lambda: (prose(1) + " ", mixed(40)),
    ]
    false = [
        lambda: (r.choice(["commit ", "revision ", "sha1 ", "sha256:", "md5 ", "checksum ", "digest "]), pick(hexes, r.choice([32, 40, 64]))),
        lambda: (r.choice(["", "id ", "uuid ", "request id: "]), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: assigned(r.choice(["changeme", "your-api-key", "xxxxxxxxxxxx", "example123", "<password>", "${TOKEN}", "********", "placeholder", "none123", "password1234", "null000"])),
        lambda: assigned("".join(word().title() for _ in range(r.randint(2, 4))) + r.choice(["", "()", "2"])),
        lambda: assigned(prose(1) + "." + prose(1)),
        lambda: ("", "/".join(word() for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 99)}.{r.choice(['html', 'py', 'txt', 'json'])}"),
        lambda: ("https://www.", f"{word()}.{r.choice(['com', 'org'])}/{word()}/{word()}-{r.randint(1, 9999)}"),
        lambda: ("", f"{word()}{word()}.{r.randint(10, 99)}@"[:-1] + word() + word() + word() + "1"),
        lambda: ("", pick(string.digits, r.randint(16, 24))),
        lambda: ("", f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}.{r.randint(0, 59):02}"),
        lambda: ("", "_".join(word() for _ in range(r.randint(3, 5))) + str(r.randint(1, 99))),
        lambda: ("", "".join(word().title() for _ in range(r.randint(3, 5))) + str(r.randint(1, 9))),
        lambda: ("", "-" * r.randint(10, 20) + str(r.randint(1, 9)) + "=" * r.randint(6, 20)),
        lambda: ("", ".".join(str(r.randint(0, 255)) for _ in range(r.randint(4, 6)))),
        lambda: ("version ", ".".join(str(r.randint(0, 40)) for _ in range(4)) + "-" + word() + "." + word()),
    ]
    out = []
    for k in range(n):
        label = k % 2
        before, value = r.choice(true if label else false)()
        text = f"{prose(r.randint(0, 6))} {before}"
        kind = "assigned" if ASSIGNED.search(text[-40:] + value) and re.search(r"[:=]\s*[\"']?$", before) else "form" if FORMS.fullmatch(value) else "run"
        out.append((text + value + r.choice(["", '"', "'", ".", ","]) + " " + prose(r.randint(0, 6)), len(text), len(text) + len(value), kind, label))
    return out


class Forest:
    """Trees of (feature, threshold, left, right, share of label 1), as arrays; scored level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, rng) for _ in range(TREES)]

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rng) -> tuple:
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list] = []

        def split(at: np.ndarray, depth: int) -> int:
            own = len(nodes)
            nodes.append([-1, 0.0, own, own, y[at].mean()])
            if depth == DEPTH or len(at) < 2 * LEAST_LEAF or y[at].min() == y[at].max():
                return own
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
                order = at[np.argsort(x[at, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                k = np.arange(1, len(order))
                cut = (v[1:] > v[:-1]) & (k >= LEAST_LEAF) & (len(order) - k >= LEAST_LEAF)
                if cut.any():
                    left, right = ones[:-1], ones[-1] - ones[:-1]
                    gini = np.where(cut, left * (1 - left / k) + right * (1 - right / (len(order) - k)), np.inf)
                    b = int(gini.argmin())
                    if gini[b] < best[0]:
                        best = (gini[b], f, (v[b] + v[b + 1]) / 2)
            if best[1] >= 0:
                go = x[at, best[1]] <= best[2]
                nodes[own][:2] = best[1:]
                nodes[own][2] = split(at[go], depth + 1)
                nodes[own][3] = split(at[~go], depth + 1)
            return own

        split(rows, 0)
        return tuple(np.array(c) for c in zip(*nodes, strict=True))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                down = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(down, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


@lru_cache(1)
def forest() -> Forest:
    found = labelled_findings()
    return Forest(np.array([features(*f[:4]) for f in found]), np.array([f[4] for f in found]))


def find_secrets(texts: list[str], at_least: float = AT_LEAST) -> tuple[list[int], list[list[tuple[int, int, float]]]]:
    """Candidates of each text, and its secrets as (start, end, probability) in order."""
    model, rows, seen, owner, long = forest(), [], [], [], []
    for k, t in enumerate(texts):
        for s in spans(t):
            rows.append((k, *s))
            owner.append(k)
            seen.append(features(t, *s))
            if s[1] - s[0] > HEAD.get(s[2], s[1]):
                long.append((len(rows) - 1, features(t, s[0], s[0] + HEAD[s[2]], s[2])))
    counts, out = [0] * len(texts), [[] for _ in texts]
    if rows:
        p = model.probability(np.array(seen))
        if long:
            at = [i for i, _ in long]
            p[at] = np.maximum(p[at], model.probability(np.array([f for _, f in long])))
        for i in np.lexsort(([r[1] for r in rows], owner)):
            k, start, end, _ = rows[i]
            counts[k] += 1
            if p[i] < at_least:
                continue
            if out[k] and start < out[k][-1][1]:
                a, b, q = out[k].pop()
                out[k].append((a, max(b, end), max(q, float(p[i]))))
            else:
                out[k].append((start, end, float(p[i])))
    return counts, out


def masked(text: str, found: list[tuple[int, int, float]]) -> str:
    parts, at = [], 0
    for start, end, _ in found:
        parts += [text[at:start], MASK]
        at = end
    return "".join([*parts, text[at:]])


def scan_documents(docs: DataFrame, with_text: bool = False, name: str = "scan") -> DataFrame:
    """``docs`` with a column ``name``: n_candidates, n_secrets, spans (start:end, comma-joined) and the masked text or its digest."""
    small_batches(docs.sparkSession)
    last = "clean" if with_text else "clean_sha256"

    @F.pandas_udf(f"n_candidates long, n_secrets long, spans string, {last} string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        release()
        whole = [t or "" for t in texts]
        counts, found = find_secrets(whole)
        clean = [masked(t, f) if f else t for t, f in zip(whole, found, strict=True)]
        return pd.DataFrame({
            "n_candidates": counts, "n_secrets": [len(f) for f in found], "spans": [",".join(f"{a}:{b}" for a, b, _ in f) for f in found],
            last: clean if with_text else [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in clean],
        })

    return docs.select(*(c for c in docs.columns if c != name), scan(F.col("text")).alias(name))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` (a null stays null), and ``n_chars``, where there is one, counted anew."""
    name = unused(docs, "scan")
    found = scan_documents(docs, True, name)
    text = F.when(F.col("text").isNotNull(), F.col(f"{name}.clean"))
    new = {"text": text} | ({"n_chars": F.when(F.col(f"{name}.n_secrets") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))
