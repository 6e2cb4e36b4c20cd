"""The corpus operators through Spark: brute force on small tables, nulls, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from tracefold.llm import fingerprints, jaccard_join, pii, piece_codec, quality_rules, secret_scan, source_mix, token_binary, token_count, toxicity  # noqa: E402
from tracefold.llm.common import shared_dir  # noqa: E402

BPE, PIECES = str(tokenizers.path("byte_bpe_50k.json")), str(tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, pattern string"


def word(r):
    return "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))


def rows():
    r = random.Random(9)
    base = [" ".join(word(r) for _ in range(r.choice([3, 30, 90, 200]))) for _ in range(60)]
    out = list(base)
    for t in base[:25]:  # near copies of several degrees, and exact ones
        for _ in range(r.randint(1, 4)):
            w = t.split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = word(r)
            out.append(" ".join(w))
    out += ["", " \n\t", "A b\tC", "a B c", "one", "x " * 3000, "line one\nline one\n\nline two " + "a b c d e f " * 30]
    table = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t), 1.0, 5, "p") for i, t in enumerate(out)]
    return [*table, (len(out), None, None, None, None, None, None, None), table[0], table[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    lib, at, want = Tokenizer.from_file(BPE), 0, []
    for i, t in sorted((r[0], r[1] or "") for r in rows()):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    manifest = token_binary.write_token_files(docs, BPE, shared_dir(spark, "t"))
    assert sorted(map(tuple, token_binary.read_token_files(spark, manifest).collect())) == sorted(want)
    assert len(token_binary.token_slice(manifest, 0, at)) == at and token_binary.token_slice(manifest, 5, 9).tolist() == token_binary.token_slice(manifest, 0, at)[5:9].tolist()
    assert token_binary.read_token_files(spark, token_binary.write_token_files(none, BPE, shared_dir(spark, "t"))).count() == 0


def components(table):
    sets = {}
    for i, t in table:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_null_ids_link_like_others(spark):
    text = " ".join(f"w{k}" for k in range(60))
    table = [(None, text), (None, text + " more"), (5, text + " x"), (3, "quite another text of some words here"), (None, "alone with no id at all here"), (None, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(table, "doc_id long, text string")).collect()
    want = [(None, 56, 5, 2), (None, 57, 5, 2), (5, 57, 5, 2), (3, 3, 3, 0), (None, 3, None, 0), (None, 0, None, 0)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    kept = jaccard_join.without_near_duplicates(spark.createDataFrame([(*r, "a", 1) for r in table], "doc_id long, text string, node string, key int")).collect()
    assert collections.Counter(tuple(r)[:2] for r in kept) == collections.Counter(table[2:])


def test_blocks_are_merged_and_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 12)
    monkeypatch.setattr(jaccard_join, "MANY", 2)
    r = random.Random(11)
    base, table = [word(r) for _ in range(130)], []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word(r)
        table.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_links) for x in got) == sorted(links_of(table)) and {x.doc_id: (x.n_shingles, x.component_id) for x in got} == components(table)


def test_jaccard_components(docs, none):
    want = components([(r[0], r[1]) for r in rows()])
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows()) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert set(ids) == {i for i, (n, c) in want.items() if n == 0 or c == i} and max(ids.values()) == 1


def links_of(table):
    """Per row the number of other rows that are similar enough, by comparing all pairs."""
    words = [t.encode().lower().split() for _, t in table]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    close = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    return [(table[k][0], sum(bool(close(a, b)) for j, b in enumerate(sets) if j != k)) for k, a in enumerate(sets)]


def test_every_link_is_counted(spark):
    r = random.Random(8)
    table = []
    for base in ([word(r) for _ in range(n)] for n in (100, 40, 24, 15)):
        for _ in range(40):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                w[r.randrange(len(w))] = word(r)
            table += [" ".join(w)] * r.choice([1, 1, 3])
    table = [(k // 2, t) for k, t in enumerate([*table, "", "alone here"])]
    got = jaccard_join.jaccard_components(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_links) for x in got) == sorted(links_of(table))


def test_unlinked_texts_of_one_doc_id_both_stay(spark):
    table = [(1, "one two three four five six"), (1, "other words of quite another kind here"), (2, "one two three four five six"), (1, "one two three four five six")]
    kept = jaccard_join.without_near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted(table[:2])


def test_one_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [word(r) for _ in range(120)]
    table = []
    for i in range(250):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word(r)
        table.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == components(table)


def test_token_files_keep_odd_ids(spark):
    table = [(None, "a null id"), (-(2**63), "the least id"), (None, "b"), (2**63 - 1, "x " * 5000), (0, None)]
    manifest = token_binary.write_token_files(spark.createDataFrame(table, "doc_id long, text string"), BPE, shared_dir(spark, "t"))
    got = token_binary.read_token_files(spark, manifest).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in table)
    at = sorted((r.start, r.n_tokens) for r in got)
    assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1]] and at[-1][0] == next(r.start for r in got if r.doc_id == 2**63 - 1)


def test_fingerprints(docs, none):
    got = fingerprints.fingerprint_documents(docs).collect()
    table = sorted((r[0], r[1] or "") for r in rows())
    edited = collections.Counter()
    for k, (i, t) in enumerate(table):
        n = len(t) // 2
        edited[(i, len(t), hashlib.sha256((t[: len(t) - n] + table[(k + 1) % len(table)][1][:n]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[dict(table)[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_fingerprints_meet_exact_successors(spark):
    """Ids that doubles can't hold, negative ones, many nulls and equal ids, repeated rows: every row, and its successor."""
    r = random.Random(3)
    table = [(2**60 + k, word(r) + " " + word(r)) for k in range(300)] + [(-(2**60) - k, word(r) * 3) for k in range(50)]
    table += [(None, word(r) + str(k)) for k in range(120)] + [(7, word(r) + str(k)) for k in range(120)] + [(7, "same again")] * 30 + [(None, None)] * 20
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(7)
    got = fingerprints.fingerprint_documents(frame).collect()
    assert len(got) == len(table)
    code = {r.text: r.h for r in frame.selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(((i is not None, i or 0, code[t or ""], t or "") for i, t in table))
    want = collections.Counter()
    for k, (known, i, _, t) in enumerate(order):
        n, after = len(t) // 2, order[(k + 1) % len(order)][3]
        want[(i if known else None, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())] += 1
    assert collections.Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in got) == want


def test_collision_rate_is_generalised_jaccard():
    r = random.Random(8)
    a = [" ".join(word(r) for _ in range(150)) for _ in range(80)]
    b = [" ".join(t.split()[: r.randint(20, 150)]) + " " + word(r) for t in a]

    def terms(t):
        w, c = t.encode().split(), collections.Counter()
        for x, y in zip(w, w[1:], strict=False):
            c[x, y] += len(x) + len(y)
        return c

    exact = [sum((terms(x) & terms(y)).values()) / sum((terms(x) | terms(y)).values()) for x, y in zip(a, b, strict=True)]
    seen = fingerprints.likeness(fingerprints.signatures(a), fingerprints.signatures(b))
    assert abs(np.mean(seen - exact)) < 0.02 and np.sqrt(np.mean((seen - exact) ** 2)) < 0.08


def test_toxicity(spark, docs, none):
    r = random.Random(1)
    clean = [(1000 + k, " ".join(word(r) for _ in range(30))) for k in range(120)]
    bad = [(2000 + k, " ".join(word(r) for _ in range(20)) + " grumblefex splonkwit") for k in range(60)]
    table = spark.createDataFrame([(i, t, "x") for i, t in clean + bad], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i >= 2000)) for i, _ in clean + bad] + [(None, 1), (7, None)], "doc_id long, toxic int")
    held = toxicity.held_out
    from pyspark.sql import functions as F

    model = toxicity.fit(table, labels, ~held(F.col("doc_id")))
    got = toxicity.score_documents(table, model).collect()
    assert all((x.score >= 0.5) == (x.doc_id >= 2000) for x in got)
    assert toxicity.score_documents(docs, model).count() == len(rows()) and toxicity.score_documents(none, model).count() == 0
    assert {x.h for x in table.select((held(F.col("doc_id")) == (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).alias("h")).collect()} == {True}


def test_piece_codec_and_counts(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_codec.piece_digests(docs, PIECES)
    assert set(docs.columns) < set(got.columns)
    for r in got.collect():
        ids = lib.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert piece_codec.piece_digests(none, PIECES).count() == 0 and token_count.token_counts(none, PIECES).count() == 0
    assert all((r.n_tokens > 0) == bool(dict((x[0], x[1]) for x in rows())[r.doc_id]) for r in token_count.token_counts(docs, PIECES).collect())


def test_secrets(spark, none):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, "password=84b3aeb8a0a875c8bd ok", "a", 9), (2, None, "b", None), (3, "nothing here", None, 12)], "doc_id long, text string, source string, n_chars long")
    assert {r.scan: r.n for r in secret_scan.scan_documents(table.select("doc_id", "text", "source").withColumnRenamed("source", "__scan"), name="n").select("__scan", F.col("n.n_secrets").alias("n")).toDF("scan", "n").collect()} == {"a": 1, "b": 0, None: 0}
    got = {r.doc_id: r for r in secret_scan.mask_secrets(table).collect()}
    assert got[1].text == "password=[SECRET] ok" and got[1].n_chars == len(got[1].text) and got[2].text is None and got[3].text == "nothing here" and got[3].n_chars == 12
    assert secret_scan.scan_documents(none).count() == 0


def test_quality_measures_against_definitions(docs, none):
    got = quality_rules.judge_quality(docs).collect()
    assert len(got) == len(rows())
    table = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        t = table[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, cover = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(none).count() == 0


def test_mix(docs, none):
    got = source_mix.mix_sources(docs)[0].collect()
    again = source_mix.mix_sources(docs)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows())
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len((r[1] or "").split())
    want = source_mix.target_sizes(dict(sizes))
    assert {r.target for r in got} == set(want.values()) and all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    by, source = collections.Counter(), {r[0]: r[3] for r in rows()}
    for r in got:
        by[source[r.doc_id]] += r.taken
    assert all(abs(by[k] - t) <= max(x.size for x in got) for k, t in want.items())
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken // r.size for r in got if r.size)
    assert source_mix.mix_sources(none)[0].count() == 0


def test_personal_data(spark, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0

    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in v.split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)

    r = random.Random(4)
    table = ["".join(r.choice("0123456789..@@--  ()+abAB_%\n😀é") for _ in range(r.randint(0, 80))) for _ in range(800)]
    table += ["a@" + "b." * 800 + "c", "x a@" + "b." * 30000 + ". y@z", "a@b..c a@-.- a@b.\n", "a@b.c_x@y.z", "card 4539 1488 0343 6467.", "001.002.003.0004 256.1.1.1 1.2.3.4.5.6.7.8", "+1 (414) 555-7134", "1 " * 20000, "9" * 20000, None, "", "my phone: 414-555-7134", "+" + "1" * 20000]
    got = {x.doc_id: x for x in pii.find_personal_data(spark.createDataFrame(list(enumerate(table)), "doc_id long, text string")).collect()}
    for i, t in enumerate(table):
        base = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if ok(k, m.group()))
        names = [f"{k}:{s}:{e}" for s, _, k, e in base]
        assert got[i].base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(got[i].spans.split(",")) | {""}
    assert "phone_local" in got[len(table) - 2].spans
    assert pii.find_personal_data(none).count() == 0


def test_shuffle_files_go_with_their_table(spark):
    import time

    from tracefold.llm.common import Scratch

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in str(blocks.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    before, scratch = files(), Scratch(spark, "test")
    rows = scratch.table(spark.range(10_000).repartition(3, "id"), "rows")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and rows.count() == 10_000
    scratch.drop("rows")
