"""The pipeline's stages on a small table."""

import random

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    texts = [" ".join(word() for _ in range(40)) for _ in range(90)]
    texts += [texts[0], texts[1] + " more"] + [" ".join(word() for _ in range(20)) + " grumblefex" for _ in range(40)] + [texts[2] + " password=84b3aeb8a0a875c8bd " + texts[3]]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(92 <= i < 132)) for i in range(len(texts))], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = p.drop_toxic(spark, docs, str(tmp_path))
    ids = {x.doc_id for x in clean.select("doc_id").collect()}
    assert clean.columns == docs.columns and ids == set(range(92)) | {132}
    apart = p.drop_near_duplicates(spark, clean, str(tmp_path))
    assert {x.doc_id for x in apart.select("doc_id").collect()} == set(range(90)) | {132}
    masked = {x.doc_id: x.text for x in p.drop_secrets(spark, apart, str(tmp_path)).collect()}
    assert "[SECRET]" in masked[132] and masked[5] == texts[5]
    out = p.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {x.doc_id for x in out.collect()} <= set(masked)
    assert [n for n, _ in p.STAGES] and p.ORACLE_SQL is None
