import random

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    passage = " ".join(rng.choices(words, k=120))
    clean = [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    texts = clean + clean[:3] + ["short one", "the same words " * 100, None] + [clean[4][:500] + " " + passage, clean[5][:400] + " " + passage]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        kept.append(docs.collect())
        assert docs.columns == columns or name == "bpe encoding"
    assert {r.doc_id for r in kept[0]} == set(range(23)) | {26, 27}
    assert {r.doc_id for r in kept[1]} == set(range(20)) | {26, 27}
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1]} and not any(passage[:450] in r.text for r in kept[2])
    assert all(r.n_chars == len(r.text) for r in kept[2])
    assert {r.doc_id for r in kept[3]} <= {r.doc_id for r in kept[2]} and len(kept[4]) == len(kept[3])
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
