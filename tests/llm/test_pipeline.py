"""The pipeline's stages on a small table."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    common = "this line is common to very many documents of the set"
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{text} tail{i % 2}\n{common}\nown words number{i} " + " ".join(f"u{i}x{k}" for k in range(40 * (i % 3))), "en", "s", 9) for i in range(8)]
    rows += [(20, 'token = "abcdefgh12"', "en", "s", 20), (21, None, None, None, None), (22, "you idiot moron " * 5, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(22, 0, 1), (0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        held = {r["doc_id"]: r for r in docs.collect()} if i < 4 else docs.collect()
        if name == "line_dedup":
            assert sum(common in (r["text"] or "") for r in held.values()) == 1
        if name == "secret_scan":
            assert "[SECRET]" in held[20]["text"]
    assert len({r["doc_id"] for r in held}) >= 3
