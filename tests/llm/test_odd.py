"""Every operator and stage on empty tables, null ids, repeated rows, very long texts, ties and clashing names."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from veridag.llm import lines, pages, secrets, shingles, suffixes, tokens, toxicity, vectors

corpus_pipeline = pytest.importorskip("corpus_pipeline")
MULTI, BPE, JSON = (P.path(f"byte_bpe_{n}") for n in ("multi_50k.tiktoken", "50k.tiktoken", "50k.json"))
CLASH = ["__id", "__key", "__drop", "__spans", "__out", "n_lines", "n_tokens", "score", "component_id", "token", "key", "n"]
SMALL = 1 << 20


def marks(df):
    return df.select("doc_id", F.lit(0).alias("toxic"))


TEXT_OPERATORS = {
    "op1": lambda d: suffixes.remove_repeats(d, bits=SMALL),
    "op3": lambda d: secrets.secret_spans(d),
    "op4": lambda d: lines.dedup_lines(d, bits=SMALL),
    "op5": lambda d: toxicity.score_toxicity(d, marks(d)),
    "op7": lambda d: tokens.bpe_round_trip(d, MULTI),
    "op8": lambda d: shingles.jaccard_components(d, bits=SMALL),
    "op9": lambda d: tokens.pack(d, BPE, JSON),
}


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


WORDS = " ".join(f"word{i}" for i in range(40))
ROWS = [(1, WORDS, "en", "s", 1), (1, WORDS, "en", "s", 1), (None, WORDS, "en", "s", 1), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, WORDS + " end", "en", "s", 9), (5, "long " * 250_000, "en", "s", 9)]


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_odd_rows(spark, name):
    """A result for each row: repeated rows and null ids too."""
    got = TEXT_OPERATORS[name](documents(spark, ROWS)).collect()
    ids = [r["doc_id"] for r in got]
    if name == "op9":
        assert {(i, ids.count(i) > 0) for i in (1, 2, 3, 4, 5, None)} == {(i, True) for i in (1, 2, 3, 4, 5, None)}
    else:
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS), ids


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_no_rows(spark, name):
    assert TEXT_OPERATORS[name](documents(spark, [])).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert pages.extract_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x", "x"), (1, None, None, "x", "x"), (None, "http://a/b", "<p>One two.</p>", "x", "x"), (2, "no url", "", "x", "x"), (3, "http://a/c", "<p>same line here</p>" * 20_000, "x", "x"), (4, "http://a/d", "<p>same line here</p>" * 20_000, "x", "x")]
    assert pages.extract_text(spark.createDataFrame(rows, schema)).count() == len(rows)


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, n_links string, score string"
    none = spark.createDataFrame([], schema)
    of = lambda df: df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    assert vectors.cosine_links(none).count() == 0 and vectors.nearest(none, of(none)).count() == 0
    rows = [(i, [1.0, 2.0], 1, "x", "x") for i in (1, 2, 3)] + [(4, None, 1, "x", "x"), (5, [0.0, 0.0], 1, "x", "x"), (6, [float("nan"), 1.0], 1, "x", "x"), (7, [1.0, 2.0], None, "x", "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.cosine_links(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7)}
    near = [(r["query_id"], r["rank"], r["vec_id"]) for r in vectors.nearest(df, of(df.where("vec_id = 1"))).orderBy("rank").collect()]
    assert near == [(1, 1, 2), (1, 2, 3), (1, 3, 7)]


@pytest.mark.parametrize("rows", [[], ROWS], ids=["none", "odd"])
def test_stages(spark, tmp_path, rows):
    """Stages take extra columns and give those of documents; of clean rows only near copies go."""
    docs = documents(spark, rows)
    marks(docs).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        n = out.count()
        if name == "packing":
            assert (n == 0) == (not rows)
        else:
            assert out.columns == corpus_pipeline.COLUMNS
            assert n == len(rows) - (name == "ngram_jaccard" and bool(rows)), name
