"""What round 3's findings found."""

import random
import re
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridag.operators import bibliography, programme, text, validate
from veridag.plans import catalogue
from veridag.plans.fixpoint import simple_cycles
from veridag.sources.testbed import Library


def test_phrase_postings_come_few_pages_at_a_time():
    """however many pages a batch has, postings are held for a few of them."""
    words = [["ab-c", "de"], ["", "xyz"], ["q"]]
    pages = [{"ck": "k", "page": i, "t": words[i % 3], "lines": [i, i]} for i in range(100)]
    schema = pa.schema([("ck", pa.string()), ("page", pa.int32()), ("t", pa.list_(pa.string())), ("lines", pa.list_(pa.int32()))])
    out = list(text.page_postings(iter([pa.RecordBatch.from_pylist(pages, schema)])))
    assert len(out) == 7 and all(len(set(b.column("page").to_pylist())) <= text.AT_ONCE for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["starts"] for r in rows if r["page"] == 0 and r["starts"]] == [[0, 3, 5]]
    assert {r["gram"]: r["at"] for r in rows if r["page"] == 0 and r["gram"]} == {"abc": [0], "bcd": [1], "cde": [2], "de": [3], "e": [4]}
    assert sum(r["starts"] is not None for r in rows) == 100


def test_no_pattern_is_compiled_for_a_name(monkeypatch):
    """the signs behind names are those that a pattern for each name finds, and no pattern is made for any."""
    rng = random.Random(3)
    pages = ["".join(rng.choice(["Ab", "A", "é", "1", "2,", "*", "†", " ", "\n", "("]) for _ in range(60)) for _ in range(300)]
    names = ["A", "Ab", "Aé", "é", "", "(", "AbA"]
    want = [{n: {c for m in re.finditer(rf"{re.escape(unicodedata.normalize('NFC', n))}[0-9][0-9,]*([{text.SIGNS}]*)", unicodedata.normalize("NFC", p)) for c in m[1]} for n in names} for p in pages]
    text.author_markers("x*For correspondence", ["x"])
    made = []
    monkeypatch.setattr(re._compiler, "compile", lambda *a: made.append(a))
    assert [{n: text.signs_behind(unicodedata.normalize("NFC", p), n) for n in names} for p in pages] == want
    text.author_markers("Ana Xy1*\n*For correspondence: x", [f"Name{i}" for i in range(2000)])
    assert not made


def test_fused_words_next_to_other_letters(spark):
    """F8: a letter beyond ASCII is part of a word in the SQL too."""
    rows = [(1, "schönbeenscheinheit and anactomyosinringthat"), (2, "é" + "q" * 26), (3, "x" * 30 + "é"), (4, "_" + "q" * 26 + " wordswiththatinthem2 " + "z" * 27)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = {1: "anactomyosinringthat", 4: "z" * 27}
    assert dict(con.execute(catalogue.SQL["L9_fused_words"]).fetchall()) == want
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.array_join(text.artifacts(F.col("text")), ",").alias("f")).where("f <> ''")
    assert {r["doc_id"]: r["f"] for r in got.collect()} == want


@pytest.mark.parametrize("name", ["M11_disambiguated", "M17_keys_kept"])
def test_suffixes_of_many_letters_in_sql(spark, name):
    """the SQL's suffixes have as many letters as the operator's."""
    assert bibliography.SUFFIX_SQL in catalogue.SQL[name]
    firsts = [(26 ** (i + 1) - 1) // 25 for i in range(bibliography.LETTERS)]
    slots = sorted({0, 2, 64000, 12345678901} | {f + d for f in firsts for d in (-1, 0, 1, 25, 26) if f + d >= 0})
    want = {r["k"]: r["s"] for r in spark.createDataFrame([(k,) for k in slots], "k long").select("k", bibliography.suffix(F.col("k")).alias("s")).collect()}
    con = duckdb.connect()
    con.execute("create table t(k bigint)")
    con.executemany("insert into t values (?)", [(k,) for k in slots])
    assert dict(con.execute(f"select k, {bibliography.SUFFIX_SQL} from t").fetchall()) == want and want[18279] == "aaaa"


def loops(edges):
    out, paths = set(), [[a, b] for a, b in edges]
    while paths:
        out |= {tuple(p) for p in paths if p[0] == p[-1]}
        paths = [[*p, b] for p in paths if p[0] != p[-1] for a, b in edges if a == p[-1] and (b == p[0] or b not in p)]
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_every_cycle_from_every_node(spark, seed):
    """Every simple cycle from each of its nodes, not one for a component."""
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range((3, 14, 22)[seed])}) if seed else [("a", "b"), ("b", "c")]
    got = [tuple(r["path"]) for r in simple_cycles(spark.createDataFrame(edges, "src string, dst string")).collect()]
    assert len(got) == len(set(got)) and set(got) == loops(edges)


def test_rules_give_every_cycle(spark):
    """Two cycles that share a node are two findings from it, and one from each other node."""
    steps = [("x", "y"), ("y", "x"), ("x", "z"), ("z", "x"), ("z", "z")]
    rows = validate.cycle_rows(spark.createDataFrame(steps, "src string, dst string"), "leads_to").collect()
    assert sorted((r["ck"], r["ref"]) for r in rows) == [("x", "x -> y -> x"), ("x", "x -> z -> x"), ("y", "y -> x -> y"), ("z", "z -> x -> z"), ("z", "z -> z")]


def test_rules_are_counted_one_by_one(spark):
    """the counts' plan reads stored counts alone, and a rule's joins aren't broadcast by a file's size."""
    lib = Library(spark, "/root/testdata/sf0.001")
    plan = validate.all_violations(lib)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    for rule in ("C4_dangling_refs", "C7_answers_target", "C19_narrative_refs"):
        assert "BroadcastHashJoin" not in validate.RULES[rule][0](lib.draft)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("table", ["tested", "solid", "aim_floors"])
def test_programme_tables_are_not_broadcast(spark, table):
    """joins with tables of slices merge, whatever a file's size promises."""
    plan = getattr(programme, table)(Library(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
