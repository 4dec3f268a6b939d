"""Loaders on small folders, and the fingerprint of one."""

import json
import os

import pytest

from veridag.operators import store
from veridag.plans import registry, staging


def put(folder, name, record):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(record if isinstance(record, str) else json.dumps(record, indent=1))


def test_papers(spark, tmp_path):
    put(tmp_path, "Roe2001Auto.json", {"title": "T", "year": 2001, "pass": 2, "tags": ["x"], "authors": [{"name": "Roe, A", "position": "first", "corresponding": True}, {"name": "Doe, B"}], "questions": [{"id": "q1"}], "claims": [{"id": "c1", "grounded_in": ["m1"], "floor": True}, {"id": "c2"}], "methods": [{"id": "m1"}], "odd": 1})
    put(tmp_path, "Doe2002.json", {})
    papers = store.load_papers(spark, str(tmp_path))
    got = {r["ck"]: r for r in papers.collect()}
    assert set(got) == {"Roe2001Auto", "Doe2002"} and got["Doe2002"]["type"] == "original" and got["Doe2002"]["title"] == "" and got["Doe2002"]["tags"] == []
    assert [(a["position"], a["corresponding"]) for a in got["Roe2001Auto"]["authors"]] == [("first", True), ("middle", False)]
    assert [(r["ck"], r["id"], r["kind"]) for r in store.flat_slices(papers).orderBy("ck", "ord").collect()] == [("Roe2001Auto", i, k) for i, k in (("c1", "claim"), ("c2", "claim"), ("q1", "question"), ("m1", "method"))]


def test_a_paper_with_tests_is_refused(spark, tmp_path):
    put(tmp_path, "Roe2001.json", {"tests": [{"id": "t1"}]})
    with pytest.raises(Exception, match="Roe2001: tests and capabilities belong to an aim"):
        store.load_papers(spark, str(tmp_path)).collect()


def test_aims(spark, tmp_path):
    put(tmp_path, "one.json", {"title": "One", "tests": [{"id": "t1", "discriminates": ["c1", "c2"]}], "claims": [{"id": "c1"}]})
    put(tmp_path, "@two.json", {"capabilities": [{"id": "k1"}]})
    assert {(r["ck"], r["id"], r["kind"]) for r in store.flat_slices(store.load_aims(spark, str(tmp_path))).collect()} == {("@one", "c1", "claim"), ("@one", "t1", "test"), ("@two", "k1", "capability")}


def test_stubs(spark, tmp_path):
    put(tmp_path, "stubs.json", {"Roe2001": {"title": "T", "year": 2001, "authors": ["A Roe"]}, "Doe": {}})
    got = {r["ck"]: (r["title"], r["type"], r["year"], [a["name"] for a in r["authors"]]) for r in store.load_stubs(spark, str(tmp_path / "stubs.json")).collect()}
    assert got == {"Roe2001": ("T", "original", 2001, ["A Roe"]), "Doe": ("", "original", None, [])}


def test_broad(spark, tmp_path):
    put(tmp_path / "claims", "big.json", {"title": "Big", "leads_to": ["bigger"]})
    put(tmp_path / "questions", "why.json", {"text": "Why?"})
    put(tmp_path / "methods", "how.json", {})
    got = {(r["slug"], r["kind"], r["title"], r["text"], tuple(r["leads_to"])) for r in store.load_broad(spark, str(tmp_path)).collect()}
    assert got == {("big", "broad claim", "Big", "", ("bigger",)), ("why", "broad question", "", "Why?", ()), ("how", "broad method", "", "", ())}


def test_topics(spark, tmp_path):
    put(tmp_path, "topics.json", '{"slug": "a", "keywords": ["x", "y"], "broader": ["b"]}\n{"slug": "b"}\n')
    assert {(r["slug"], tuple(r["keywords"] or ())) for r in store.load_topics(spark, str(tmp_path / "topics.json")).collect()} == {("a", ("x", "y")), ("b", ())}
    none = store.load_topics(spark, str(tmp_path / "none.json"))
    assert none.columns[0] == "slug" and none.count() == 0


def test_dumps(spark, tmp_path):
    put(tmp_path, "oa.json", json.dumps({"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/A", "display_name": "T", "publication_year": 2001, "authorships": [{"author": {"display_name": "Ann Roe"}, "is_corresponding": True}], "primary_location": {"source": {"display_name": "J"}}, "referenced_works": ["https://openalex.org/W2"]}))
    r = store.load_openalex(spark, str(tmp_path / "oa.json")).first()
    assert (r["id"], r["doi"], r["title"], r["venue"], r["authors"][0]["name"], r["referenced_works"]) == ("W1", "10.1/a", "T", "J", "Ann Roe", ["W2"])
    put(tmp_path, "cr.json", json.dumps({"DOI": "10.1/B", "title": [], "container-title": ["J"], "issued": {"date-parts": [[None]]}, "published-online": {"date-parts": [[2003, 1]]}, "author": [{"family": "Roe", "given": "Ann"}, {"family": "Team"}], "reference": [{"DOI": "https://doi.org/10.1/C"}, {"key": "x"}], "abstract": "<jats:title>Abstract</jats:title><jats:p>It is  so.</jats:p>"}))
    r = store.load_crossref(spark, str(tmp_path / "cr.json")).first()
    assert (r["doi"], r["title"], r["venue"], r["year"], r["authors"], r["referenced_dois"], r["abstract"]) == ("10.1/b", "J", "J", 2003, ["Ann Roe", "Team"], ["10.1/c"], "It is so.")


def test_fingerprint(spark, tmp_path):
    put(tmp_path / "a", "1.json", "12345")
    put(tmp_path / "b", "2.json", "678")
    r = staging.fingerprint(spark, str(tmp_path)).first()
    newest = max(os.stat(tmp_path / p).st_mtime for p in ("a/1.json", "b/2.json"))
    assert (r["files"], r["bytes"]) == (2, 8) and abs(r["newest"].timestamp() - newest) < 1


def test_a_changed_folder_gets_a_new_library(spark, tmp_path):
    """New rows are seen, and the old library's stored tables are gone."""
    path = f"{tmp_path}/numbers.parquet"
    spark.range(3).write.parquet(path)
    one = registry.library(spark, str(tmp_path))
    kept = staging.shared(one, "kept", lambda: one.given("numbers"))
    assert registry.library(spark, str(tmp_path)) is one and kept.count() == 3
    spark.range(5).write.mode("append").parquet(path)
    two = registry.library(spark, str(tmp_path))
    assert two is not one and staging.shared(two, "kept", lambda: two.given("numbers")).count() == 8
    assert not os.path.exists(kept._staged_at.removeprefix("file://"))
