"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from veridag.llm import variants


def near(words):
    """Pairs one edit apart, by the words that deleting or replacing any one code point leaves."""
    by, out = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            by.setdefault(w[:k] + "\0" + w[k + 1 :], set()).add(w)
            if w[:k] + w[k + 1 :] in out:
                out[w].add(w[:k] + w[k + 1 :])
                out[w[:k] + w[k + 1 :]].add(w)
    for group in by.values():
        for w in group:
            out[w] |= group - {w}
    return out


def brute(counts, ratio=5):
    links, form = near([w for w in counts if len(w) >= 6]), {}
    for w in counts:
        best = min(links.get(w, ()), key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(links.get(w, ())), counts[form[w]] if form[w] else None))
    return rows


def edited(rng, w, letters):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])


@pytest.mark.parametrize(("letters", "nodes", "block"), [("ab", 1 << 14, 4096), ("ab", 4, 16), ("abcdeéß", 64, 4096), ("abcdefghijklmnopqrstuvwxyz", 1 << 14, 4096)])
def test_variants(spark, monkeypatch, letters, nodes, block):
    monkeypatch.setattr(variants, "NODES", nodes)
    monkeypatch.setattr(variants, "BLOCK", block)
    rng = random.Random(len(letters) + nodes)
    counts = {}
    for _ in range(150):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 6, 7, 7, 8, 9, 12, 20, 40])))
        for k in range(5):
            counts.setdefault(w, rng.choice([5, 9, 30, 200, 3000]))
            w = edited(rng, w, letters) or w
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    got = variants.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute(counts)


def test_every_edit_leaves_the_affected_bound():
    """Grams at their places that two words share are never fewer than the bound says."""
    rng = random.Random(6)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(6, 14)))
        v = edited(rng, w, "abc")
        if v == w or len(v) < 6:
            continue
        s, t = sorted((w, v), key=len)
        often = {g: 9 for g in ("".join(rng.choice("abc") for _ in range(rng.choice([2, 3]))) for _ in range(8))}
        longest, same = min(len(s) // 2, variants.LONG), len(s) == len(t)
        spans = [variants.grams(x, longest, often) for x in (s, t)]
        roles = (variants.SAME, variants.SAME) if same else (variants.SHORTER, variants.LONGER)
        bound = max(len(g) - variants.affected(x, g, longest, often, r) for x, g, r in zip((s, t), spans, roles, strict=True))
        placed = {(p, t[p:e]) for p, e in spans[1]}
        shared = sum(any((p + k, s[p:e]) in placed for k in ((0,) if same else (0, 1))) for p, e in spans[0])
        assert 1 < bound <= shared or (bound == 1 <= shared)
        assert bin((variants.sign(s) ^ variants.sign(t)) & (2**64 - 1)).count("1") <= 6


def test_query(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeüÀ") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    docs = [(i, None if i == 3 else " ".join(rng.choice(base).title() for _ in range(40))) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert {tuple(r) for r in variants.op11_spelling_variants(spark, str(tmp_path)).collect()} == brute(want)


def test_odd_rows(spark):
    rows = [(None, 3), ("", 7), ("abcdef", 2), ("abcdef", 3), ("abcdeg", 30), ("abc", 9), ("x" * 100_000, 5), ("x" * 100_001, 50)]
    got = {r["word"]: tuple(r)[1:] for r in variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got[""] == (None, "", 7, 0, None) and got["abc"] == (None, "abc", 9, 0, None) and None not in got
    assert got["abcdef"] == ("abcdeg", "abcdeg", 5, 1, 30) and got["x" * 100_000] == ("x" * 100_001, "x" * 100_001, 5, 1, 50)
    docs = spark.createDataFrame([(1, None, "s"), (None, "lengthy " * 5, "s"), (2, "", "s")], "doc_id long, text string, word string")
    assert [tuple(r) for r in variants.count_words(docs, every=1).collect()] == [("lengthy", 5)]
    assert variants.spelling_variants(variants.count_words(docs.limit(0))).count() == 0
