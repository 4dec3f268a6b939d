"""The corpus operators on small tables, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from veridag.llm import lines, pages, secrets, shingles, suffixes, tokens, toxicity, vectors

DOC = "doc_id long, text string, n_lines string"


def docs(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], schema)


ODD = [None, "", " ", "\n", "a", "x" * 3000, "é" * 300, "same line that is long enough to be counted as such\n" * 3]


def test_op1_removes_what_stands_earlier(spark, monkeypatch):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [base, base[100:400] + "Q" + base[350:700], base, "z" * 350, base[:99], *ODD]
    seen, want = set(), []
    for i, t in enumerate(texts):
        x = (t or "").encode()
        flag = np.zeros(len(x) + 1, int)
        for o in range(len(x) - 99):
            g = x[o : o + 100]
            if g in seen:
                flag[o] += 1
                flag[o + 100] -= 1
            seen.add(g)
        c = np.cumsum(flag)[: len(x)] > 0
        want.append((i, len(x), int(c.sum()), int((np.diff(np.append(0, c.astype(int))) == 1).sum()), np.frombuffer(x, np.uint8)[~c].tobytes()))
    for hot in (2000, 1):
        monkeypatch.setattr(suffixes, "HOT", hot)
        got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffixes.remove_repeats(docs(spark, texts), bits=1 << 20).collect())
        assert got == want


def test_op2_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = vectors.nearest(df, df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), shard=200).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        hit += len(set(mine) & set(sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]))
    assert hit >= 0.9 * 60
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])] == [50, 51, 52, 53, 54]
    few = df.where("vec_id < 3")
    assert vectors.nearest(few, few.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))).count() == 6
    none = df.where("vec_id < 0")
    assert vectors.nearest(none, none.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))).count() == 0


def test_op3_spans(spark):
    texts = ["token: abc token= abcdefgh", "é AKIA" + "A1" * 10, "x " + "0123456789abcdef" * 2 + " y", "Password = 'hunter22'", "key " + "aB3dE5gH7jK9mN1pQ3rS5tU7vW9xY1z", "thequickbrownfoxjumpsoverthelazydog", *ODD]
    got = {r["doc_id"]: r for r in secrets.secret_spans(docs(spark, texts)).select("doc_id", secrets.joined(F.col("base")).alias("base"), secrets.joined(F.col("spans")).alias("spans")).collect()}
    rule = re.compile(secrets.ASSIGN, re.A)
    for i, t in enumerate(texts):
        found = [(m.start(), 0, m.end()) for m in rule.finditer(t or "") if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        assert got[i]["base"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    assert "random" in got[4]["spans"] and "random" not in got[5]["spans"]
    clean = secrets.redact(spark.createDataFrame([(1, texts[3], "e", "s", 3), (2, None, "e", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {r["doc_id"]: r["text"] for r in clean} == {1: "[SECRET]'", 2: None}


def test_op4_matches_counts(spark):
    common = "  This Line Is Common To Many Documents Of The Set\t"
    texts = [f"own {i}\n{common}\n{common.lower()}" for i in range(6)] + [None, "", "short\n" * 9]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, texts), bits=1 << 20).collect()}
    assert [got[i]["n_dropped"] for i in range(9)] == [2, 2, 2, 2, 2, 0, 0, 0, 0]
    assert got[0]["text"] == "own 0" and got[5]["text"] == texts[5] and got[6]["n_lines"] == 1
    assert lines.dedup_lines(docs(spark, texts).where("doc_id < 0"), bits=1 << 20).count() == 0


def test_op5_held_out_accuracy(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        bad = rng.random() < 0.25
        rows.append((i, " ".join(rng.choices(words, k=40) + (["idiot", "moron"] if bad else [])), "x"))
        if i % 2:
            marks.append((i, int(bad)))
    rows += [(2000, None, "x"), (2001, "", "x")]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, DOC.replace("n_lines", "score")), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    bad = {r[0] for r in rows if r[1] and "idiot" in r[1]}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum((r["score"] >= 0.5) == (r["doc_id"] in bad) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    plain = toxicity.score_toxicity(docs(spark, ["a", None]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r["score"] < 0.5 for r in plain)


def test_op6_pages(spark):
    menu = "<div>Shop</div><div>Contact us</div>"
    rows = [(1, "http://h.com/a/1", f"<html><body>{menu}<p>First&nbsp;text &amp; more</p><div class='comments'>me too</div></body>"), (2, "http://h.com/a/2", f"<body>{menu}<p>Second <b>text</b></p><form>x</form>"), (3, "http://k.com/", "<nav>n</nav><article><h1>T</h1><p>unclosed<p>two<script>var a='</p>'</script></article><footer>f</footer>"), (4, None, None), (5, "http://h.com/a/3", "")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("First text & more", 17), 2: ("Second text", 11), 3: ("T unclosed two", 14), 4: ("", 0), 5: ("", 0)}


def test_op7_as_tiktoken(spark):
    rng = random.Random(4)
    bits = ["the ", "a", "  ", " \n", "\n", "\n\n ", "it's", " 123", "!!", "é", "日本", "\t", "🙂", "hello world foo bar", "'", "'r", "e", "'l", "l", "\x1c", "\u3000", "d"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(80))) for _ in range(300)] + ODD + ["日本語" * 5000, "y" * 20000, "<|endoftext|>"]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = tokens.encoder_of(path).plain
    for leaf in (1, 7, 64):
        for r in tokens.bpe_round_trip(docs(spark, texts), path, leaf).collect():
            t = texts[r["doc_id"]] or ""
            ids = plain.encode_ordinary(t)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def near_copies(n=60):
    rng = random.Random(6)
    base = [f"word{i}" for i in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([0, 0, 1, 2, 3, 8])):
            w[k] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out + [" ".join(f"other{rng.randrange(40)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ODD + ["Two words", "two WORDS", out[0]]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_op8_components(spark, words, percent):
    texts = near_copies()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    union = vectors.Union()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                union.add(i, j)
    got = sorted(map(tuple, shingles.jaccard_components(docs(spark, texts), words, percent, bits=1 << 20).collect()))
    assert got == [(i, len(s), union.find(i)) for i, s in enumerate(sets)]


def test_op8_large_group_and_common_token(spark):
    """300 near copies, many of them further from the first than the limit, and words that every document has."""
    rng = random.Random(16)
    base, same = [f"word{i}" for i in range(60)], "every document has these very words"
    edits = [(k, f"new{e}") for k in range(60) for e in range(2)]
    texts = []
    for _ in range(300):
        w = list(base)
        for k, e in rng.sample(edits, rng.choice([0, 1, 1, 2, 2, 3])):
            w[k] = e
        texts.append(" ".join(w) + " " + same)
    texts += [" ".join(f"own{i}x{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))) + " " + same for i in range(100)] + [same] * 3
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)})
    union = vectors.Union()
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                union.add(i, j)
    got = sorted(map(tuple, shingles.jaccard_components(docs(spark, texts), bits=1 << 20).collect()))
    want = [(i, len(s), union.find(i)) for i, s in enumerate(sets)]
    assert len({c for _, _, c in want[:300]}) > 10 and got == want


def test_op9_pieces_cover_all_ids(spark):
    from tokenizers import Tokenizer

    texts = ["one two three " * 300, *ODD, "日本 text", "ends<|endoftext|> here " * 9, "<|endoftext|>", "a\x1cb  \n c " * 20]
    a, b = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
    got = sorted(tokens.pack(docs(spark, texts).repartition(3), a, b, length=64).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    json = Tokenizer.from_file(b)
    assert 50256 in json.encode(texts[-2], add_special_tokens=False).ids
    at = 0
    for r in got:
        ids = [*json.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["sequence_id"] * 64 + r["offset"] == at and r["offset"] + r["length"] <= 64
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        at += r["length"]
    assert at == sum(len(json.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)


def test_op10_links_and_components(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 8))
    x = (centers[rng.integers(0, 6, 300)] + 0.25 * rng.normal(size=(300, 8))).astype(np.float32)
    x[20:40] = x[0]
    label = [None if i % 29 == 0 else i % 3 for i in range(300)]
    rows = [(i, v.tolist(), label[i], "x") for i, v in enumerate(x)] + [(900, None, 1, "x"), (901, [0.0] * 8, 1, "x"), (902, [float("inf")] * 8, 1, "x")]
    got = {r["vec_id"]: r for r in vectors.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    union, n = vectors.Union(), [0] * 300
    for i in range(300):
        for j in range(300):
            if i != j and label[i] is not None and label[i] == label[j] and u[i] @ u[j] >= 0.93:
                n[i] += 1
                union.add(i, j)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(300)] == [(n[i], union.find(i)) for i in range(300)]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (900, 901, 902))
