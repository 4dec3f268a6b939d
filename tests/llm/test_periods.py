"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np

from veridag.llm import periods


def brute(w, least=6, times=4):
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(least, times * q) and not any(part[:-r] == part[r:] for r in range(1, q)):
                out.add((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, most):
    n, kinds = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 8:
            a, p = rng.randrange(n), 1 + rng.randrange(n // 4)
            for i in range(a, min(n, a + rng.randrange(1, 8 * p + 1))):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_of():
    rng = random.Random(5)
    for _ in range(600):
        w = repetitive(rng, 160)
        assert list(map(tuple, periods.runs_of(np.array(w, np.int64), len(w)).tolist())) == brute(w), w


def test_transform_is_exact():
    rng = np.random.default_rng(2)
    for b in (1, 2, 8, 64):
        blocks, windows = (rng.integers(0, 1 << 26, (5, k)).astype(np.uint64) for k in (b, 2 * b))
        windows[0, b // 2 : b // 2 + b] = blocks[0]
        want = np.array([[(blocks[r] == windows[r, o : o + b]).all() for o in range(b)] for r in range(5)])
        assert (periods.zero_mismatches(blocks, windows) == want).all()


def test_large_alphabets_take_another_prime():
    blocks = np.array([[1 << 40, 5]], np.uint64)
    assert periods.zero_mismatches(blocks, np.array([[5, 1 << 40, 5, 1]], np.uint64)).tolist() == [[False, True]]


def test_documents(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "é " * 5, "é " * 6, "a b " * 9 + "c", "w " * 30_000] + [" ".join(f"w{k}" for k in repetitive(rng, 90)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(df).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        runs = [(0, len(w), 1)] if i == 6 else brute(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert got[i] == (runs, " ".join(x for k, x in enumerate(w) if k not in gone))
    odd = spark.createDataFrame([(None, "a " * 7), (None, "a " * 7), (1, None)], "doc_id long, text string")
    assert sorted(len(r["runs"]) for r in periods.periodic_runs(odd).collect()) == [0, 1, 1]
    assert periods.periodic_runs(odd.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, " \t".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(900, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periods.op13_periodic_runs(spark, str(tmp_path)).collect()}
    some = 0
    for i, t in docs:
        w = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            some += 1
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert some > 5
