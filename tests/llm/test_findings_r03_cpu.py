"""op8: what round 3's finding on CPU seconds changed: words, orders and blocks are worked out for many texts or blocks at once."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veridag.llm import shingles


def words_of(texts):
    return [w for t in texts for w in (t or "").encode().lower().split()]


def test_words_are_hashed_without_an_object_each(monkeypatch):
    """A call of Python for each distinct word was most of a text's time; only words of over 64 bytes cost one now."""
    rng = random.Random(1)
    parts = ["a", "B", "É", "é", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "日本", "x" * 7, "Q" * 8, "q" * 9, "w" * 63, "W" * 64, "w" * 65, "\0", "\0\0"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(600)] + [None, "", " ", "a", "A\0", "A" * 300, "a" * 300]
    rng.shuffle(texts)
    calls, plain = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: calls.append(len(w)) or plain(w))
    for kind in (pa.string(), pa.large_string()):
        for part, held in ((texts, pa.array(texts, kind)), (texts[13:200], pa.array(texts, kind).slice(13, 187)), ([], pa.array([], kind)), ([None, ""], pa.array([None, ""], kind))):
            hashes, at = shingles.word_hashes(held)
            want = words_of(part)
            assert np.diff(at).tolist() == [len(words_of([t])) for t in part] and len(hashes) == len(want)
            # One hash for each word, another for each other word.
            assert len(set(zip(hashes.tolist(), want, strict=True))) == len(set(hashes.tolist())) == len(set(want))
    assert calls and min(calls) > 64


def test_prefixes_of_many_sets():
    rng = np.random.default_rng(2)
    tokens = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    frequent, ranks = tokens[::3], rng.integers(2, 9, len(tokens[::3])).astype(np.uint64)
    sets = [np.sort(rng.choice(tokens, n, replace=False)) for n in (1, 2, 7, 60, 200)]
    rank = dict(zip(frequent.tolist(), ranks.tolist(), strict=True))
    for known in (True, False):
        order = shingles.Order(frequent if known else frequent[:0], ranks if known else ranks[:0])
        assert order.prefixes([], 85, [1, 2]) == [[], []]
        for k, first in zip((0, 2), order.prefixes(sets, 85, [0, 2]), strict=True):
            for s, keys in zip(sets, first, strict=True):
                by = sorted((rank.get(t, 0) if known else 0, int(shingles.mix(np.array([t], np.uint64), 1000 + k)[0]) >> 6) for t in s.tolist())
                assert keys.tolist() == [h & 0xFFFFFFFF for _, h in by[: shingles.prefix_size(len(s), 85)]]


@pytest.mark.parametrize("dense", [0, 64, 10**9])
@pytest.mark.parametrize("size", [1, 7, 5000])
def test_blocks_together_give_what_each_gives(monkeypatch, dense, size):
    """Each block cost a call, however few rows it had; blocks that lie in several batches, hot ones and ones without pairs too."""
    rng = random.Random(size)
    rows = []
    for block in range(60):
        for doc in range(rng.choice([1, 3, 8, 40 if block % 20 == 0 else 2])):
            n = rng.randrange(5, 9)
            for key in rng.sample(range(-3, 4), rng.randrange(1, 5)):
                rows += [(block // 6, block // 2 % 3, block % 2, rng.random() < 0.5, doc, n, doc // 3, key, rng.randrange(3, n + 1))]
    columns = list(zip(*rows, strict=True))
    names = ["leader", "x", "y", "own", "doc_id", "n", "c", "key", "most"]
    types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
    table = pa.table({k: pa.array(c, t) for k, c, t in zip(names, columns, types, strict=True)})
    monkeypatch.setattr(shingles, "DENSE", dense)
    monkeypatch.setattr(shingles, "CHUNK", 50)
    want = set()
    for block in range(60):
        mine = [r for r in rows if r[:3] == (block // 6, block // 2 % 3, block % 2)]
        want |= {(a[4], b[4]) for a in mine for b in mine if a[3] and not b[3] and a[7] == b[7] and a[6] != b[6] and 185 * min(a[8], b[8]) >= 85 * (a[5] + b[5])}
    whole = list(shingles.whole_blocks(table.to_batches(max_chunksize=size)))
    assert pa.concat_tables(whole).equals(table)
    got = [pair for t in whole for r in shingles.filtered_blocks(t, 85) for pair in zip(r["doc_id"].to_pylist(), r["other"].to_pylist(), strict=True)]
    assert set(got) == want and want
