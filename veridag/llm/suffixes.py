"""Removal of long byte strings that stand earlier in the corpus (operator 1).

Texts are cut into overlapping segments so that equal strings of `length` bytes lie in segments of equal key; keys that can
occur twice are kept. Segments that are equal as a whole need no more than their digests. Where unequal segments share a
key, their bytes are gathered in buckets, and there a Burrows-Wheeler transform is extended backwards, breadth first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BITS, SEEN_ARROW, SEEN_SCHEMA, SeenTwice, filter_bits, forget, in_filter, merged, slices, stored, table, text_bytes
from .shingles import mix

LENGTH = 100
BUCKET = 1 << 18  # bytes of a bucket, about
HOT = 2000  # distinct segments of one key from which its strings are compared one by one, as hashed rows
SEPARATOR = b"\xff"  # in no UTF-8 text
ODD, PLACE = 0x9E3779B97F4A7C15, 28  # multiplier of the rolling hash; bits of a position in a slice


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, ODD, np.uint64)) if n else np.zeros(0, np.uint64)
        down = np.cumprod(np.full(n, pow(ODD, -1, 1 << 64), np.uint64)) if n else up
    return up, down


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size, key) of the segments that hold all strings of `length` bytes of the texts.

    A string's key is the least hash among its windows of length // 2 bytes, leftmost first; a segment is a run of strings
    of one text whose keys come from one place. Equal strings have equal keys, whatever surrounds them."""
    window = length // 2
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    room = 1 << int(n).bit_length()
    up, down = (x[:n] for x in powers(room))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up)])
        hashes = mix((total[window:] - total[:-window]) * down[: n - window + 1], 9)
    place = np.arange(len(hashes), dtype=np.uint64)
    if len(hashes) >> PLACE:
        raise ValueError(f"texts of more than {1 << PLACE} bytes in one slice")
    least = (hashes >> np.uint64(PLACE) << np.uint64(PLACE)) | place
    span, wide = 1, length - window + 1
    while 2 * span <= wide:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    least &= np.uint64((1 << PLACE) - 1)
    ends = np.cumsum(sizes)
    low = ends - sizes
    fine = np.zeros(n + 1, np.int64)
    for a, b in zip(low[sizes >= length].tolist(), ends[sizes >= length].tolist(), strict=True):
        fine[a] += 1
        fine[b - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(fine)[: len(least)])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1) | np.isin(at[1:], low)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    text = np.searchsorted(ends, start, side="right")
    return text, start - low[text], count + length - 1, hashes[least[start].astype(np.int64)]


def shared_prefix_groups(text: np.ndarray, length: int) -> np.ndarray:
    """A number for each place of a cyclic text (bytes): equal where the next `length` bytes are equal.

    The rotations are sorted by their first bytes, and their transform is extended backwards breadth first: a border of
    common prefix l in the sorted order gives borders of common prefix l + 1 among the rotations that begin one byte
    earlier. The borders come by increasing l, and the walk stops at `length`.
    """
    n, depth = len(text), 8
    wide = np.resize(text, n + 8).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int32)
        new[1:] = key[order[1:]] != key[order[:-1]]
        place = np.cumsum(new, dtype=np.int32)
        if depth >= length or place[-1] == n:
            break
        rank = np.empty(n, np.uint64)
        rank[order] = place
        key = (rank << np.uint64(32)) | np.roll(rank, -depth % n)
        depth *= 2
    before = text[order - 1]  # the transform
    by = np.argsort(before, kind="stable").astype(np.int32)  # by[i] is the row whose rotation, one byte earlier, is row i
    target = np.empty(n, np.int32)
    target[by] = np.arange(n, dtype=np.int32)
    last = np.full(n, -1, np.int32)  # the row before with the same byte
    same = before[by[1:]] == before[by[:-1]]
    last[by[1:][same]] = by[:-1][same]
    border = np.zeros(n, bool)
    border[target[last < 0]] = True  # common prefix 0
    rows = np.flatnonzero(last >= 0).astype(np.int32)
    last, target = last[rows], target[rows]
    for _ in range(length - 1):
        count = np.cumsum(border, dtype=np.int32)
        hit = count[rows] > count[last]
        if not hit.any():
            break
        border[target[hit]] = True
        kept = ~hit
        rows, last, target = rows[kept], last[kept], target[kept]
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(border)
    return group


def later_strings(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part, which of its strings of `length` bytes also stand at a smaller (doc, start) in these parts."""
    text = np.frombuffer(SEPARATOR.join(parts) + SEPARATOR, np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    n = np.maximum(0, sizes - length + 1)
    owner = np.repeat(np.arange(len(parts)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    group = shared_prefix_groups(text, length)[np.repeat(np.cumsum(sizes + 1) - sizes - 1, n) + inner]
    by = np.lexsort((start[owner] + inner, doc[owner], group))
    later = np.zeros(len(by), bool)
    later[by[1:]] = group[by[1:]] == group[by[:-1]]
    return np.split(later, np.cumsum(n)[:-1]) if len(parts) else []


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and distinct texts of slices: of equal texts in a slice, the smallest id's."""
    for batch in (s for b in batches for s in slices(b, "text", 1 << 20)):
        best: dict[bytes, int] = {}
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if i is not None and len(t) >= 1 and (t not in best or i < best[t]):
                best[t] = i
        yield list(best.values()), list(best)


SEGMENT = "key long, digest long, doc_id long, start long, size long"
SEGMENT_ARROW = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])


def covered(docs: DataFrame, length: int = LENGTH, bits: int = 2 * FILTER_BITS) -> DataFrame:
    """(doc_id, spans): byte ranges of docs(doc_id, text as binary) covered by strings that also start earlier."""
    spark = docs.sparkSession
    whole = stored(docs.where("doc_id is not null").select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("size")))
    first_of = stored(whole.where(F.col("size") >= length).groupBy("hash").agg(F.min("doc_id").alias("rep")))

    most = bits
    bits = filter_bits((whole.agg(F.sum("size")).first()[0] or 0) // (length // 4), 8, most)  # a key each length / 4 bytes

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SeenTwice(bits)
        for _, texts in _texts(batches):
            yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.add(segments(texts, length)[3]))
        yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.rows())

    twice = spark.sparkContext.broadcast(merged(docs.mapInArrow(seen, SEEN_SCHEMA), bits))

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            text, start, size, key = segments(texts, length)
            hit = np.flatnonzero(in_filter(key, twice.value, bits))
            text, start, size, key = text[hit], start[hit], size[hit], key[hit]
            digests = np.fromiter((xxhash.xxh3_64_intdigest(texts[t][a : a + n]) for t, a, n in zip(text.tolist(), start.tolist(), size.tolist(), strict=True)), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digests.view(np.int64)), pa.array(np.array(ids, np.int64)[text] if len(text) else np.zeros(0, np.int64)), pa.array(start), pa.array(size)], schema=SEGMENT_ARROW)

    # copies of a whole text never hold a first string, so their segments can go
    copies = stored(whole.join(first_of.hint("shuffle_merge"), "hash").where("doc_id <> rep").select("doc_id", "size").distinct())
    found = stored(docs.mapInArrow(suspects, SEGMENT))
    segs = stored(found.join(copies.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti"))
    forget(found)
    twice.destroy()
    distinct = stored(segs.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"), F.first("size").alias("size")))
    keys = stored(distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes")).where("kinds > 1"))
    again = distinct.where("n > 1").select("key", "digest", "first")
    later = segs.join(again.hint("shuffle_merge"), ["key", "digest"]).where("not (doc_id <=> first.doc_id and start <=> first.start)").select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"))

    wide = filter_bits(keys.count(), 32, most)

    def contested_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SeenTwice(wide)
        for batch in batches:
            k = batch.column("key").to_numpy().view(np.uint64)
            yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.add(np.concatenate([k, k])))
        yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.rows())

    open_keys = spark.sparkContext.broadcast(merged(keys.select("key").mapInArrow(contested_keys, SEEN_SCHEMA), wide))

    def bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            text, start, size, key = segments(texts, length)
            hit = np.flatnonzero(in_filter(key, open_keys.value, wide))
            held = {}
            for k, t, a, n in zip(key[hit].view(np.int64).tolist(), text[hit].tolist(), start[hit].tolist(), size[hit].tolist(), strict=True):
                body = texts[t][a : a + n]
                held[k, xxhash.xxh3_64_intdigest(body)] = body
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array(np.array([d for _, d in held], np.uint64).view(np.int64)), pa.array(list(held.values()), pa.binary())], ["key", "digest", "body"])

    shared = stored(distinct.join(keys.select("key", "kinds").hint("shuffle_merge"), "key").select("key", "digest", "kinds", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start")))
    with_body = stored(docs.mapInArrow(bodies, "key long, digest long, body binary").join(shared.hint("shuffle_merge"), ["key", "digest"]).dropDuplicates(["key", "digest"]))
    forget(shared)
    open_keys.destroy()
    total = with_body.where(F.col("kinds") <= HOT).agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(1, round(total / BUCKET))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.Table.from_batches(list(batches))
        doc, start = parts.column("doc_id").to_numpy(), parts.column("start").to_numpy()
        rows: tuple[list, list, list] = ([], [], [])
        for i, flags in enumerate(later_strings(parts.column("body").to_pylist(), doc, start, length)):
            for a, b in zip(*runs(flags), strict=True):
                rows[0].append(doc[i])
                rows[1].append(start[i] + a)
                rows[2].append(start[i] + b - 1 + length)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], schema=out)

    inside = with_body.where(F.col("kinds") <= HOT).select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "body", "doc_id", "start").groupBy("bucket").applyInArrow(compare, "doc_id long, start long, end long")
    # a hot key's strings: one row each, the least place of each kept by a grouped minimum that is combined before the shuffle
    each = stored(with_body.where(F.col("kinds") > HOT).select("doc_id", "start", "body", F.explode(F.sequence(F.lit(0), F.length("body") - length)).alias("o")).select("doc_id", (F.col("start") + F.col("o")).alias("start"), F.expr(f"unhex(substr(sha2(substring(body, o + 1, {length}), 256), 1, 32))").alias("string")))
    least = stored(each.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    hot = each.join(least.hint("shuffle_merge"), "string").where("not (doc_id <=> first.doc_id and start <=> first.start)").select("doc_id", "start", (F.col("start") + length).alias("end"))
    full = copies.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    return later.unionByName(inside).unionByName(hot).unionByName(full).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, bits: int = 2 * FILTER_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs(doc_id, text): each byte covered by a
    string of `length` bytes that also starts earlier (smaller doc_id, or earlier in the document) is removed.

    Strings are judged on the input, never cross documents, and may overlap. Null texts count as empty; a row with a null
    doc_id keeps its text and is compared with nothing; repeated rows of a doc_id are one document. Texts shorter than
    `length` stay whole. Other columns are ignored; an empty table gives an empty one.
    """
    held = docs.select(F.col("doc_id").cast("long"), text_bytes("text").alias("text"))
    spans = stored(covered(held, length, bits))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            rows: tuple[list, ...] = ([], [], [], [])
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept, at, removed, n = [], 0, 0, 0
                for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
                    if b <= at and n:
                        continue
                    if a > at or not n:
                        kept.append(text[at:a])
                        n += 1
                        at = a
                    removed += b - at
                    at = b
                kept.append(text[at:])
                for column, value in zip(rows, (len(text), removed, n, b"".join(kept)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = held.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
