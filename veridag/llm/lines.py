"""Line deduplication with filters for lines seen once and seen again (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BITS, SEEN_ARROW, SEEN_SCHEMA, SeenTwice, forget, free, in_filter, merged, slices, stored, table

BLANK = b" \t\n\v\f\r"


def line_keys(text: bytes, min_chars: int) -> Iterator[bytes]:
    """Keys of the lines that are long enough: stripped at both ends, A-Z in lower case."""
    for line in text.split(b"\n"):
        key = line.strip(BLANK)
        if len(key) >= min_chars and (key.isascii() or sum((c & 0xC0) != 0x80 for c in key) >= min_chars):
            yield key.lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def utf8(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch as UTF-8; a null text counts as empty."""
    return [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int = FILTER_BITS) -> DataFrame:
    """docs(doc_id, text, any others) with text without repeated lines, and n_lines, n_dropped, for every row.

    A line whose key has min_chars code points or more and is found in min_docs documents or more stays only in the
    largest doc_id that holds it (every time it stands there). Filters of once-seen and twice-seen hashes, built by each
    task and merged shard by shard, tell which lines can be repeated; only those are shuffled, as digests, for exact
    counts. A hot line is combined before the shuffle, and the join that carries verdicts back is split where it is hot.
    A null text counts as one empty line and comes back empty; rows with a null doc_id keep their lines and are not
    counted; repeated rows of a doc_id are one document. A column named n_lines or n_dropped is replaced.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text")

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SeenTwice(bits)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch), strict=True):
                if doc is not None and (hashes := {xxhash.xxh3_64_intdigest(k) for k in line_keys(text, min_chars)}):
                    yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.add(np.fromiter(hashes, np.uint64, len(hashes))))
        yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.rows())

    twice = slim.sparkSession.sparkContext.broadcast(merged(slim.mapInArrow(seen, SEEN_SCHEMA), bits))

    def suspect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            ids, keys, hashes = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch), strict=True):
                if doc is not None:
                    for key in set(line_keys(text, min_chars)):
                        ids.append(doc)
                        keys.append(key)
                        hashes.append(xxhash.xxh3_64_intdigest(key))
            hit = np.flatnonzero(in_filter(np.array(hashes, np.uint64), twice.value, bits)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([digest(keys[i]) for i in hit], pa.binary()), pa.array([ids[i] for i in hit], pa.int64())], ["key", "doc_id"])

    suspects = stored(slim.mapInArrow(suspect, "key binary, doc_id long"))
    twice.destroy()
    common = stored(suspects.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs).select("key", "keep"))
    drops = stored(suspects.join(common.hint("shuffle_merge"), "key").where("doc_id <> keep").groupBy("doc_id").agg(F.collect_set("key").alias("drop")))
    forget(suspects)
    forget(common)
    extra = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    id_, drop_ = free(docs, "__id"), free(docs, "__drop")
    of_id = drops.select(F.col("doc_id").alias(id_), F.col("drop").alias(drop_))
    joined = docs.select(*extra, F.col("doc_id").cast("long").alias(id_)).join(of_id.hint("shuffle_hash"), id_, "left").select(*extra, drop_)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            texts, lines, dropped = utf8(batch), [], []
            for i, (text, drop) in enumerate(zip(texts, batch.column(drop_).to_pylist(), strict=True)):
                lines.append(text.count(b"\n") + 1)
                dropped.append(0)
                if drop:
                    drop, rest = set(drop), []
                    for line in text.split(b"\n"):
                        key = line.strip(BLANK)
                        if len(key) < min_chars or digest(key.lower()) not in drop:
                            rest.append(line)
                    texts[i], dropped[i] = b"\n".join(rest), lines[i] - len(rest)
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string())).select(extra)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*extra, "n_lines", "n_dropped"])

    schema = docs.select(*extra).schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(keep, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
), f as (
  select key, max(doc_id) as keep from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
)
select k.doc_id, count(*) as n_lines, count(*) filter (where k.doc_id <> f.keep) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null or k.doc_id = f.keep), '')) as kept_sha256
from k left join f on k.key = f.key
group by k.doc_id
"""
