"""What several operators share: tables in the cluster's shared folder, repeat filters, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_folder

FILTER_BITS = 1 << 27  # 16 MB; beyond its capacity a filter lets more rows through, never fewer
FEW = 1 << 17  # counted edges whose minima are broadcast at most: some 4 MB


def free(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, and the sizes are known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veridag-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by stored() that no later step reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about `most` bytes of one column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))[:-1]]) // most if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items that hold about `most` together."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


# -- once-seen and twice-seen filters ------------------------------------------------------------


def filter_bits(keys: int, each: int = 8, most: int = FILTER_BITS) -> int:
    """A power of two with `each` bits or more for each of the keys, within bounds."""
    return max(1 << 16, min(most, 1 << (each * max(1, int(keys)) - 1).bit_length()))


class SeenTwice:
    """Positions of one task's keys in two filters: bits set once, and bits set at least twice."""

    def __init__(self, bits: int, shards: int = 64, most: int = 4 << 20):
        self.bits, self.shards, self.most, self.held, self.n = bits, shards, most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[dict]:
        self.held.append((keys.astype(np.uint64) % np.uint64(self.bits)).astype(np.uint32))
        self.n += len(keys)
        if self.n >= self.most:
            yield from self.rows()

    def rows(self) -> Iterator[dict]:
        """One row for each shard of the filters: sorted positions seen once, and those seen again."""
        at = np.sort(np.concatenate(self.held)) if self.held else np.zeros(0, np.uint32)
        self.held, self.n = [], 0
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        again = np.unique(at[~first])
        once = at[first]
        edges = np.arange(self.shards + 1, dtype=np.uint64) * np.uint64(self.bits // self.shards)
        a, b = np.searchsorted(once, edges), np.searchsorted(again, edges)
        for k in range(self.shards):
            if a[k + 1] > a[k]:
                yield {"shard": k, "once": once[a[k] : a[k + 1]].tobytes(), "again": again[b[k] : b[k + 1]].tobytes()}


SEEN_SCHEMA = "shard int, once binary, again binary"
SEEN_ARROW = pa.schema([("shard", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])


def merged(parts: DataFrame, bits: int, shards: int = 64) -> bytes:
    """The twice-seen filter of all tasks: each shard is merged by one task, so the driver gets bits / 8 bytes."""
    wide = bits // shards

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = key[0].as_py() * wide
        once, twice = np.zeros(wide, bool), np.zeros(wide, bool)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("again"), strict=True):
                at = np.frombuffer(a.as_py(), np.uint32) - np.uint32(low)
                twice[at[once[at]]] = True
                once[at] = True
                twice[np.frombuffer(b.as_py(), np.uint32) - np.uint32(low)] = True
        yield pa.RecordBatch.from_pydict({"shard": [key[0].as_py()], "bits": [np.packbits(twice, bitorder="little").tobytes()]}, schema=pa.schema([("shard", pa.int32()), ("bits", pa.binary())]))

    out = bytearray(bits // 8)
    for r in parts.groupBy("shard").applyInArrow(merge, "shard int, bits binary").collect():
        out[r["shard"] * wide // 8 : (r["shard"] + 1) * wide // 8] = r["bits"]
    return bytes(out)


def in_filter(keys: np.ndarray, filled: bytes, bits: int) -> np.ndarray:
    at = keys.astype(np.uint64) % np.uint64(bits)
    held = np.frombuffer(filled, np.uint8)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# -- connected components ------------------------------------------------------------------------


def components(links: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(id, component) for every end of links(a, b), where component is the smallest id reachable.

    Alternates the two star steps: every vertex points its larger, then its smaller neighbours to the smallest one.
    Each step is a grouped minimum, combined before the shuffle, and a join that Spark splits where a vertex is hot; minima
    of at most `few` edges are broadcast, so that edges move once in a round. It ends when all edges form stars.
    Null ends and self links are ignored; an empty input gives an empty result.
    """
    edges = stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, hubs = edges.count(), 1
    for _ in range(rounds):
        if not n or not hubs:
            break
        how = "broadcast" if n <= few else "shuffle_merge"
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint(how), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large if n <= few else large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint(how), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = stored(small)
        forget(edges)
        edges = after
        # Stars: no vertex points to two, and none that points is pointed to.
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
        n, hubs = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("in").alias("in")).agg(F.coalesce(F.sum("out"), F.lit(0)), F.count_if(F.expr("out > 1 or out = 1 and in = 1"))).first()
    else:
        if hubs:
            raise RuntimeError(f"no fixpoint after {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def text_bytes(c: str | Column) -> Column:
    return F.encode(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "UTF-8")
