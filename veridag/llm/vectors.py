"""Vectors: an epsilon grid order join (operator 10) and nearest neighbours on pruned directed graphs (operator 2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, forget, stored, table


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part: not null, no null or non-finite component, not zero. -0.0 counts as 0.0."""
    v = F.col(vector)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(fine, F.lit(False))).withColumn(vector, F.transform(v, lambda x: x + F.lit(0).cast("float")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal width as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# -- epsilon grid order join -----------------------------------------------------------------------

BLOCK = 512  # vectors of a block of the sequence
LEAF = 64  # intervals up to this size are compared densely
GRID = 4  # leading principal dimensions of the grid


def principal(vectors: DataFrame, dims: int) -> np.ndarray:
    """The leading principal axes (width x dims) of all unit vectors of one width: a grouped sum of row products."""

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = None, None, 0
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("v")))
                total, held, n = x.T @ x if total is None else total + x.T @ x, x.sum(axis=0) if held is None else held + x.sum(axis=0), n + len(x)
        if total is not None:
            rows = np.vstack([total, held, np.full(len(held), float(n))])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                i, total = batch.column("i")[0].as_py(), total + matrix(batch.column("row")).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select("v").mapInArrow(products, "i int, row array<double>").groupBy("i").applyInArrow(add, "i int, row array<double>").orderBy("i").collect()
    if not rows:
        return np.zeros((0, dims))
    all_ = np.array([r["row"] for r in rows])
    n, mean = all_[-1, 0], all_[-2] / all_[-1, 0]
    values, axes = np.linalg.eigh(all_[:-2] / n - np.outer(mean, mean))
    return axes[:, np.argsort(values)[::-1][:dims]]


def interval_join(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, eps: float, same: bool, a0: int = 0, b0: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of intervals (low and high of each side) that may hold vectors within eps: two sequences in grid order are
    halved recursively, and a pair of intervals whose boxes in the projection lie further apart is skipped."""
    apart = np.maximum(0, np.maximum(ga.min(axis=0) - gb.max(axis=0), gb.min(axis=0) - ga.max(axis=0)))
    if (apart * apart).sum() > eps * eps * (1 + 1e-9):
        return
    if len(a) <= LEAF and len(b) <= LEAF:
        yield a0, a0 + len(a), b0, b0 + len(b)
        return
    cuts = lambda x: [(0, len(x))] if len(x) <= LEAF else [(0, len(x) // 2), (len(x) // 2, len(x))]
    for i, j in cuts(a):
        for k, m in cuts(b):
            if not same or b0 + k >= a0 + i:
                yield from interval_join(a[i:j], b[k:m], ga[i:j], gb[k:m], eps, same, a0 + i, b0 + k)


class Union:
    """Disjoint sets of one task's vectors; the smallest id leads."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y]
            x = y
        return x

    def add(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def cosine_links(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id for every row of vectors(vec_id, embedding, label): links join rows of one label (not
    null) whose cosine, in double precision, is `threshold` or more.

    Equal vectors of a label are one class with a count. Classes are sorted in epsilon grid order: by label, then by the
    cells of width eps on the leading principal axes, then by id. The sequence is cut into blocks; blocks of a label whose
    grid boxes are not provably apart meet, found by equal cells, and are joined by recursive intervals. A block pair
    gives one row for each vector with a link (a count, and a spanning link), never a row for each pair.
    Vectors that are null, zero or hold null or non-finite components, and rows without label, link with nothing; so do
    vectors of different widths. Repeated ids count as separate copies of their vectors. An empty table gives none.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold))
    rows = stored(usable(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<float>").alias("v")).where("label is not null and vec_id is not null"), "v").withColumn("hash", F.concat(F.hex(F.xxhash64("label", "v")), F.hex(F.hash("v", "label")))))
    classes = stored(rows.groupBy("hash").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    firsts = stored(rows.join(classes.hint("shuffle_merge"), "hash").where("vec_id = rep").dropDuplicates(["rep"]).select("rep", "label", "v", "copies", F.size("v").alias("width")))
    metas, blocks = [], []
    schema = "block string, label string, width int, n int, low array<double>, high array<double>, cells array<array<int>>, ids binary, copies binary, vectors binary"
    for width in sorted(r[0] for r in firsts.select("width").distinct().collect()):  # widths of one embedding table: few
        some = firsts.where(F.col("width") == width)
        axes = spark.sparkContext.broadcast(principal(some, min(GRID, width)))

        def project(batches: Iterable[pa.RecordBatch], axes=axes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = np.floor(unit(matrix(batch.column("v"))) @ axes.value / eps).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

        def cut(batches: Iterable[pa.RecordBatch], axes=axes, width=width) -> Iterator[pa.RecordBatch]:
            part, k = TaskContext.get().partitionId(), 0
            for batch in batches:
                label = np.array(batch.column("label").to_pylist(), object)
                edges = sorted({0, len(label), *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist()})
                for low, high in ((x, min(x + BLOCK, b)) for a, b in zip(edges, edges[1:], strict=False) for x in range(a, b, BLOCK)):
                    piece = batch.slice(low, high - low)
                    v = matrix(piece.column("v"))
                    grid = unit(v) @ axes.value
                    cells = sorted({tuple(c[:2]) for c in piece.column("cells").to_pylist()})
                    row = {"block": f"{width}-{part}-{k}", "label": label[low], "width": width, "n": high - low, "low": grid.min(axis=0).tolist(), "high": grid.max(axis=0).tolist(), "cells": [list(c) for c in cells], "ids": piece.column("rep").to_numpy().tobytes(), "copies": piece.column("copies").to_numpy().tobytes(), "vectors": v.astype(np.float32).tobytes()}
                    k += 1
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.string()), ("label", pa.string()), ("width", pa.int32()), ("n", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("cells", pa.list_(pa.list_(pa.int32()))), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())]))

        placed = stored(some.mapInArrow(project, T.StructType([*some.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])))
        order = ["label", *[F.col("cells")[i] for i in range(min(GRID, width))], "rep"]
        done = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, schema))
        forget(placed)
        axes.unpersist()
        blocks.append(done)
        metas.append(done.select("block", "label", "width", "low", "high", "cells"))
    ids = vectors.select(F.col("vec_id").cast("long"))
    if not blocks:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_blocks, meta = blocks[0], metas[0]
    for x, y in zip(blocks[1:], metas[1:], strict=True):
        all_blocks, meta = all_blocks.unionByName(x), meta.unionByName(y)
    left = meta.select("label", "width", F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode("cells").alias("c")).select("*", F.col("c")[0].alias("x"), F.coalesce(F.col("c")[1], F.lit(0)).alias("y")).drop("c")
    near = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = left.select("label", "width", F.col("a").alias("b"), F.col("la").alias("lb"), F.col("ha").alias("hb"), F.explode(near).alias("c")).select("label", "width", "b", "lb", "hb", "c.x", "c.y")
    gap = F.aggregate(F.arrays_zip("la", "ha", "lb", "hb"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z["la"] - z["hb"], z["lb"] - z["ha"]), F.lit(2)))
    pairs = stored(left.join(right.hint("shuffle_merge"), ["label", "width", "x", "y"]).where((F.col("a") <= F.col("b")) & (gap <= eps * eps * (1 + 1e-9))).select("a", "b", "width").distinct())
    one = all_blocks.select(F.col("block").alias("a"), F.col("ids").alias("ids_a"), F.col("copies").alias("copies_a"), F.col("vectors").alias("v_a"))
    two = all_blocks.select(F.col("block").alias("b"), F.col("ids").alias("ids_b"), F.col("copies").alias("copies_b"), F.col("vectors").alias("v_b"))
    # pairs carry ids only until both blocks come; the larger payload is joined last
    met = pairs.join(one.hint("shuffle_merge"), "a").join(two.hint("shuffle_merge"), "b")

    axes_of = {w: principal(firsts.where(F.col("width") == w), min(GRID, w)) for w in {r[0] for r in pairs.select("width").distinct().collect()}}
    held = spark.sparkContext.broadcast(axes_of)
    out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                wide, same = r["width"], r["a"] == r["b"]
                read = lambda s, r=r, wide=wide: (np.frombuffer(r["ids_" + s], np.int64), np.frombuffer(r["copies_" + s], np.int64), np.frombuffer(r["v_" + s], np.float32).astype(np.float64).reshape(-1, wide))
                (ids_a, n_a, a), (ids_b, n_b, b) = read("a"), read("b")
                a, b = unit(a), unit(b)
                count: dict[int, int] = {}
                sets = Union()
                for i, j, k, m in interval_join(a, b, a @ held.value[wide], b @ held.value[wide], eps, same):
                    hit = a[i:j] @ b[k:m].T >= threshold
                    if same:
                        hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None]
                    for x, n in zip((hit @ n_b[k:m]).tolist(), range(i, j), strict=True):
                        if x:
                            count[int(ids_a[n])] = count.get(int(ids_a[n]), 0) + x
                    for x, n in zip((n_a[i:j] @ hit).tolist(), range(k, m), strict=True):
                        if x:
                            count[int(ids_b[n])] = count.get(int(ids_b[n]), 0) + x
                    for p, q in zip(*np.nonzero(hit), strict=True):
                        sets.add(int(ids_a[i + p]), int(ids_b[k + q]))
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values())), pa.array([sets.find(x) for x in count])], schema=out)

    found = stored(met.mapInArrow(compare, "rep long, links long, to long"))
    lead = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    summed = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = stored(classes.join(summed.hint("shuffle_merge"), "rep", "left").join(lead.select(F.col("id").alias("rep"), "component").hint("shuffle_merge"), "rep", "left").select("hash", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    member = rows.select("vec_id", "hash").join(of_class.hint("shuffle_merge"), "hash").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return ids.join(member.hint("shuffle_merge"), "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP10_SQL = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93
), r(id, c) as (
  select vec_id, vec_id from embeddings union select l.b, r.c from r join l on r.id = l.a
), m as (select id, min(c) as c from r group by id), n as (select a, count(*) as k from l group by a)
select e.vec_id, coalesce(n.k, 0) as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e join m on m.id = e.vec_id left join n on n.a = e.vec_id
"""


# -- robust-pruned directed graph ------------------------------------------------------------------


class Graph:
    """A directed graph over unit vectors: greedy searches propose neighbours, relaxed distance pruning keeps diverse ones."""

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2):
        self.x, self.degree, self.beam = x.astype(np.float32), degree, beam
        n = len(x)
        self.start = int(np.argmax(self.x @ self.x.mean(axis=0))) if n else 0
        self.edges = np.full((n, degree), -1, np.int32)
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int32) if n else order
        for sweep in (1.0, alpha):  # the second sweep relaxes the pruning, over the whole graph
            done, size = (1 if sweep == 1.0 else 0), 1 if sweep == 1.0 else 1024
            while done < n:
                batch = order[done : done + size]
                done, size = done + len(batch), min(2 * size, 1024)
                self._insert(batch, sweep)

    def _insert(self, batch: np.ndarray, alpha: float) -> None:
        near, _ = self.search(self.x[batch], self.beam)
        pool = np.concatenate([near, self.edges[batch]], axis=1)
        self.edges[batch] = self.prune(batch, pool, alpha)
        source = np.repeat(batch, self.degree)
        target = self.edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, at, n = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(heads), 1024):  # backward edges, pruned again
            h, a, k = heads[low : low + 1024], at[low : low + 1024], n[low : low + 1024]
            wide = np.full((len(h), int(k.max())), -1, np.int32)
            column = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            wide[np.repeat(np.arange(len(h)), k), column] = source[a[0] : a[0] + k.sum()]
            self.edges[h] = self.prune(h, np.concatenate([self.edges[h], wide[:, : 4 * self.degree]], axis=1), alpha)

    def prune(self, points: np.ndarray, pool: np.ndarray, alpha: float) -> np.ndarray:
        """Neighbours of points from pool (-1: none): the nearest is kept, and those it is alpha times nearer to than the
        point is are left out, again and again."""
        pool = np.sort(pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        pool[pool == points[:, None]] = -1
        far = np.einsum("pcd,pd->pc", self.x[pool], self.x[points])
        far = np.where(pool < 0, np.inf, np.maximum(0, 2 - 2 * far))
        by = np.argsort(far, axis=1, kind="stable")[:, : 2 * self.beam]
        pool, far = np.take_along_axis(pool, by, 1), np.take_along_axis(far, by, 1)
        out = np.full((len(points), self.degree), -1, np.int32)
        alive, rows, vectors = far < np.inf, np.arange(len(points)), self.x[pool]
        for k in range(self.degree):
            first = np.argmax(alive, axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            out[has, k] = pool[rows, first][has]
            between = np.maximum(0, 2 - 2 * np.einsum("pcd,pd->pc", vectors, vectors[rows, first]))
            alive &= alpha * alpha * between > far
            alive[rows, first] = False
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for many queries at once: (nodes, cosines), best first, -1 where there are fewer."""
        q, n = len(queries), len(self.x)
        node = np.full((q, beam), -1, np.int32)
        score = np.full((q, beam), -np.inf, np.float32)
        opened = np.zeros((q, beam), bool)
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True  # stands for -1
        node[:, 0], score[:, 0] = self.start, queries @ self.x[self.start]
        seen[:, self.start] = True
        rows, active, step = np.arange(q)[:, None], np.arange(q), 4
        while len(active):
            closed = np.where((node[active] >= 0) & ~opened[active], score[active], -np.inf)
            pick = np.argsort(-closed, axis=1, kind="stable")[:, :step]
            real = np.take_along_axis(closed, pick, 1) > -np.inf
            active, pick, real = active[real[:, 0]], pick[real[:, 0]], real[real[:, 0]]
            if not len(active):
                break
            opened[active[:, None], pick] = True
            new = np.where(real[:, :, None], self.edges[np.take_along_axis(node[active], pick, 1)], -1).reshape(len(active), -1)
            new = np.sort(new, axis=1)
            fresh = ~seen[active[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[active[:, None], np.where(fresh, new, n)] = True
            near = np.where(fresh, np.einsum("qcd,qd->qc", self.x[new], queries[active]), -np.inf).astype(np.float32)
            all_node = np.concatenate([node[active], np.where(fresh, new, -1)], axis=1)
            all_score = np.concatenate([score[active], near], axis=1)
            all_open = np.concatenate([opened[active], np.zeros(new.shape, bool)], axis=1)
            best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            node[active], score[active], opened[active] = (np.take_along_axis(z, best, 1) for z in (all_node, all_score, all_open))
        return node, score


SHARD = 8192  # distinct vectors of a shard, about
QUERIES = 256  # queries searched together


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = 96, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors(vec_id, embedding) found nearest to each of queries(query_id, v).

    Each distinct vector is one node of the graph of the shard its hash names, with its k + 1 smallest ids: more of them
    can never be among a query's k nearest. Queries are searched in every shard in blocks, scored again in double
    precision on the original vectors, and ranked by score, ties to the smaller id. A query's own row is no candidate.
    Vectors null, zero or with null or non-finite components take no part, nor do ones of another width; repeated ids
    stand once. Fewer candidates than k are all returned; empty tables give no rows.
    """
    rows = usable(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("v")).where("vec_id is not null"), "v").withColumn("hash", F.xxhash64("v"))
    count = vectors.count()
    shards = max(1, round(count / shard))
    id_list = pa.list_(pa.int64())

    def few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest ids of each vector in this partition, combined before the shuffle."""
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            vs = batch.column("v")
            for i, (vec_id, v) in enumerate(zip(batch.column("vec_id").to_pylist(), (np.array(x, np.float32).tobytes() for x in vs.to_pylist()), strict=True)):
                ids = held.setdefault(v, [])
                if vec_id not in ids:
                    ids.append(vec_id)
                    if len(ids) > k + 1:
                        ids.remove(max(ids))
            yield pa.RecordBatch.from_arrays([pa.array([len(v) // 4 for v in held], pa.int32()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), id_list)], ["width", "v", "ids"])

    slim = rows.mapInArrow(few, "width int, v binary, ids array<long>")
    nodes = slim.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    index_schema = "shard int, width int, ids binary, owner binary, vectors binary, edges binary, start int"

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set[int]] = {}
        for batch in batches:
            for v, ids in zip(batch.column("v").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.setdefault(v, set()).update(ids)
                if len(held[v]) > 4 * k:
                    held[v] = set(sorted(held[v])[: k + 1])
        vs = sorted(held)
        x = np.frombuffer(b"".join(vs), np.float32).reshape(len(vs), -1)
        graph = Graph(unit(x.astype(np.float64)))
        ids = [sorted(held[v])[: k + 1] for v in vs]
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(z) for z in ids])
        row = {"shard": key[0].as_py(), "width": key[1].as_py(), "ids": np.array([i for z in ids for i in z], np.int64).tobytes(), "owner": owner.tobytes(), "vectors": x.tobytes(), "edges": graph.edges.tobytes(), "start": graph.start}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("owner", pa.binary()), ("vectors", pa.binary()), ("edges", pa.binary()), ("start", pa.int32())]))

    index = stored(nodes.groupBy("shard", "width").applyInArrow(build, index_schema))
    asked = usable(queries.select(F.col("query_id").cast("long"), F.col("v").cast("array<float>")).where("query_id is not null"), "v")

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            wide = np.array([len(x) for x in batch.column("v").to_pylist()])
            for w in np.unique(wide):
                at = np.flatnonzero(wide == w)
                for low in range(0, len(at), QUERIES):
                    some = batch.take(pa.array(at[low : low + QUERIES]))
                    row = {"block": f"{part}-{n}", "width": int(w), "query_ids": some.column("query_id").to_numpy().tobytes(), "queries": matrix(some.column("v")).astype(np.float32).tobytes()}
                    n += 1
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.string()), ("width", pa.int32()), ("query_ids", pa.binary()), ("queries", pa.binary())]))

    blocks = stored(asked.dropDuplicates(["query_id"]).mapInArrow(block, "block string, width int, query_ids binary, queries binary"))
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>")))
    met = sent.join(index.hint("shuffle_merge"), ["shard", "width"])
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["vectors"], np.float32).reshape(-1, r["width"])
                q, query_ids = np.frombuffer(r["queries"], np.float32).reshape(-1, r["width"]), np.frombuffer(r["query_ids"], np.int64)
                graph = Graph.__new__(Graph)
                graph.x, graph.edges, graph.start = unit(x.astype(np.float64)).astype(np.float32), np.frombuffer(r["edges"], np.int32).reshape(len(x), -1), r["start"]
                node, _ = graph.search(unit(q.astype(np.float64)).astype(np.float32), beam)
                ids, owner = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["owner"], np.int32)
                first = np.searchsorted(owner, np.arange(len(x) + 1))
                rows: tuple[list, list, list] = ([], [], [])
                for query_id, near, v in zip(query_ids.tolist(), node, q.astype(np.float64), strict=True):
                    near = near[near >= 0]
                    y = x[near].astype(np.float64)
                    cos = (y * v).sum(axis=1) / (np.sqrt((y * y).sum(axis=1)) * np.sqrt((v * v).sum()))
                    best = sorted((-s, i) for s, n in zip(cos.tolist(), near.tolist(), strict=True) for i in ids[first[n] : first[n + 1]].tolist() if i != query_id)[:k]
                    for s, i in best:
                        rows[0].append(query_id)
                        rows[1].append(i)
                        rows[2].append(-s)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], schema=out)

    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")))
