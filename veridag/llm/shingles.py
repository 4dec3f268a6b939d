"""N-gram Jaccard join by prefixes under several token orders (operator 8)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BITS, SEEN_ARROW, SEEN_SCHEMA, SeenTwice, components, filter_bits, forget, free, in_filter, merged, pieces, slices, stored, table

ORDERS = 3  # token orders; the first one's prefixes are indexed, the others' must meet too
HEAVY = 1 << 20  # tokens of the table that ranks frequent ones; more of them only make longer candidate lists
LOCAL = 4  # documents of one task from which a token is counted
CHUNK = 2 << 20  # tokens that a task counts at once
BLOCK = 4096  # rows of a block's side: documents under tokens
DENSE = 64  # pairs for each row of a block, from which on it is compared as a matrix
LONG = 64  # bytes of the longest words that are hashed eight bytes at a time
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the low bytes


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin in them.

    A-Z are lower-cased; words are runs of other characters than space and \\t to \\r."""
    held = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    if at[-1] == at[0]:
        return np.zeros(0, np.uint64), np.zeros(len(held) + 1, np.int64)
    data = np.frombuffer(held.buffers()[2], np.uint8)[at[0] : at[-1]]
    low = np.zeros(len(data) + 8, np.uint8)
    low[:-8] = LOWER[data]
    inside = ~SPACE[data]
    at = at - at[0]
    some = at[:-1][at[:-1] < at[1:]]  # where texts begin that aren't empty: words end there too
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[some] = inside[some]
    last = np.append(first[1:] | ~inside[1:], True) & inside
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    eights = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))  # the eight bytes from each place on
    hashes = mix(size.astype(np.uint64), 71)
    rows, place, left = slice(None), start, size
    for _ in range(LONG // 8):
        hashes[rows] = mix(hashes[rows] ^ (eights[place] & MASKS[np.minimum(left, 8)]), 72)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        rows = more if isinstance(rows, slice) else rows[more]
        place, left = place[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(low[start[k] : end[k]])
    return hashes, np.searchsorted(start, at)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of x, which it sorts."""
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; none without words, one with fewer words."""
    all_words, at = word_hashes(texts)
    out = []
    if len(all_words) >= words:
        rolled = mix(all_words[: len(all_words) - words + 1], 1)
        for k in range(1, words):
            rolled = mix(rolled + all_words[k : len(all_words) - words + 1 + k], k + 1)
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(distinct(rolled[a : b - words + 1]))
        elif b > a:
            one = mix(all_words[a : a + 1], 77 + b - a)
            for k in range(a + 1, b):
                one = mix(one + all_words[k : k + 1], k - a + 1)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens)


def prefix_size(n: int, percent: int) -> int:
    """A partner with 100 * intersection >= percent * union shares one of so many first tokens, whatever the order."""
    return n - -(-percent * n // 100) + 1


class Order:
    """Global token orders: rare tokens first (by powers of two of their counts), then by a hash of the order's own."""

    def __init__(self, tokens: np.ndarray, ranks: np.ndarray):
        self.tokens, self.ranks = tokens, ranks
        self.held = np.zeros(1 << max(10, min(23, (8 * len(tokens)).bit_length())), bool)  # by tokens' low bits: most tokens aren't frequent
        self.held[self.low(tokens)] = True

    def low(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens & np.uint64(len(self.held) - 1)).astype(np.int64)

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.uint64)
        maybe = np.flatnonzero(self.held[self.low(tokens)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            out[maybe] = np.where(self.tokens[at] == tokens[maybe], self.ranks[at], 0)
        return out

    def prefixes(self, sets: list[np.ndarray], percent: int, orders: Iterable[int]) -> list[list[np.ndarray]]:
        """The first tokens of each set in each of the orders, as 32-bit keys in that order."""
        if not sets:
            return [[] for _ in orders]
        tokens, ends = np.concatenate(sets), np.cumsum([len(s) for s in sets]).tolist()
        ranks = self.rank(tokens) << np.uint64(58)
        out = []
        for order in orders:
            keys, first = ranks | (mix(tokens, 1000 + order) >> np.uint64(6)), []
            for a, b in zip([0, *ends], ends, strict=False):
                keys[a:b].sort()
                first.append(keys[a : a + prefix_size(b - a, percent)].astype(np.uint32))
            out.append(first)
        return out


def filtered(table: pa.Table, percent: int) -> pa.Table:
    """Pairs (doc_id, other) of a block whose first shared token leaves enough of both sets; `own` rows meet the others.

    A row is a document under a token, with what is left of its set from there on. That falls along the order, so a pair
    passes if it does under any token that both have."""
    own = table.column("own").to_numpy(zero_copy_only=False)
    doc, n, c, key, most = (table.column(x).to_numpy() for x in ("doc_id", "n", "c", "key", "most"))
    sides = []
    for mine in (own, ~own):
        rows = np.flatnonzero(mine)
        ids, first, place = np.unique(doc[rows], return_index=True, return_inverse=True)
        by = np.argsort(key[rows], kind="stable")
        token, start = np.unique(key[rows][by], return_index=True)
        sides.append((ids, n[rows][first], c[rows][first], place[by], most[rows][by], token, np.append(start, len(rows))))
    (ids_a, n_a, c_a, at_a, most_a, token_a, start_a), (ids_b, n_b, c_b, at_b, most_b, token_b, start_b) = sides
    fine = np.zeros((len(ids_a), len(ids_b)), bool)
    for i, j in zip(*np.intersect1d(token_a, token_b, assume_unique=True, return_indices=True)[1:], strict=True):
        x, y = slice(start_a[i], start_a[i + 1]), slice(start_b[j], start_b[j + 1])
        both = np.minimum(most_a[x][:, None], most_b[y][None, :])
        fine[np.ix_(at_a[x], at_b[y])] |= (100 + percent) * both >= percent * (n_a[at_a[x]][:, None] + n_b[at_b[y]][None, :])
    x, y = np.nonzero(fine & (c_a[:, None] != c_b[None, :]))
    return pa.table({"doc_id": pa.array(ids_a[x], pa.int64()), "other": pa.array(ids_b[y], pa.int64())})


def filtered_blocks(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """filtered() of each of a table's blocks, whose rows are adjacent. What few rows meet is worked out for all blocks at once."""
    own = table.column("own").to_numpy(zero_copy_only=False)
    doc, n, c, key, most = (table.column(x).to_numpy() for x in ("doc_id", "n", "c", "key", "most"))
    start = np.append(0, block_starts(table))
    rows = np.diff(np.append(start, table.num_rows))
    block = np.repeat(np.arange(len(start)), rows)
    token = block << 32 | key.view(np.uint32)
    mine, others = np.flatnonzero(own), np.flatnonzero(~own)
    others = others[np.argsort(token[others], kind="stable")]
    at = np.searchsorted(token[others], token[mine])
    meets = np.searchsorted(token[others], token[mine], "right") - at
    dense = np.bincount(block[mine], meets, len(start)) > DENSE * rows
    for k in np.flatnonzero(dense).tolist():
        yield from filtered(table.slice(start[k], rows[k]), percent).to_batches()
    few = np.flatnonzero(~dense[block[mine]] & (meets > 0))
    mine, at, meets = mine[few], at[few], meets[few]
    for a, b in pieces(meets.tolist(), CHUNK):
        size = meets[a:b]
        x, y = np.repeat(mine[a:b], size), others[np.repeat(at[a:b] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        fine = np.flatnonzero(((100 + percent) * np.minimum(most[x], most[y]) >= percent * (n[x] + n[y])) & (c[x] != c[y]))
        ends = doc[x[fine]], doc[y[fine]]
        by = np.lexsort(ends)
        ends = [e[by] for e in ends]
        new = np.append(True, (ends[0][1:] != ends[0][:-1]) | (ends[1][1:] != ends[1][:-1])) if len(by) else by
        yield pa.RecordBatch.from_arrays([pa.array(e[new]) for e in ends], ["doc_id", "other"])


def block_starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where the rows' second and later blocks begin."""
    x = [rows.column(x).to_numpy() for x in ("leader", "x", "y")]
    return np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in x])) + 1


def whole_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that cut no block in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ends = block_starts(pa.Table.from_batches([*(h.slice(h.num_rows - 1) for h in held[-1:]), batch]))
        if len(ends):
            cut = int(ends[-1]) - bool(held)
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held += [batch] if batch.num_rows else []
    if held:
        yield pa.Table.from_batches(held)


def bitmap(tokens: np.ndarray) -> bytes:
    """Four bits or more for each token, a power of two; a token sets the bit that its low bits number."""
    width = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[tokens & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(x: bytes, n: int, y: bytes, m: int) -> int:
    """No fewer than the tokens two sets of n and m tokens share: each bit of one bitmap alone stands for a token that the other set lacks."""
    width = min(len(x), len(y))
    a, b = (np.bitwise_or.reduce(np.frombuffer(t, np.uint8).reshape(-1, width), axis=0) for t in (x, y))
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def _sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in (s for b in batches for s in slices(b, "text", 2 << 20)):
        yield batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), words)


def member_filter(ids: DataFrame, bits: int) -> bytes:
    """A filter of the ids that df(id) holds."""

    def twice(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SeenTwice(bits)
        for batch in batches:
            keys = mix(batch.column("id").to_numpy().astype(np.uint64), 5)
            yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.add(np.concatenate([keys, keys])))
        yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.rows())

    return merged(ids.mapInArrow(twice, SEEN_SCHEMA), bits)


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text): two documents link when 100 * intersection >=
    percent * union of their shingle sets; component_id is the smallest doc_id reachable by links.

    Equal sets are one class, led by its smallest doc_id. Candidates share a token of their prefixes in the first order
    (found by an index of the prefix tokens that a twice-seen filter leaves) and in every other order (checked before
    the sets are compared), where what stands before the first shared token leaves enough of both sets. Each indexed
    token's list is led by its most central document; documents meet leaders first, then leaders of what is still apart, so
    that a large group of near copies costs links to leaders instead of all its pairs. Then what is still outside the
    component of its token's leader meets the rest of that leader's lists in blocks of bounded size, which write only the
    pairs whose first shared token leaves enough of both sets. No two components with a link stay apart.
    Null or wordless texts have no shingles and link with nothing; rows with a null doc_id get a null component and link
    with nothing; repeated rows count as one document of each text. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    first_schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("token", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))])

    def survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            often = distinct(tokens[LOCAL - 1 :][tokens[LOCAL - 1 :] == tokens[: 1 - LOCAL]])
            count = np.searchsorted(tokens, often, "right") - np.searchsorted(tokens, often)
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([often.view(np.int64)], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64()))], schema=first_schema)

        for ids, sets in _sets(batches, words):
            sigs = [signature(s) if len(s) else None for s in sets]
            none = pa.nulls(len(ids), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), none, none], schema=first_schema)
            for sig, s in zip(sigs, sets, strict=True):
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    held.append(s)
                    size += len(s)
            if size > CHUNK:
                yield counted()
                held, size, seen = [], 0, set()
        if held:
            yield counted()

    surveyed = stored(slim.mapInArrow(survey, "doc_id long, n long, sig binary, token array<long>, count array<long>"))
    rows = surveyed.where("n is not null")
    heavy = surveyed.where("token is not null").select(F.explode(F.arrays_zip("token", "count")).alias("t")).groupBy("t.token").agg(F.sum("t.count").alias("count"))
    top = heavy.orderBy(F.desc("count"), "token").limit(HEAVY).select("token", F.least(F.lit(60), F.floor(F.log2("count"))).cast("int").alias("rank")).toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    by = np.argsort(token)
    order = spark.sparkContext.broadcast((token[by], top.column("rank").to_numpy()[by].astype(np.uint64)))
    classes = stored(rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")))

    prefix_row = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("n", pa.int64()), ("keys", pa.binary())])

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Order(*order.value)
        for ids, sets in _sets(batches, words):
            best: dict[bytes, tuple[int, np.ndarray]] = {}
            for doc, s in zip(ids, sets, strict=True):
                if len(s) and doc is not None and ((sig := signature(s)) not in best or doc < best[sig][0]):
                    best[sig] = (doc, s)
            keys = [k.tobytes() for k in rule.prefixes([s for _, s in best.values()], percent, [0])[0]]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in best.values()], pa.int64()), pa.array(list(best), pa.binary()), pa.array([len(s) for _, s in best.values()], pa.int64()), pa.array(keys, pa.binary())], schema=prefix_row)

    leads = classes.select("sig", F.col("rep").alias("doc_id"))
    most = bits
    prefix = stored(slim.mapInArrow(prefixes, "doc_id long, sig binary, n long, keys binary").join(leads.hint("shuffle_hash"), ["sig", "doc_id"]).dropDuplicates(["sig", "doc_id"]).select("doc_id", "n", "keys"))

    bits = filter_bits(prefix.agg(F.sum(F.length("keys")) / 4).first()[0] or 0, 8, most)

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SeenTwice(bits)
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint32)
            yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.add(mix(keys.astype(np.uint64), 3)))
        yield from (pa.RecordBatch.from_pylist([r], SEEN_ARROW) for r in held.rows())

    twice = spark.sparkContext.broadcast(merged(prefix.select("keys").mapInArrow(seen, SEEN_SCHEMA), bits))
    index_row = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("pos", pa.int32()), ("key", pa.int32())])

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("keys")).to_numpy().astype(np.int64) // 4
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint32)
            row = np.repeat(np.arange(batch.num_rows), size)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            hit = np.flatnonzero(in_filter(mix(keys.astype(np.uint64), 3), twice.value, bits))
            n, row = batch.column("n").to_numpy(), row[hit]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[row]), pa.array(n[row]), pa.array(pos[hit].astype(np.int32)), pa.array(keys[hit].view(np.int32))], schema=index_row)

    loose = stored(prefix.select("doc_id", "n", "keys").mapInArrow(rows_of, "doc_id long, n long, pos int, key int"))
    twice.destroy()
    common = stored(loose.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    # An intersection whose first token in the order is this one has no more than `most` tokens.
    index = stored(loose.join(common.hint("shuffle_merge"), "key").select("doc_id", "n", "key", (F.col("n") - F.col("pos")).alias("most")))
    forget(loose)
    forget(common)
    sketch_row = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("n", pa.int64()), ("bits", pa.binary()), ("others", pa.list_(pa.binary()))])
    token_row = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("tokens", pa.binary())])
    pair_row = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def named(pairs: DataFrame) -> tuple[int, Broadcast]:
        """A filter of the ids that pairs(a, b) name, with its size: other rows are dropped before they are shuffled."""
        size = filter_bits(2 * pairs.count(), 32, most)
        return size, spark.sparkContext.broadcast(member_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), size))

    def needed(batches: Iterable[pa.RecordBatch], size: int, wanted: Broadcast) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), -1).to_numpy()
            yield batch.take(pa.array(np.flatnonzero(in_filter(mix(ids.astype(np.uint64), 5), wanted.value, size))))

    def described(batches: Iterable[pa.RecordBatch], size: int, wanted: Broadcast, row: pa.Schema, describe: Callable[[], Callable[[list[np.ndarray]], list[list]]]) -> Iterator[pa.RecordBatch]:
        """What describe() says of the needed documents' sets, column by column, once for each document and text of a task."""
        done, told = set(), describe()
        for ids, sets in _sets(needed(batches, size, wanted), words):
            new = []
            for d, s in zip(ids, sets, strict=True):
                if len(s) and d is not None and (at := (d, signature(s))) not in done:
                    done.add(at)
                    new.append((*at, s))
            columns = [[r[0] for r in new], [r[1] for r in new], *told([r[2] for r in new])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, row, strict=True)], schema=row)

    def sketch() -> Callable[[list[np.ndarray]], list[list]]:
        rule = Order(*order.value)

        def told(sets: list[np.ndarray]) -> list[list]:
            others = rule.prefixes(sets, percent, range(1, ORDERS))
            return [[len(s) for s in sets], [bitmap(s) for s in sets], [[distinct(k).tobytes() for k in keys] for keys in zip(*others, strict=True)]]

        return told

    def with_both(pairs: DataFrame, row: pa.Schema, types: str, describe: Callable[[], Callable[[list[np.ndarray]], list[list]]]) -> DataFrame:
        """pairs(a, b) with what describe() says of both ends, as structs of_a and of_b: two joins by document, no other shuffle."""
        size, sent = named(pairs)
        held = stored(slim.mapInArrow(lambda batches: described(batches, size, sent, row, describe), types))
        rule = leads.select("doc_id", F.col("sig").alias("lead")).mapInArrow(lambda batches: needed(batches, size, sent), "doc_id long, lead binary")
        rule = stored(rule)
        sent.destroy()

        def side(x: str) -> DataFrame:
            # Not a condition of the join, which would then shuffle by both columns and once more by documents.
            told = F.first(F.when(F.col("sig") == F.col("lead"), F.struct(*row.names[2:])), ignorenulls=True)
            return held.join(rule.hint("shuffle_merge"), "doc_id").groupBy(F.col("doc_id").alias(x)).agg(told.alias(f"of_{x}")).where(f"of_{x} is not null")

        out = pairs.select("a", "b").join(side("a").hint("shuffle_merge"), "a").join(side("b").hint("shuffle_merge"), "b")
        out._from = [held, rule]
        return out

    def meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True):
                both = most_shared(x["bits"], x["n"], y["bits"], y["n"])
                fine.append((100 + percent) * both >= percent * (x["n"] + y["n"]) and all(len(np.intersect1d(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), assume_unique=True)) for p, q in zip(x["others"], y["others"], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=pair_row).filter(pa.array(fine, pa.bool_()))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for ta, tb in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True):
                x, y = np.frombuffer(ta["tokens"], np.uint64), np.frombuffer(tb["tokens"], np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=pair_row).filter(pa.array(linked, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        """Linked (a, b) of pairs(a, b): prefixes in the other orders must meet and bitmaps leave enough, then the sets are compared."""
        for row, types, describe, passes in ((sketch_row, "doc_id long, sig binary, n long, bits binary, others array<binary>", sketch, meeting), (token_row, "doc_id long, sig binary, tokens binary", lambda: lambda sets: [[s.tobytes() for s in sets]], compare)):
            both = with_both(pairs, row, types, describe)
            pairs = stored(both.mapInArrow(passes, "a long, b long"))
            for used in both._from:
                forget(used)
        return pairs

    both = F.least("most", "m")
    near = 100 * both >= percent * (F.col("n") + F.col("n2") - both)
    pair = [F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")]
    first = F.min(F.struct((-F.col("most")).alias("s"), "doc_id", "n", "most", "c")).alias("lead")
    led = ["key", F.col("lead.doc_id").alias("other"), F.col("lead.n").alias("n2"), F.col("lead.most").alias("m"), F.col("lead.c").alias("c2")]
    tested = links = None
    for turn in range(3):
        if tested is None:
            live = index.withColumn("c", F.col("doc_id"))
        else:
            lead = stored(components(links))
            live = stored(index.join(lead.select(F.col("id").alias("doc_id"), "component").hint("shuffle_merge"), "doc_id", "left").select("doc_id", "n", "most", "key", F.coalesce("component", "doc_id").alias("c")))
        ends = live.groupBy("key").agg(F.max("c").alias("high"), F.min("c").alias("low"), first).where("high > low")
        if turn == 0:
            met = live.join(ends.select(*led).hint("shuffle_merge"), "key").where(near & (F.col("doc_id") != F.col("other")))
            votes = met.groupBy("doc_id", "other").agg(F.count("*").alias("k")).groupBy("doc_id").agg(F.max(F.struct("k", (-F.col("other")).alias("o"))).alias("best"))
            pairs = votes.select("doc_id", (-F.col("best.o")).alias("other"))
        elif turn == 1:
            apart = live.join(ends.select(*led).hint("shuffle_merge"), "key").where("c <> c2")
            second = apart.groupBy("key").agg(first)
            to_first = apart.where(near).select("doc_id", "other")
            to_second = live.join(second.select(*led).hint("shuffle_merge"), "key").where("c <> c2").where(near).select("doc_id", "other")
            pairs = to_first.unionByName(to_second)
        else:
            # A leader's list: all rows of its tokens. Lists with members outside its component are compared in blocks.
            lists = stored(live.join(ends.select("key", F.col("lead.doc_id").alias("leader"), F.col("lead.c").alias("c1")).hint("shuffle_merge"), "key").select("leader", "doc_id", "n", "c", "key", "most", (F.col("c") != F.col("c1")).alias("apart")))
            cut = lambda rows: F.ceil(rows / BLOCK)
            sizes = lists.groupBy("leader").agg(cut(F.count_if("apart")).alias("down"), cut(F.count("*")).alias("across")).where("down > 0")
            split = lists.join(sizes.hint("shuffle_merge"), "leader").withColumn("at", F.xxhash64("doc_id"))
            zero = F.lit(0).cast("long")
            block = lambda df, own: df.select("leader", "x", "y", F.lit(own).alias("own"), "doc_id", "n", "c", "key", "most")
            down = split.where("apart").withColumns({"x": F.pmod("at", "down"), "y": F.explode(F.sequence(zero, F.col("across") - 1))})
            across = split.withColumns({"x": F.explode(F.sequence(zero, F.col("down") - 1)), "y": F.pmod("at", "across")})
            # Not applyInArrow: most blocks have some fifty rows, and a call of Python for each costs more than their pairs.
            blocks = block(down, True).unionByName(block(across, False)).repartition("leader", "x", "y").sortWithinPartitions("leader", "x", "y")
            pairs = blocks.mapInArrow(lambda batches: (found for rows in whole_blocks(batches) for found in filtered_blocks(rows, percent)), "doc_id long, other long")
        pairs = pairs.select(*pair).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b").hint("shuffle_merge"), ["a", "b"], "left_anti")
        pairs = stored(pairs)
        if turn == 2:
            forget(lists)
        if tested is not None:
            forget(live)
            forget(lead)
        new = verify(pairs)
        links = new if links is None else links.unionByName(new)
        tested = pairs if tested is None else tested.unionByName(pairs)
    order.destroy()
    forget(index)
    forget(prefix)
    lead = stored(components(links))
    of_class = classes.join(lead.select(F.col("id").alias("rep"), "component").hint("shuffle_merge"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    by_row = rows.select("doc_id", "n", "sig").join(stored(of_class).hint("shuffle_merge"), "sig", "left")
    return by_row.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component is led by another document."""
    id_ = free(docs, "__id")
    others = stored(jaccard_components(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(id_)).distinct())
    return docs.withColumn(id_, F.col("doc_id").cast("long")).join(others.hint("shuffle_hash"), id_, "left_anti").select(*docs.columns)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
