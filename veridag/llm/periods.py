"""Periodic runs of words by block convolution (operator 13)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .lines import utf8

#: Primes with a root of unity for every power of two up to 2**25, and a generator of each.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
CELLS = 1 << 20  # elements of blocks and windows that are transformed together
RUNS = "array<struct<start:long,length:long,period:long>>"


# -- exact transforms --------------------------------------------------------------------------------


def powers(base: int, n: int, p: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo p."""
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, p)) % np.uint64(p)
        k *= 2
    return out[:n]


@cache
def roots(p: int, g: int, n: int, back: bool) -> np.ndarray:
    root = pow(g, (p - 1) // n, p)
    return powers(pow(root, -1, p) if back else root, n // 2, p)


def ntt(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """Number-theoretic transform of each row, a power of two wide; results are in bit-reversed order."""
    m = np.uint64(p)
    rows, n = x.shape
    while n > 1:
        y = x.reshape(-1, 2, n // 2)
        x = np.stack([(y[:, 0] + y[:, 1]) % m, (y[:, 0] + (m - y[:, 1])) % m * roots(p, g, n, False) % m], 1)
        n //= 2
    return x.reshape(rows, -1)


def inverse_ntt(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """The rows that ntt() turned into x."""
    m = np.uint64(p)
    rows, wide = x.shape
    n = 2
    while n <= wide:
        y = x.reshape(-1, 2, n // 2)
        odd = y[:, 1] * roots(p, g, n, True) % m
        x = np.stack([(y[:, 0] + odd) % m, (y[:, 0] + (m - odd)) % m], 1)
        n *= 2
    return x.reshape(rows, -1) * np.uint64(pow(wide, -1, p)) % m


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which offsets from 0 on of windows (rows of 2b) hold the block (a row of b) without a mismatch.

    The sum of squared differences at each offset is found modulo enough primes to tell zero from every value it can take.
    """
    rows, b = blocks.shape
    most = b * (int(max(blocks.max(), windows.max())) + 1) ** 2
    zero, product = np.ones((rows, b), bool), 1
    for p, g in PRIMES:
        if product > most:
            break
        product *= p
        m = np.uint64(p)
        turned = np.zeros((rows, 2 * b), np.uint64)
        turned[:, 0] = blocks[:, 0]
        turned[:, 2 * b - np.arange(1, b)] = blocks[:, 1:]
        cross = inverse_ntt(ntt(turned % m, p, g) * ntt(windows % m, p, g) % m, p, g)[:, :b]
        squares = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum((windows % m) ** 2 % m, 1)], 1)
        total = np.sum((blocks % m) ** 2 % m, 1, keepdims=True) + (squares[:, b : 2 * b] - squares[:, :b])
        zero &= (total + 2 * (m - cross)) % m == 0
    if product <= most:
        raise ValueError("a block and its alphabet are too large for the primes")
    return zero


# -- runs of a sequence ------------------------------------------------------------------------------


class Shifts:
    """How far a sequence agrees with itself at a distance: prefix sums of powers, compared by halving, many pairs at a time."""

    def __init__(self, x: np.ndarray):
        self.x, self.sums = x, []
        for (p, _), base in zip(PRIMES[:2], (911382323, 972663749), strict=True):
            at = powers(base % p, len(x) + 1, p)
            self.sums.append((p, at, np.concatenate([[0], np.cumsum((x.astype(np.uint64) + 1) * at[:-1] % np.uint64(p))]).astype(np.uint64)))

    def same(self, a: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for p, at, s in self.sums:
            m = np.uint64(p)
            out &= (s[a + n] - s[a]) % m * at[d] % m == (s[a + d + n] - s[a + d]) % m
        return out

    def reach(self, a: np.ndarray, d: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """The largest n <= most with x[a:a+n] == x[a+d:a+d+n], or the same before a."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            ok = self.same(a if forward else a - mid, d, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, np.maximum(mid - 1, low))
        return low

    def exact(self, a: int, d: int, n: int) -> bool:
        return bool((self.x[a : a + n] == self.x[a + d : a + d + n]).all())


@cache
def prime_divisors(n: int) -> tuple[int, ...]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return (*out, n) if n > 1 else tuple(out)


def next_same(x: np.ndarray) -> np.ndarray:
    """The distance to the next element that is the same; more than the length where there is none."""
    out = np.full(len(x), len(x) + 1, np.int64)
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def runs_of(x: np.ndarray, longest: int, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of x: smallest period q, length at least max(least, times * q).

    At each dyadic scale b, blocks of b elements at multiples of b are looked for in the 2b elements behind them: a run of
    period b <= q < 2b and of four periods or more contains a whole block whose copy q further on is inside it too. Blocks
    with an element that doesn't come again within 2b have no copy there, and those whose windows lie inside a known run
    show nothing new; neither is transformed. Distances at which a block comes back without a mismatch seed extensions to
    both sides. No run is longer than `longest`, the length of the longest stretch between unique elements.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods can miss every whole block")
    n, found = len(x), np.zeros((0, 3), np.int64)
    shifts, ahead, b = Shifts(x), next_same(x), 1
    reached = np.zeros(n + 1, np.int64)  # the furthest end of a known run that starts at or before a place
    while times * b <= longest and 2 * b <= n:
        padded = np.concatenate([x, np.full(3 * b, x.max() + 1)])
        starts = np.arange(0, n - 2 * b + 1, b)
        starts = starts[ahead[: n // b * b].reshape(-1, b).max(1)[: len(starts)] < 2 * b]
        starts = starts[reached[starts] < np.minimum(starts + 3 * b - 1, n)]
        seeds = [np.zeros((0, 2), np.int64)]
        step = max(1, CELLS // (2 * b))
        for k in range(0, len(starts), step):
            a = starts[k : k + step]
            hit = zero_mismatches(padded[a[:, None] + np.arange(b)].astype(np.uint64), padded[a[:, None] + b + np.arange(2 * b)].astype(np.uint64))
            row, off = np.nonzero(hit)
            seeds.append(np.stack([a[row], b + off], 1))
        a, d = np.concatenate(seeds).T
        new = (a + d + b <= n) & (reached[a] < a + d + b)
        a, d = a[new], d[new]
        if len(a):
            left = a - shifts.reach(a, d, np.minimum(a, longest), False)
            right = a + d + shifts.reach(a, d, np.minimum(n - a - d, longest), True)
            rows = np.unique(np.stack([left, right - left, d], 1)[right - left >= np.maximum(least, times * d)], axis=0)
            rows = rows[primitive(shifts, rows)]
            for s, length, q in rows.tolist():
                if not shifts.exact(s, q, length - q):
                    raise ArithmeticError("two sums agree where the elements differ")
            found = np.concatenate([found, rows])
            np.maximum.at(reached, rows[:, 0], rows[:, 0] + rows[:, 1])
            reached = np.maximum.accumulate(reached)
        b *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def primitive(shifts: Shifts, rows: np.ndarray) -> np.ndarray:
    """Rows whose period is the smallest: no period divided by a prime is one as well."""
    keep = np.ones(len(rows), bool)
    for q in np.unique(rows[:, 2]).tolist():
        of = np.flatnonzero(rows[:, 2] == q)
        for r in prime_divisors(q):
            part = np.full(len(of), q // r)
            keep[of] &= ~shifts.same(rows[of, 0], part, rows[of, 1] - part)
    return keep


# -- documents ---------------------------------------------------------------------------------------


def periodic_runs(docs: DataFrame, carry: str = "doc_id", least: int = 6, times: int = 4) -> DataFrame:
    """The column `carry` of docs(text, ...) with runs (array of start, length, period in words), and collapsed, the text's
    words joined by single spaces without those that a run holds after its first period.

    Words are what lies between ASCII white space. A null or empty text has no words, no runs and an empty collapsed text;
    repeated rows are searched each for itself, an empty table gives an empty one, and other columns are left out. The texts
    of a slice of 8 MB are one sequence with a unique element between them, which no run can hold; a longer text is a slice
    of its own. Nothing is shuffled.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            words = [t.split() for t in utf8(batch)]
            ids: dict[bytes, int] = {}
            sizes = np.array([len(w) for w in words], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            x = np.empty(int(sizes.sum()) + len(words), np.int64)
            for at, w in zip(first.tolist(), words, strict=True):
                x[at : at + len(w)] = [ids.setdefault(k, len(ids)) for k in w]
            x[first + sizes] = len(ids) + np.arange(len(words))
            rows = runs_of(x, int(sizes.max(initial=0)), least, times)
            gone = np.zeros(len(x) + 1, np.int64)
            np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
            np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
            stays = np.cumsum(gone)[:-1] == 0
            text = []
            for at, w in zip(first.tolist(), words, strict=True):
                own = stays[at : at + len(w)]
                text.append(b" ".join(w if own.all() else [w[i] for i in np.flatnonzero(own).tolist()]))
            of = np.searchsorted(first, rows[:, 0], "right") - 1
            cuts = np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(rows[:, 0] - first[of]), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(carry), pa.ListArray.from_arrays(pa.array(cuts), spans), pa.array(text, pa.binary()).cast(pa.string())], [carry, "runs", "collapsed"])

    slim = docs.select(carry, "text")
    return slim.mapInArrow(search, slim.select(carry, F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema)


def looped(doc_id: Column, text: Column) -> Column:
    """The words of text joined by single spaces, every word from a place on replaced by those of one period; both are drawn from crc32(doc_id)."""
    words = F.filter(F.split(text, "[\x20\x09-\x0d]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(F.crc32(doc_id.cast("string")) / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs(docs.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, looped(F.col("doc_id"), F.col("text"))).otherwise(F.col("text"))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"), F.floor(-F.col("best.less") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
