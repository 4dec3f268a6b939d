"""Spelling variants by an index of variable-length grams (operator 11)."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, slices, stored, table
from .lines import utf8

RUN = re.compile("[a-zÀ-ÿ]+")
SHORT, LONG = 2, 4  # lengths of grams
MIN_CHARS = 2 * SHORT + 2  # from here on, one edit leaves a gram alone
NODES = 1 << 14  # a length's frequent grams are at most so many
WIDE = 64  # code points of a word up to which Spark's own distance is quick
BLOCK = 4096  # rows of a gram's list that meet in one task
HELD = 1 << 18  # words or grams that a task counts before it hands them on
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
POSTINGS = pa.schema([("key", pa.int64()), ("role", pa.int8()), ("word", pa.string()), ("n", pa.int64()), ("sign", pa.int64())])
SAME, SHORTER, LONGER = 0, 1, 2


# -- words -------------------------------------------------------------------------------------------


def flushed(held: Counter) -> Iterator[pa.RecordBatch]:
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTS)
        held.clear()


def count_words(docs: DataFrame, least_chars: int = MIN_CHARS, least_n: int = 5, every: int = 0) -> DataFrame:
    """(word, n): the words of docs(doc_id, text, ...), A-Z in lower case, of least_chars code points or more and with least_n or more occurrences.

    Where `every` divides the crc32 of "<doc_id>:<word>", the word loses one of its letters first, as a test of the operator
    asks; rows with a null doc_id keep theirs. A null or empty text has no words; rows that are repeated count each. Words
    are added up in each task before they are shuffled, so a frequent one is a row for each task.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in (s for b in batches for s in slices(b, "text")):
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch), strict=True):
                low, seed = text.lower().decode(), zlib.crc32(f"{doc}:".encode())
                found = RUN.findall(low) if len(low) < 1 << 22 else (m[0] for m in RUN.finditer(low))
                for word, k in Counter(found).items():
                    if len(word) >= least_chars:
                        if every and doc is not None and not (h := zlib.crc32(word.encode(), seed)) % every:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < least_chars:
                                continue
                        held[word] += k
                if len(held) >= HELD:
                    yield from flushed(held)
        yield from flushed(held)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# -- variable-length grams ---------------------------------------------------------------------------


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """Grams of SHORT to LONG code points that stand in more than a NODES-th of all places, with their counts: at most NODES of each length."""
    places = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                for q in range(SHORT, LONG + 1):
                    held.update(w[p : p + q] for p in range(len(w) - q + 1))
                if len(held) >= HELD:
                    yield from flushed(held)
        yield from flushed(held)

    often = words.select("word").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > max(8, places / NODES))
    return {r["word"]: r["n"] for r in often.collect()}


def grams(word: str, longest: int, often: dict[str, int]) -> list[tuple[int, int]]:
    """The gram that starts at each place, as (start, end): as short as SHORT, longer as long as it is frequent and shorter than `longest`.

    What a gram is depends on its own code points alone, but for a frequent one that the word's end cuts.
    """
    out, n = [], len(word)
    for p in range(n - SHORT + 1):
        e = p + SHORT
        while e < n and e - p < longest and word[p:e] in often:
            e += 1
        out.append((p, e))
    return out


def affected(word: str, spans: list[tuple[int, int]], longest: int, often: dict[str, int], role: int) -> int:
    """The most grams that one edit can change: those over a replaced or deleted code point, or, for the shorter word of two,
    those over the gap where one is inserted; behind the end, those that the end has cut."""
    d = [0] * (len(word) + 2)
    for p, e in spans:
        d[p + (role == SHORTER)] += 1
        d[e] -= 1
    most = at = 0
    for x in d:
        at += x
        most = max(most, at)
    if role == SHORTER:
        most = max(most, sum(e == len(word) and e - p < longest and word[p:e] in often for p, e in spans[-longest:]))
    return most


def sign(word: str) -> int:
    """64 bits for the letters and pairs of letters in a word; one edit changes at most six of them."""
    out = 0
    for c in word:
        out |= 1 << ord(c) % 24
    for a, b in zip(word, word[1:], strict=False):
        out |= 1 << 24 + (ord(a) * 31 + ord(b)) % 40
    return out - (1 << 64) if out >> 63 else out


def postings(words: DataFrame) -> DataFrame:
    """(key, role, word, n, sign): the grams through which a word can meet words one edit away.

    A pair's grams are as long as its shorter word's length m allows (at most m / 2, so that one edit leaves two of m - 1 at
    least). With V grams of which an edit changes at most A, a word shares V - A with its partner, so the A + 1 rarest of each
    must have one in common. Equal lengths meet at equal places; a longer word's grams stand where the shorter one's do or one
    place behind.
    """
    often = words.sparkSession.sparkContext.broadcast(frequent_grams(words))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = often.value
        for batch in batches:
            out: list[tuple] = []
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                of = sign(w)
                for role, m in ((SAME, len(w)), (SHORTER, len(w)), (LONGER, len(w) - 1)):
                    if m < MIN_CHARS:
                        continue
                    longest = min(m // 2, LONG)
                    spans = grams(w, longest, known)
                    most = affected(w, spans, longest, known, role) + 1
                    for _, gram, p in heapq.nsmallest(most, ((known.get(w[p:e], 0), w[p:e], p) for p, e in spans)):
                        for at in (p, p + 1) if role == SHORTER else (p,):
                            key = xxhash.xxh3_64_intdigest(f"{role > SAME}:{m}:{at}:{gram}".encode())
                            out.append((key - (1 << 64) if key >> 63 else key, role, w, n, of))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), POSTINGS, strict=True)] if out else [pa.array([], f.type) for f in POSTINGS], schema=POSTINGS)

    return words.mapInArrow(post, "key long, role byte, word string, n long, sign long")


def one_edit(s: str, t: str) -> bool:
    """Whether one inserted or replaced code point turns s into t, the longer one if they differ in length."""
    low, high = 0, len(s)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if s[:mid] == t[:mid] else (low, mid - 1)
    return s != t and s[low + (len(s) == len(t)) :] == t[low + 1 :]


def confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        yield batch.filter(pa.array([one_edit(*sorted(p, key=len)) for p in pairs], pa.bool_()))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair of words(word, n) that differ by one inserted, deleted or replaced code point both ways round.

    Lists of grams are joined by their keys. A list of more than BLOCK rows is cut into blocks by a hash of the word; each
    block meets the whole list, so that no task reads a long list against itself.
    """
    rows = stored(postings(words))
    hot = stored(rows.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select("key", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts")))
    few = hot.count() <= 1 << 16
    rows = rows.join(F.broadcast(hot) if few else hot.hint("shuffle_merge"), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = rows.where(F.col("role") < LONGER).select("key", F.expr("cast(pmod(xxhash64(word), parts) as int)").alias("part"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("sign").alias("a_sign"), F.col("role").alias("a_role"))
    b = rows.where(F.col("role") != SHORTER).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("sign").alias("b_sign"))
    alike = (F.bit_count(F.col("a_sign").bitwiseXOR(F.col("b_sign"))) <= 6) & ((F.col("a_role") == SHORTER) | (F.col("a") < F.col("b"))) & ((F.length("b") > WIDE) | (F.levenshtein("a", "b", 1) == 1))
    met = a.join(b.hint("shuffle_merge"), ["key", "part"]).where(alike).select("a", "a_n", "b", "b_n").distinct()
    pairs = stored(met)
    forget(hot)
    pairs = pairs.where(F.length("b") <= WIDE).unionByName(pairs.where(F.length("b") > WIDE).mapInArrow(confirmed, pairs.schema))
    return pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """words(word, n, any others) as (word, form, root, n, n_near, form_n), a row for each word.

    Two words are near if one inserted, deleted or replaced code point parts them. A word's form is its most frequent near
    word, the smallest of several, if that is `ratio` times as frequent or more; its root is what forms lead to at last.
    Rows of one word are added up, null words left out; words of fewer than MIN_CHARS code points have no near words, and an
    empty table gives an empty one. Forms grow by `ratio` at each step, so few rounds of doubling find all roots.
    """
    if ratio < 2:
        raise ValueError("forms could lead round in a circle")
    words = stored(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    best = near_words(words.where(F.length("word") >= MIN_CHARS)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    joined = words.join(best.hint("shuffle_merge"), "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    formed = stored(joined.select("word", F.when(F.col("has"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")))
    roots = stored(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("on"))
        after = stored(roots.join(on.hint("shuffle_merge"), "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        forget(roots)
        roots = after
        if not after.where("moved").count():
            break
    return formed.join(roots.select("word", "root").hint("shuffle_merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents"), every=199))
