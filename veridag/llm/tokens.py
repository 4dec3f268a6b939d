"""Byte-level BPE by a monoid of encoded spans (operator 7), and packing of token ids (operator 9)."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table

LEAF = 64  # characters of a leaf of the tree, and ids of one when decoding
LOOK = 3  # characters from its start that a match of the pattern sees, besides itself and the character behind it
KEPT = 1 << 18  # matches whose ids a task remembers
#: Where single spaces don't bound the pattern's matches: white space on both sides, or before it and at the end.
ODD_SPACE = re.compile(r" (?:(?<=\s )(?:\s|\Z))")
#: Characters beyond these ranges are given to the tokenizers library itself.
PLAIN = re.compile(r"[\x00-ɏ]*\Z")
EASY = r"^[!-~¡-ɏ]+$"  # such units can be encoded in a row
ODD_LINE = re.compile(r"\n(?:\s|\Z|(?<=\A\n)|(?<=\s\n))")


class Encoder:
    """Ids of many texts at once: a text is cut at spaces that bound matches, and each distinct unit is encoded once."""

    def __init__(self, ranks_path: str, json_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for k, v in ranks.items():
            self.bytes[v] = k
        self.spaced = np.array([k[:1] == b" " for k in self.bytes])
        self.digits = [str(i) for i in range(size)]
        self.json, self.marks = None, None
        if json_path:
            from tokenizers import Tokenizer

            self.json = Tokenizer.from_file(json_path)
            added = [re.escape(t.content) for t in self.json.get_added_tokens_decoder().values()]
            self.marks = re.compile("|".join(added)) if added else None

    def narrow(self, *others: int) -> str:
        """The narrowest kind of number that holds every id, and others."""
        most = max(len(self.bytes), self.json.get_vocab_size() if self.json else 0, *(x + 1 for x in others))
        return "<u2" if most <= 1 << 16 else "<u4"

    def own(self, text: str) -> bool:
        """Does the text hold an added token's string, which has an id of its own in that library?"""
        return self.marks is not None and self.marks.search(text) is not None

    def one(self, text: str) -> np.ndarray:
        if self.json is not None and (self.own(text) or not PLAIN.match(text)):
            return np.array(self.json.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.plain.encode_ordinary(text), np.uint32)

    def _units(self, units: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of lead + each unit in one array, with each unit's start and size there."""
        start, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        fit = pc.match_substring_regex(units, EASY) if lead else pa.array(np.zeros(len(units), bool))
        easy, rest = np.flatnonzero(fit.to_numpy(zero_copy_only=False)), np.flatnonzero(~fit.to_numpy(zero_copy_only=False))
        row = np.array(self.plain.encode_ordinary(lead + lead.join(units.filter(fit).to_pylist())), np.uint32) if len(easy) else np.zeros(0, np.uint32)
        at = np.flatnonzero(self.spaced[row])
        assert len(at) == len(easy), "a token with an inner space"
        start[easy], size[easy] = at, np.diff(np.append(at, len(row)))
        held, n = [row], len(row)
        for i, u in zip(rest.tolist(), units.take(pa.array(rest)).to_pylist(), strict=True):
            held.append(self.one(lead + u))
            start[i], size[i] = n, len(held[-1])
            n += len(held[-1])
        return np.concatenate(held), start, size

    def many(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        lines, owner = [], []
        for i, t in enumerate(texts):
            if len(t) < 64 or ODD_SPACE.search(t) or self.own(t):
                out[i] = self.one(t)
            else:
                cut = [t] if ODD_LINE.search(t) else t.split("\n")  # a single line end between other characters is a match
                lines += cut
                owner += [i] * len(cut)
        if not lines:
            return out
        parts = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        head_at = parts.offsets.to_numpy()[:-1]
        flat, heads = parts.values.dictionary_encode(), parts.values.take(pa.array(head_at)).dictionary_encode()
        pool, start, size = self._units(flat.dictionary, " ")
        first, first_start, first_size = self._units(heads.dictionary, "")
        line_end = self.one("\n")
        n = len(flat.dictionary) + len(heads.dictionary)
        start, size = np.concatenate([start, first_start + len(pool), [len(pool) + len(first)]]), np.concatenate([size, first_size, [len(line_end)]])
        pool = np.concatenate([pool, first, line_end])
        codes = flat.indices.to_numpy().astype(np.int64)
        codes[head_at] = heads.indices.to_numpy().astype(np.int64) + len(flat.dictionary)
        owner = np.array(owner)
        again = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # lines before which a line end stands
        codes = np.insert(codes, head_at[again], n)
        head_at = head_at + np.cumsum(np.insert(owner[1:] == owner[:-1], 0, False))
        many = size[codes]
        end = np.cumsum(many)
        ids = pool[np.repeat(start[codes] - end + many, many) + np.arange(end[-1])]
        text_at = np.flatnonzero(np.insert(owner[1:] != owner[:-1], 0, True))
        cuts = np.append(0, end)[np.append(head_at[text_at], len(codes))]
        for i, a, b in zip(owner[text_at].tolist(), cuts, cuts[1:], strict=False):
            out[i] = ids[a:b]
        return out


class Kept(dict):
    """Ids of matches: those of up to LEAF characters are remembered, KEPT of them at most."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, match: str) -> tuple[int, ...]:
        out = tuple(self.encode(match))
        if len(match) <= LEAF:
            if len(self) >= KEPT:
                self.clear()
            self[match] = out
        return out


class Monoid:
    """Spans of text under concatenation. A span is the list of the pattern's matches in it and the list of their ids. The
    first and the last match may lack ids (None): most of them are pieces of words, which a join puts together first."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import regex

        self.encoder = encoder_of(ranks_path)
        pattern = regex.compile(public_tokenizers.PATTERN)
        self.matches, self.first = pattern.findall, pattern.match
        self.ids = Kept(self.encoder.plain.encode_ordinary).__getitem__

    def leaf(self, text: str) -> tuple[list[str], list[tuple[int, ...] | None]]:
        found = self.matches(text)
        if len(found) < 3:
            return found, [None] * len(found)
        return found, [None, *map(self.ids, found[1:-1]), None]

    def join(self, a: tuple[list, list], b: tuple[list, list]) -> tuple[list, list]:
        """The span of both texts. A match depends on the text from its start alone, and sees the character behind it and
        LOOK characters from its start. So all matches of a stand but those at its end that saw the end of a. From there a
        window over the seam is matched again; it grows until a match that doesn't see the window's end stops where one of
        b's begins: from that place on, b's matches and ids are those of the whole."""
        (left, left_ids), (right, right_ids) = a, b
        if not left or not right:
            return b if not left else a
        k = len(left) - 1
        tail = left[k]
        while k and len(tail) < LOOK:
            k -= 1
            tail = left[k] + tail
        m = 2
        while True:
            text = tail + "".join(right[:m])
            whole, size, seam = m >= len(right), len(text), len(tail)
            if not whole and size > LOOK and (end := self.first(text).end()) < size and end in (seam, seam + len(right[0])):
                new, i = [text[:end]], int(end > seam)  # most often one match ends at the seam, or with b's first
                break
            i, at, end, new = 0, seam, 0, []  # b's match i starts at `at`
            for match in self.matches(text):
                start, end = end, end + len(match)
                if not whole and (end >= size or start + LOOK > size):
                    at = -1
                    break
                new.append(match)
                while at < end and i < len(right):
                    at += len(right[i])
                    i += 1
                if at == end:
                    break
            if at == end:
                break
            m *= 2
        if not i and len(right) > 1 and right_ids[0] is None:  # it isn't the first any more
            right_ids[0] = self.ids(right[0])
        left[k:] = new
        left_ids[k:] = map(self.ids, new)
        left += right[i:]
        left_ids += right_ids[i:]
        return left, left_ids

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Halves are encoded recursively down to leaves, and joined up the tree."""

        def span(low: int, high: int) -> tuple[list, list]:
            if high - low <= leaf:
                return self.leaf(text[low:high])
            middle = (low + high) // 2
            return self.join(span(low, middle), span(middle, high))

        matches, ids = span(0, len(text))
        for i in {0, len(matches) - 1} if matches else ():
            if ids[i] is None:
                ids[i] = self.ids(matches[i])
        return list(itertools.chain.from_iterable(ids))

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        """The bytes of the ids, concatenated up the tree."""
        if len(ids) > leaf:
            middle = len(ids) // 2
            return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)
        return b"".join(map(self.encoder.bytes.__getitem__, ids))


@functools.cache
def encoder_of(ranks_path: str, json_path: str | None = None) -> Encoder:
    return Encoder(ranks_path, json_path)


@functools.cache
def monoid_of(ranks_path: str) -> Monoid:
    return Monoid(ranks_path)


def bpe_round_trip(docs: DataFrame, ranks_path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text), columns beyond these ignored.

    A null text counts as empty (no ids, hashes of nothing); a null doc_id is kept; repeated rows give repeated rows.
    A text is one task's work, of any length, and nothing is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid = monoid_of(ranks_path)
        for batch in (s for b in batches for s in slices(b, "text")):
            n, sha, back = [], [], []
            for text in batch.column("text").to_pylist():
                ids = monoid.encode(text or "", leaf)
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(monoid.encoder.digits.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(monoid.decode(ids, leaf)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def pack(docs: DataFrame, ranks_path: str, json_path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Concatenate and cut: pieces of docs(doc_id, text) in sequences of `length` ids.

    First pass: ids, and where each document starts within its partition, are written as a table. The partitions' totals
    (one number each) give the driver each partition's global offset. Second pass: fixed windows cut the ids; a document
    that crosses a window's end gives one piece on each side. Only the last sequence can be short.
    A null text counts as empty (its end id alone is packed); repeated rows are packed again; no rows give no rows.
    """

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_of(ranks_path, json_path), TaskContext.get().partitionId(), 0
        for batch in (s for b in batches for s in slices(b, "text")):
            ids = [np.append(x, end_id).astype(encoder.narrow(end_id)) for x in encoder.many([t or "" for t in batch.column("text").to_pylist()])]
            n = np.array([len(x) for x in ids], np.int64)
            low = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(low), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "part", "low", "n", "ids"])

    held = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, "doc_id long, part long, low long, n long, ids binary"))
    before, base = 0, {}
    for part, total in sorted((r[0], r[1]) for r in held.groupBy("part").agg(F.sum("n")).collect()):  # a row for each partition of the input
        base[part] = before
        before += total

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "ids")):
            rows: list[list] = [[] for _ in range(7)]
            for doc, part, low, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "low", "n", "ids")), strict=True):
                at, wide = base[part] + low, np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    for column, value in zip(rows, (doc, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]), n, sequence, offset), strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return held.mapInArrow(second, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_bpe_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
