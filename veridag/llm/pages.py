"""Main text of web pages by differencing nearest pages of a host (operator 6)."""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Element names and words of class and id.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed".split())
BREAK = frozenset("address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
NEST = frozenset("article aside body button dialog div fieldset footer form head header html main menu nav ol section select span svg table ul".split())
LEAVE = frozenset("aside button dialog footer form head menu nav select svg".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies reply share sharing sidebar social sponsor sponsored subscribe widget".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
MAIN, PLAIN, OTHER = 2, 1, 0  # a block of an article, of no marked element, of what isn't the page's text


def left_out(name: str, attributes: str, in_article: bool) -> bool:
    if name in LEAVE or (name == "header" and not in_article):
        return True
    for key, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("body", "html", "article", "main") and not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of a page's blocks in order. Unclosed elements end with the one around them."""
    page = page or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    kind, held, at = PLAIN, [], 0

    def end() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, kind))

    while m := TOKEN.search(page, at):
        if m.start() > at:
            held.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1] and name in RAW:
            close = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in BREAK:
            end()
        if name not in NEST:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name == "span" and kind != stack[i][1]:
                        end()
                    kind = stack[i][1]
                    del stack[i:]
                    break
        elif not m[3].rstrip().endswith("/") or name not in ("span", "svg"):
            stack.append((name, kind))
            inner = kind
            if kind != OTHER:
                if left_out(name, m[3], kind == MAIN):
                    inner = OTHER
                elif name in ("article", "main"):
                    inner = MAIN
            if inner != kind:
                end()
                kind = inner
    held.append(html.unescape(page[at:]))
    end()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices in a of a longest common subsequence with b."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - high - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # the least end in b of a chain of each length
    links: list[tuple[int, int]] = []
    heads: list[int] = []
    for i in range(low, len(a) - high):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            links.append((i, heads[k - 1] if k else -1))
            ends[k : k + 1], heads[k : k + 1] = [j], [len(links) - 1]
    middle, at = [], heads[-1] if heads else -1
    while at >= 0:
        middle.append(links[at][0])
        at = links[at][1]
    return [*range(low), *reversed(middle), *range(len(a) - high, len(a))]


def main_text(texts: list[str], kinds: list[int], hashes: list[int], partner: list[int] | None, other: list[int] | None = None) -> str:
    """The blocks of a page that are its text. Lines that the partner shares are deleted; lines of an article element only
    if the host's other neighbour has them too, since corpora repeat licences and quotations there. A neighbour that
    shares more than half of the article is a copy, and its lines tell nothing. Where no line of unmarked blocks is left
    on a page without an article because the partner is a copy of the page, the shared lines stay."""
    shared = set(common_lines(hashes, partner)) if partner else set()
    if MAIN not in kinds:
        own = [t for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == PLAIN and i not in shared]
        return " ".join(own or [t for t, k in zip(texts, kinds, strict=True) if k == PLAIN])
    seen = set(other or ())
    common = {i for i in shared if hashes[i] in seen}
    size = {i: len(t) for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == MAIN}

    def copied(lines: set[int]) -> bool:
        return 2 * sum(n for i, n in size.items() if i in lines) > sum(size.values())

    if copied(common):
        common = set()
    lost = {MAIN: common, PLAIN: common if copied(shared) else shared}
    return " ".join(t for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k != OTHER and i not in lost[k])


def partners(keys: DataFrame) -> DataFrame:
    """(page_id, partner, other) for keys(page_id, host, path): the neighbour within the host, in the order of paths, whose
    path shares the longer beginning (the one before, where both share as much), and the neighbour on the other side, for
    a host's first and last page the one behind the partner. A host's pages may fill many partitions."""
    edge = "part long, n long, page_id long, host string, path string"

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(np.arange(n, n + batch.num_rows)), *batch.select(["page_id", "host", "path"]).columns], ["part", "n", "page_id", "host", "path"])
            n += batch.num_rows

    order = stored(keys.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id").mapInArrow(numbered, edge))
    ends = order.groupBy("part").agg(F.min_by(F.struct("page_id", "host", "path"), "n").alias("first"), F.max_by(F.struct("page_id", "host", "path"), "n").alias("last"), F.count("*").alias("size")).collect()  # one row for each partition
    ends = sorted(ends, key=lambda r: r["part"])
    before = {b["part"]: tuple(a["last"]) for a, b in zip(ends, ends[1:], strict=False)}
    after = {a["part"]: tuple(b["first"]) for a, b in zip(ends, ends[1:], strict=False)}
    last = {r["part"]: r["size"] for r in ends}

    def share(a: str, b: str) -> int:
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        return n

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(prior, row, following) -> tuple:
            options = [(share(o[2], row[2]), -k, o[0]) for k, o in enumerate((prior, following)) if o and o[1] == row[1]]
            return row[0], *([o[2] for o in sorted(options, reverse=True)] + [None, None])[:2]

        prior, row, part = None, None, None
        for batch in batches:
            found = []
            for p, n, *now in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "page_id", "host", "path")), strict=True):
                now = tuple(now)
                if row is not None:
                    found.append(best(prior, row, now))
                    prior = row
                else:
                    part, prior = p, before.get(p)
                row = now
                if n == last[p] - 1:
                    found.append(best(prior, row, after.get(p)))
                    prior, row = None, None
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["page_id", "partner", "other"])

    # a file of the table holds one partition in order; it is read whole, so that neighbours meet
    whole = order.repartition("part").sortWithinPartitions("part", "n")
    near = stored(whole.mapInArrow(pick, "page_id long, partner long, other long").where("partner is not null").dropDuplicates(["page_id"]))
    behind = near.select(F.col("page_id").alias("partner"), F.array("partner", "other").alias("next"))
    far = near.where("other is null").select("page_id", "partner").join(behind, "partner").select("page_id", F.get(F.filter("next", lambda p: p != F.col("page_id")), F.lit(0)).alias("far"))
    return near.join(far, "page_id", "left").select("page_id", "partner", F.coalesce("other", "far").alias("other"))


def line_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html), other columns ignored.

    Pages are paired with the page of their host whose URL path is nearest, their lines (blocks) are aligned by longest
    common subsequence, and shared lines are deleted (see main_text for lines of articles and copies); elements that say
    they aren't the article go in any case. A null or empty html gives an empty text; a null url stands for a host of its own; a null page_id has no partner; repeated
    rows give repeated rows.
    """

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "html", 4 << 20)):
            hosts, paths, hashes = [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
                hosts.append(m[1].lower() if m else "")
                paths.append(m[2] if m else (url or ""))
                hashes.append([line_hash(t) for t, _ in blocks(page)])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], ["page_id", "host", "path", "hashes"])

    def squeezed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages as compressed blocks: what is shuffled is smaller than the pages themselves."""
        for batch in (s for b in batches for s in slices(b, "html", 4 << 20)):
            found = [blocks(page) for page in batch.column("html").to_pylist()]
            body = [zlib.compress("\n".join(t for t, _ in f).encode(), 6) for f in found]  # a block has no line end inside
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(body, pa.binary()), pa.array([bytes(k for _, k in f) for f in found], pa.binary())], ["page_id", "url", "body", "kinds"])

    source = pages.select(F.col("page_id").cast("long"), "url", "html")
    held = stored(source.where("page_id is not null").mapInArrow(lines, "page_id long, host string, path string, hashes array<long>"))
    pairs = stored(partners(held.select("page_id", "host", "path")))
    other = held.select(F.col("page_id").alias("partner"), F.col("hashes").alias("theirs")).dropDuplicates(["partner"])
    both = F.explode(F.array(F.struct(F.lit(True).alias("near"), "partner"), F.struct(F.lit(False).alias("near"), F.col("other").alias("partner")))).alias("n")
    asked = pairs.select("page_id", both).select("page_id", "n.*").where("partner is not null")
    of = lambda near: F.any_value(F.when(F.col("near") == near, F.col("theirs")), F.lit(True))
    of_partner = asked.join(other.hint("shuffle_merge"), "partner").groupBy("page_id").agg(of(True).alias("theirs"), of(False).alias("others"))
    of_partner = of_partner.select("page_id", "theirs", F.array_intersect("theirs", "others").alias("others"))
    joined = source.mapInArrow(squeezed, "page_id long, url string, body binary, kinds binary").join(of_partner.hint("shuffle_hash"), "page_id", "left")

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, kinds, theirs, others in zip(*(batch.column(c).to_pylist() for c in ("body", "kinds", "theirs", "others")), strict=True):
                texts = zlib.decompress(body).decode().split("\n") if kinds else []
                out.append(main_text(texts, list(kinds), [line_hash(t) for t in texts], theirs, others))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(choose, "page_id long, url string, text string, n_chars long")


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
