"""Incremental refresh (N): fingerprints, containers replaced as their documents change, lists and meters kept as state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import flagged
from ..plans.registry import operator
from ..plans.staging import fingerprint, shared_folder, staged
from ..sources.testbed import Library, long_edges


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@operator("N1_fingerprint", "select count(*) as rows from orders")
def source_fingerprint(lib: Library) -> DataFrame:
    """Rows of the orders' table in the files that its fingerprint counts; a file that the fingerprint lacks would be missing."""
    path = f"{lib.sf_dir}/orders.parquet"
    seen = fingerprint(lib.spark, path).where("files > 0 and bytes > 0 and newest is not null").select("files")
    files = lib.given("orders").select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    held = files.agg(F.count("*").alias("files"), F.sum("n").alias("rows"))
    return held.join(F.broadcast(seen), "files").select("rows")  # one row on either side


def as_stream(df: DataFrame, batches: int = 3) -> DataFrame:
    """df written to a folder of its own and read as a stream of files, in so many batches; a batch has as many files as shuffles
    have partitions, so that neither writing nor reading one is a single task's work."""
    spark = df.sparkSession
    path, n = own_folder(spark) + "/in", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(batches * n).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(path)


# -- containers --------------------------------------------------------------------------------------

SLICE = "array<struct<id:string,kind:string,axiom:boolean>>"
EDGE = "array<struct<src:string,field:string,ref:string>>"
CONTAINERS = f"ck string, version long, slices {SLICE}, edges {EDGE}"


def votes_of(slices: DataFrame, links: DataFrame) -> DataFrame:
    """(ck, slug, yes, no): a claim's votes on each broad node, one a side whatever the edges."""
    claims = slices.where("kind = 'claim'").select("ck", F.col("id").alias("src"))
    votes = links.where("form = 'broad' and field in ('leads_to', 'corroborates', 'contradicts')").join(claims.hint("shuffle_merge"), ["ck", "src"], "left_semi")
    against = (F.col("field") == "contradicts").cast("long")
    each = votes.groupBy("ck", F.col("ref").alias("slug"), "src").agg(F.max(1 - against).alias("yes"), F.max(against).alias("no"))
    return each.groupBy("ck", "slug").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


class LiveLibrary:
    """Containers with what is derived from each, kept current batch by batch in the shared folder.

    A batch takes the newest version of each container in it that is newer than the one held, and derives flags and votes for
    those alone: what a paper's claims rest on never leaves the paper, so no other container's flags can change. Broad nodes'
    meters lose the old votes of replaced containers and gain the new ones. Everything that a batch writes lies under its
    number, and what it compares with comes from earlier numbers, so a batch that runs again writes the same.
    """

    TABLES = {"log": "ck string, version long", "flags": "ck string, id string, kind string, is_floor boolean, borrowed boolean, grounded boolean, label string", "votes": "ck string, slug string, yes long, no long", "meter": "slug string, yes long, no long"}

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        for name, schema in self.TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/{name}/batch=-1")

    def read(self, name: str) -> DataFrame:
        schema = T._parse_datatype_string(self.TABLES[name] + ", batch long")
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/{name}").parquet(f"{self.base}/{name}")

    def write(self, name: str, n: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={n}")
        return self.read(name).where(F.col("batch") == n)

    def held(self, before: int | None = None) -> DataFrame:
        """(ck, version, batch): the newest version of each container, and the batch that brought it."""
        log = self.read("log") if before is None else self.read("log").where(F.col("batch") < before)
        return log.groupBy("ck").agg(F.max_by(F.struct("version", "batch"), "version").alias("r")).select("ck", "r.*")

    def current(self, name: str, before: int | None = None) -> DataFrame:
        return self.read(name).join(self.held(before).select("ck", "batch").hint("shuffle_merge"), ["ck", "batch"], "left_semi")

    def apply(self, batch: DataFrame, n: int) -> None:
        newest = batch.where("ck is not null").groupBy("ck").agg(F.max_by(F.struct(*batch.columns), "version").alias("r")).select("r.*")
        old = self.held(before=n).select("ck", F.col("version").alias("old"))
        taken = staged(newest.join(old.hint("shuffle_merge"), "ck", "left").where("old is null or version > old").drop("old"))
        slices = taken.select("ck", F.explode("slices").alias("s")).select("ck", "s.*")
        links = staged(long_edges(taken.select("ck", F.explode("edges").alias("e")).select("ck", "e.*")))
        flags = flagged(SimpleNamespace(slices=staged(slices), links=links))
        self.write("flags", n, flags.select(*T._parse_datatype_string(self.TABLES["flags"]).names))
        new = self.write("votes", n, votes_of(slices, links))
        gone = self.current("votes", before=n).join(taken.select("ck").hint("shuffle_merge"), "ck", "left_semi").select("slug", (-F.col("yes")).alias("yes"), (-F.col("no")).alias("no"))
        self.write("meter", n, new.select("slug", "yes", "no").unionByName(gone).groupBy("slug").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
        self.write("log", n, taken.select("ck", "version"))

    def meter(self) -> DataFrame:
        total = self.read("meter").groupBy("slug").agg(F.sum("yes").alias("support"), F.sum("no").alias("contradict"))
        return total.where("support > 0 or contradict > 0")

    def follow(self, stream: DataFrame) -> None:
        """Take all that a stream of containers(ck, version, slices, edges) has now."""
        stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start().awaitTermination()


def containers(slices: DataFrame, edges: DataFrame) -> DataFrame:
    """(ck, slices, edges): the frames' rows as lists, a row for each container."""
    a = slices.groupBy("ck").agg(F.collect_list(F.struct("id", "kind", "axiom")).alias("slices"))
    b = edges.groupBy("ck").agg(F.collect_list(F.struct("src", "field", "ref")).alias("edges"))
    return a.join(b.hint("shuffle_merge"), "ck", "left").withColumn("edges", F.coalesce("edges", F.array().cast(EDGE)))


def live(lib: Library) -> LiveLibrary:
    """Three versions of documents as they come: one slice alone, all slices, and for one in ten the first three lines, in any order."""
    if "live" not in lib.__dict__:
        whole = staged(containers(lib.slices, lib.edges))
        first = lambda x: F.regexp_extract(x, r"\d+$", 0).cast("int") <= 3
        short = whole.where(F.substring("ck", 4, 8).cast("int") % 10 == 0).select("ck", F.lit(3).cast("long").alias("version"), F.filter("slices", lambda s: first(s["id"])).alias("slices"), F.filter("edges", lambda e: first(e["src"])).alias("edges"))
        one = whole.select("ck", F.lit(1).cast("long").alias("version"), F.slice("slices", 1, 1).alias("slices"), F.array().cast(EDGE).alias("edges"))
        all_ = whole.select("ck", F.lit(2).cast("long").alias("version"), "slices", "edges")
        lib.live = LiveLibrary(lib.spark, own_folder(lib.spark) + "/library")
        lib.live.follow(as_stream(staged(one.unionByName(all_).unionByName(short))))
    return lib.live


KEPT_SQL = """
ls as materialized (select * from tb_slices where cast(substr(ck, 4, 8) as int) % 10 <> 0 or ln <= 3),
ll as materialized (select l.*, kind from tb_links l join ls on ls.ck = l.ck and ls.id = l.src),
fl as materialized (select ck, id from ls where axiom or kind = 'method' and not exists (select 1 from ll where ll.ck = ls.ck and ll.src = ls.id and field = 'grounded_in' and form = 'local')),
re(ck, id) as (select ck, id from fl union select ll.ck, ll.src from ll join re on ll.ck = re.ck and ll.ref = re.id where ll.field = 'grounded_in' and ll.form = 'local')"""


@operator("N2_live_rebuild", f"with recursive {KEPT_SQL} select ls.ck, count(*) as n, count(fl.id) as n_floor, count(*) filter (where kind = 'claim' and re.id is not null) as n_grounded from ls left join fl on fl.ck = ls.ck and fl.id = ls.id left join re on re.ck = ls.ck and re.id = ls.id group by ls.ck")
def live_rebuild(lib: Library) -> DataFrame:
    """Slices, floors and grounded claims of each container after all versions have come."""
    return live(lib).current("flags").groupBy("ck").agg(F.count("*").alias("n"), F.count_if("is_floor").alias("n_floor"), F.count_if("grounded").alias("n_grounded"))


@operator("N2_live_meter", f"with recursive {KEPT_SQL} select ref as slug, count(distinct gid) filter (where field <> 'contradicts') as support, count(distinct gid) filter (where field = 'contradicts') as contradict from ll where kind = 'claim' and form = 'broad' and field in ('leads_to', 'corroborates', 'contradicts') group by ref")
def live_meter(lib: Library) -> DataFrame:
    """The broad nodes' evidence at that point, by what each batch added and took away."""
    return live(lib).meter()


# -- lists -------------------------------------------------------------------------------------------


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state variables need."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LastCommand(StatefulProcessor):
    """Keeps the newest command of each key; older ones, and ones that come again, change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, active boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best = max(((int(s), bool(a)) for part in rows for s, a in zip(part["seq"], part["active"], strict=True)), default=None)
        if best is not None and (held is None or best[0] > held[0]):
            self.last.update(best)
            yield pd.DataFrame({"ck": [key[0]], "seq": [best[0]], "active": [best[1]]})

    def close(self) -> None:
        pass


def last_commands(stream: DataFrame, base: str) -> DataFrame:
    """(ck, seq, active) after all that a stream of commands(ck, seq, active) has now, read from the stream's own state."""
    spark = stream.sparkSession
    with rocks(spark):
        out = stream.groupBy("ck").transformWithStateInPandas(LastCommand(), "ck string, seq long, active boolean", "update", "none")
        out.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{base}/state")
        return staged(kept.select(F.col("key").getField("ck").alias("ck"), F.col("value.seq").alias("seq"), F.col("value.active").alias("active")))


@operator("N3_worklist_state", "select ck, active from (select ck, active, row_number() over (partition by ck order by seq desc) as r from tb_list_events) x where r = 1")
def worklist_state(lib: Library) -> DataFrame:
    """The last command for each key wins; replaying events changes nothing."""
    events = lib.list_events.select("ck", F.col("seq").cast("long").alias("seq"), "active")
    return last_commands(as_stream(staged(events)), own_folder(lib.spark)).select("ck", "active")


# -- meters ------------------------------------------------------------------------------------------

EVENTS = "gid string, slug string, field string, seq long, live boolean"


def sides(edges: dict) -> set[tuple[str, bool]]:
    """(slug, against) of a claim's votes: a side counts once while any edge of it lives."""
    return {(slug, field == "contradicts") for slug, fields in edges.items() for field, (_, live) in fields.items() if live}


def claim_votes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the votes of one group's claims; the group's state has the last event of each edge."""
    held = json.loads(state.get[0]) if state.exists else {}
    before: dict[str, set] = {}
    for part in parts:
        for gid, slug, field, seq, live in zip(*(part[c].tolist() for c in ("gid", "slug", "field", "seq", "live")), strict=True):
            edges = held.setdefault(gid, {})
            if gid not in before:
                before[gid] = sides(edges)
            fields = edges.setdefault(slug, {})
            if field not in fields or fields[field][0] < seq:
                fields[field] = [seq, live]
    state.update((json.dumps(held),))
    now = {gid: sides(held[gid]) for gid in before}
    changed = [(slug, against, d) for gid, old in before.items() for d, keys in ((1, now[gid] - old), (-1, old - now[gid])) for slug, against in keys]
    if changed:
        yield pd.DataFrame(changed, columns=["slug", "against", "change"])


def running_votes(stream: DataFrame, base: str, groups: int = 4096) -> DataFrame:
    """(slug, support, contradict) after all that a stream of edge events has now: EVENTS, where the last event of an edge says
    whether it lives.

    Two aggregates in a row. The first is keyed by claims, by a hash in `groups` groups, since a group costs a call of Python and
    a claim alone is little work; a group's state holds its share of the claims, so `groups` goes with their number. It
    writes what votes gain and lose, exactly once; the second adds that up by slug. Either starts again from its checkpoint, and the result is read from the second one's state.
    """
    spark = stream.sparkSession
    changed = "slug string, against boolean, change long"
    grouped = stream.withColumn("part", F.pmod(F.xxhash64("gid"), F.lit(groups)).cast("int")).groupBy("part")
    changes = grouped.applyInPandasWithState(claim_votes, changed, "held string", "append", GroupStateTimeout.NoTimeout)
    changes.writeStream.outputMode("append").format("parquet").option("path", f"{base}/changes").option("checkpointLocation", f"{base}/claims").trigger(availableNow=True).start().awaitTermination()
    total = spark.readStream.schema(changed).parquet(f"{base}/changes").groupBy("slug", "against").agg(F.sum("change").alias("n"))
    total.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{base}/slugs").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.format("statestore").load(f"{base}/slugs").select("key.*", "value.*").toDF("slug", "against", "n")
    side = lambda against: F.sum(F.when(F.col("against") == against, F.col("n")).otherwise(0))
    return kept.groupBy("slug").agg(side(False).alias("support"), side(True).alias("contradict")).where("support > 0 or contradict > 0")


@operator("N4_running_meter", """
select ref as slug, count(distinct gid) filter (where field in ('leads_to', 'corroborates')) as support, count(distinct gid) filter (where field = 'contradicts') as contradict
from tb_links l join tb_slices s on s.ck = l.ck and s.id = l.src and kind = 'claim' where form = 'broad' and field in ('leads_to', 'corroborates', 'contradicts') group by ref""")
def running_meter(lib: Library) -> DataFrame:
    """D6 from a stream of edges, with edges among them that are drawn in one event and withdrawn in a later one."""
    claims = lib.slices.where("kind = 'claim'").select("ck", F.col("id").alias("src"), "pk", "sk")
    votes = lib.links.where("form = 'broad' and field in ('leads_to', 'corroborates', 'contradicts')").join(claims.select("ck", "src").hint("shuffle_merge"), ["ck", "src"], "left_semi")
    real = votes.select("gid", F.col("ref").alias("slug"), "field", F.lit(3).cast("long").alias("seq"), F.lit(True).alias("live"))
    passing = claims.where("pk % 31 = 0").select(F.concat_ws(":", "ck", "src").alias("gid"), F.concat(F.lit("part-"), F.col("pk")).alias("slug"), F.lit("contradicts").alias("field"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("seq"), F.lit(True).alias("live")), F.struct(F.lit(2).cast("long").alias("seq"), F.lit(False).alias("live")))).alias("e"))
    events = real.unionByName(passing.select("gid", "slug", "field", "e.seq", "e.live"))
    return running_votes(as_stream(staged(events)), own_folder(lib.spark))
