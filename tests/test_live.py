"""Streams: containers replaced batch by batch, keyed lists and meters, against plain Python; restarts and replays."""

import random

import pytest
from pyspark.sql import functions as F

from veridag.operators.graph import flagged
from veridag.sources.testbed import long_edges
from veridag.streaming import refresh


def document(rng, ck, version):
    ids = [f"{'cmq'[rng.randrange(3)]}{i}" for i in range(rng.randint(0, 5))]
    kinds = {"c": "claim", "m": "method", "q": "question"}
    edges = [(rng.choice(ids), rng.choice(["grounded_in", "leads_to", "contradicts", "corroborates"]), rng.choice([*ids, "part-1", "part-2", "part-3", "Old1999X"])) for _ in range(rng.randint(0, 8))] if ids else []
    return (ck, version, [(i, kinds[i[0]], rng.random() < 0.2) for i in ids], sorted(set(edges)))


def rebuilt(spark, docs):
    """Flags and meter of the newest versions, all derived anew."""
    newest = {}
    for d in docs:
        if d[0] not in newest or newest[d[0]][1] < d[1]:
            newest[d[0]] = d
    df = spark.createDataFrame(list(newest.values()), refresh.CONTAINERS)
    slices = df.select("ck", F.explode("slices").alias("s")).select("ck", "s.*")
    links = long_edges(df.select("ck", F.explode("edges").alias("e")).select("ck", "e.*"))
    flags = flagged(type("", (), {"slices": slices, "links": links}))
    meter = refresh.votes_of(slices, links).groupBy("slug").agg(F.sum("yes").alias("support"), F.sum("no").alias("contradict"))
    return {tuple(r) for r in flags.select("ck", "id", "label", "grounded").collect()}, {tuple(r) for r in meter.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_live_library_equals_a_rebuild(spark, tmp_path, seed):
    rng, seen = random.Random(seed), []
    live = refresh.LiveLibrary(spark, f"file://{tmp_path}")
    for n in range(3):
        part = [document(rng, f"Ord{k:08d}X", rng.randint(1, 9) * 10 + n) for k in (rng.randrange(6) for _ in range(6))]
        part = list({(d[0], d[1]): d for d in part}.values())
        seen += part
        batch = spark.createDataFrame(part, refresh.CONTAINERS)
        live.apply(batch, n)
        got = {tuple(r) for r in live.current("flags").select("ck", "id", "label", "grounded").collect()}, {tuple(r) for r in live.meter().collect()}
        assert got == rebuilt(spark, seen)
    live.apply(batch, n)  # a batch that runs again
    assert got == ({tuple(r) for r in live.current("flags").select("ck", "id", "label", "grounded").collect()}, {tuple(r) for r in live.meter().collect()})
    live.apply(spark.createDataFrame(seen, refresh.CONTAINERS), n + 1)  # old versions that come again
    assert got[1] == {tuple(r) for r in live.meter().collect()}


def streamed(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_lists_survive_a_restart_and_a_replay(spark, tmp_path):
    schema, path, base = "ck string, seq long, active boolean", f"file://{tmp_path}/in", f"file://{tmp_path}/own"
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(5)}", i, rng.random() < 0.5) for i in range(40)]
    want = {}
    for at, part in enumerate((rows[20:], rows[:20], rows)):  # late ones, then all of them again
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        for ck, seq, active in part:
            if ck not in want or want[ck][0] < seq:
                want[ck] = (seq, active)
        got = refresh.last_commands(streamed(spark, path, schema), base)  # each run goes on from the checkpoint
        assert {r["ck"]: (r["seq"], r["active"]) for r in got.collect()} == want, at


def test_meter_counts_claims_and_forgets_withdrawn_edges(spark, tmp_path):
    path, base = f"file://{tmp_path}/in", f"file://{tmp_path}/own"
    rng = random.Random(4)
    fields = ["leads_to", "corroborates", "contradicts"]
    events = [(f"P:c{rng.randrange(6)}", f"part-{rng.randrange(3)}", rng.choice(fields), i, rng.random() < 0.6) for i in range(120)]
    rng.shuffle(events)
    seen = {}
    for part in (events[:50], events[50:], events[30:90]):
        spark.createDataFrame(part, refresh.EVENTS).coalesce(1).write.mode("append").parquet(path)
        for gid, slug, field, seq, live in part:
            if seen.get((gid, slug, field), (-1,))[0] < seq:
                seen[gid, slug, field] = (seq, live)
        votes = {(slug, gid, field == "contradicts") for (gid, slug, field), (_, live) in seen.items() if live}
        want = {s: (sum(v[0] == s and not v[2] for v in votes), sum(v[0] == s and v[2] for v in votes)) for s in {v[0] for v in votes}}
        got = refresh.running_votes(streamed(spark, path, refresh.EVENTS), base)
        assert {r["slug"]: (r["support"], r["contradict"]) for r in got.collect()} == want
