"""What round 3's findings on larger tables found."""

import random

import pytest
from pyspark.sql import functions as F

from veridag.operators import views
from veridag.operators.graph import ranks_within
from veridag.plans import fixpoint
from veridag.plans.fixpoint import Known, bfs, closure
from veridag.plans.staging import bucketed
from veridag.sources.testbed import Library
from veridag.streaming import refresh

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_rows_stay_in_their_buckets(spark):
    """What is known isn't shuffled in a round; before, all of it was in every round."""
    keep = lambda df: bucketed(df, "node")
    known = Known(keep(spark.range(100).selectExpr("cast(id as string) as node")), keep)
    df = spark.range(50, 150).selectExpr("cast(id as string) as node")
    assert plan_of(known.without(df, ["node"])).count("Exchange") == 1
    few = known.without(df, ["node"], few=True)
    assert "SortMergeJoin" not in plan_of(few)
    assert few.count() == known.without(df, ["node"]).count() == 50


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_are_the_same_however_many_rows_are_few(spark, monkeypatch, seed):
    """Rounds that broadcast, rounds that merge, and a mixture find the same."""
    rng = random.Random(seed)
    edges = spark.createDataFrame([(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)], "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n0",), ("n1",)], "node string")
    found = []
    for few in (1 << 17, 3, 0):
        monkeypatch.setattr(fixpoint, "FEW", few)
        found.append((sorted(map(tuple, bfs(seeds, edges).collect())), sorted(map(tuple, closure(seeds, edges).collect()))))
    assert found[0] == found[1] == found[2]


def test_places_in_a_hot_group(spark):
    """F16: a column's places don't come by a join on the column, which would be one task's for most nodes."""
    df = spark.range(2000).select(F.when(F.col("id") % 100 > 3, "hot").when(F.col("id") % 100 > 0, F.concat(F.lit("g"), F.col("id") % 7)).alias("col"), F.col("id").alias("node"))
    want, seen = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["node"]):
        seen[r["col"]] = seen.get(r["col"], 0) + 1
        want[r["node"]] = seen[r["col"]]
    for few in (1 << 16, 0):
        out = ranks_within(df, "col", [F.col("node")], few=few)
        assert {r["node"]: r["pos"] for r in out.collect()} == want
        assert "__part" in plan_of(out).split("Join")[1].split("\n")[0]


def test_rows_of_a_chain_are_written_once_a_round(spark, monkeypatch):
    """a round wrote those that end and those that go on apart, and made its join twice for it."""
    made, keep = [], views.staged
    monkeypatch.setattr(views, "staged", lambda df: made.append(keep(df)) or made[-1])
    out = views.chain_up(Library(spark, SF))
    assert len(made) == out.agg(F.max("steps")).first()[0] + 1


def test_a_batch_of_a_stream_has_many_files(spark, monkeypatch, tmp_path):
    """three files held all containers, so three tasks wrote and read them."""
    monkeypatch.setattr(refresh, "own_folder", lambda spark: str(tmp_path))
    stream = refresh.as_stream(spark.range(1000).selectExpr("id"))
    assert len(list(tmp_path.glob("in/*.parquet"))) == 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = []
    stream.writeStream.foreachBatch(lambda df, n: sizes.append(df.count())).trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 3 and sum(sizes) == 1000
