from pyspark.sql import functions as F

from veridag.functions.refs import global_id, kind_by_prefix, local_refs, ref_form, ref_key, ref_tid, short_text, valid_rects


def test_forms(spark):
    want = {"c1": "local", "b3": "local", "oq2": "local", "t4": "local", "Weaire2000": "container", "Chen2021Sys": "container", "@aim": "container", "@aim:t1": "sharpened", "Chen2021Sys:m2": "sharpened", "batching-adds-latency": "broad", "c1x": "broad"}
    df = spark.createDataFrame([(k,) for k in want], "r string")
    got = {r[0]: r[1:] for r in df.select("r", ref_form(F.col("r")), global_id(F.lit("K"), F.col("r")), ref_key(F.col("r")), ref_tid(F.col("r")), kind_by_prefix(F.col("r"))).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["c1"][1] == "K:c1" and got["Chen2021Sys:m2"][1:4] == ("Chen2021Sys:m2", "Chen2021Sys", "m2")
    assert got["@aim:t1"][4] == "test" and got["batching-adds-latency"][4] is None


def test_lists_and_texts(spark):
    row = spark.range(1).select(
        local_refs(F.array(F.lit("c1"), F.lit("Kumar2020Net"), F.lit("m2"))),
        valid_rects(F.array(F.array(*map(F.lit, (0.0, 0.1, 1.0, 0.2))))),
        valid_rects(F.array(F.array(*map(F.lit, (0.0, 0.1, 1.2, 0.2))))),
        valid_rects(F.array().cast("array<array<double>>")),
        short_text(F.lit("a  b\n c"), 88),
        short_text(F.lit("abcdefghij"), 5),
    ).first()
    assert row[0] == ["c1", "m2"] and row[1:4] == (True, False, False) and row[4:] == ("a b c", "abcd…")
