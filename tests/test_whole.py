"""Operators give a row for each of theirs."""

import os
from collections import Counter

import duckdb
import pytest

from veridag.operators import bibliography
from veridag.plans import catalogue

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def sql(text):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(text).fetchall()


def letters(n):
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


def assign(wanted, taken):
    """One work after the other."""
    known, out = dict(taken), {}
    for doi, base, _ in sorted(wanted, key=lambda w: w[2]):
        mine = [n for n in range(1000) if doi is not None and known.get(base + letters(n), "") == doi]
        slot = mine[0] if mine else next(n for n in range(1000) if base + letters(n) not in known)
        known[base + letters(slot)] = out[doi] = base + letters(slot)
        known[base + letters(slot)] = doi
    return out


@given
def test_every_work_has_a_key(spark):
    """Past z too."""
    got = [tuple(r) for r in catalogue.queries()["M11_disambiguated"](spark, SF).select("doi", "ck").collect()]
    assert len(got) == 1500 == len({ck for _, ck in got})
    assert set(sql(catalogue.SQL["M11_disambiguated"])) == set(got)
    works = [(r["doi"], r["base"], r["seq"]) for r in catalogue.queries()["M10_base_key"](spark, SF).collect()]
    assert dict(got) == assign(works, {})


def test_taken_keys(spark):
    """800 works of one base pass z and zz; DOIs that have a key keep it in any spelling; taken keys of others are left."""
    wanted = [(f"10.1/w{i}", "Roe2001Auto", i) for i in range(800)] + [(f"10.1/v{i}", "Roe2002Auto", i) for i in range(3)]
    taken = {"Roe2001Auto": "10.1/w5", "Roe2001Autob": "10.1/other", "Roe2001Autoaa": None, "Roe2001Autozz": "10.1/w0", "Roe2002Autoa": "10.1/v0", "Roe2003": "10.1/w7"}
    spelt = [(ck, d and (f"https://doi.org/{d.upper()}")) for ck, d in taken.items()]
    got = bibliography.free_slots(spark.createDataFrame(wanted, "doi string, base string, seq long"), spark.createDataFrame(spelt, "ck string, doi string")).collect()
    assert len(got) == 803 and {r["doi"]: r["ck"] for r in got} == assign(wanted, taken)


@given
def test_keys_kept(spark):
    got = {r["doi"]: r["ck"] for r in catalogue.queries()["M17_keys_kept"](spark, SF).collect()}
    works = [(r["doi"], r["base"], r["seq"]) for r in catalogue.queries()["M10_base_key"](spark, SF).collect()]
    n, taken = Counter(), {}
    for doi, base, seq in sorted(works, key=lambda w: w[2]):
        if seq % 3 == 0:
            n[base] += 1
            taken[base + letters(2 * n[base] - 1)] = doi
    assert got == assign(works, taken)
