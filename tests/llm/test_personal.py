"""Personal data against the plain patterns, and what the method adds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veridag.llm import personal


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
]


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m[0]))


def spans(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    own = personal.joined(F.filter("spans", lambda s: s["base"]))
    return {r["doc_id"]: (r["base"], r["all"]) for r in personal.personal_spans(df).select("doc_id", own.alias("base"), personal.joined(F.col("spans")).alias("all")).collect()}


def test_base_spans(spark):
    rng = random.Random(3)

    def number(n):
        d = "".join(rng.choice("0123456789") for _ in range(n - 1))
        return next(d + c for c in "0123456789" if luhn(d + c))

    bits = ["a@b.c", "x.y@z-1.co.uk", "@", "a@b@c.d", ".", "1.2.3.4", "256.1.1.1", "000255.1.1.01", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824", "+", "+1", "(((", " ", "-", "é", "\n", "a_b", "_w@q.r", "99", "7", "1234567"]
    texts = [None, "", "x" * 3000, "1" * 3000, "a@" * 900, "a.b@c." * 3000, "+1" + " 2" * 1000, "1." * 2000, "+1((((" * 500, "4111111111111111 4012888888881881"]
    texts += ["".join(rng.choice(bits) if rng.random() < 0.8 else number(rng.choice([13, 15, 16, 17, 19, 20])) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == base(t), t
    assert got[9] == ("", "card:0:16,card:17:33")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("iban DE89 3704 0044 0532 0130 00 IS ok", "iban:5:32"),
        ("GB82WEST12345698765432", "iban:0:22"),
        ("GB82WEST12345698765433", ""),
        ("my ssn 123-45-6789", "ssn:7:18"),
        ("123-45-6789", ""),
        ("routing number 021000021", "routing:15:24"),
        ("routing number 021000022", ""),
        ("1 378282246310005", "card:2:17"),
        ("serial 378282246310005", ""),
    ],
)
def test_checksums_and_context(spark, text, want):
    assert spans(spark, [text])[0] == ("", want)


def test_offsets_of_many_matches(spark):
    text = "é a@b.c " * 1300
    assert spans(spark, [text])[0][0] == base(text)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.cc", 1), (1, "a@b.cc", 1), (None, None, None), (None, "a@b.cc", 2), (2, "", 0)], "doc_id long, text string, value long")
    got = [(r[0], len(r[1])) for r in personal.personal_spans(docs).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (2, 0), (None, 0), (None, 1)]
    assert personal.personal_spans(docs.limit(0)).count() == 0
