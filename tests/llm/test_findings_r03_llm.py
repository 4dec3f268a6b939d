"""What round 3's findings on the corpus operators found."""

import random

import public_tokenizers
import pytest
import regex

from veridag.llm import common
from veridag.llm.tokens import Monoid

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_pieces_of_words_get_no_ids():
    """op7: every leaf encoded the pieces of words at both of its ends, which the join above encoded again as one word."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 12))) for _ in range(400))
    monoid, seen = Monoid(RANKS), set()
    ids = monoid.ids
    monoid.ids = lambda match: seen.add(match) or ids(match)
    assert monoid.encode(text) == monoid.encoder.plain.encode_ordinary(text)
    assert seen <= set(regex.findall(public_tokenizers.PATTERN, text))


@pytest.mark.parametrize("leaf", [1, 2, 3, 5, 64])
def test_joins_of_any_leaves(leaf):
    """op7: spaces, apostrophes, digits and single characters at seams give the ids of the whole text."""
    rng, monoid = random.Random(leaf), Monoid(RANKS)
    for _ in range(400):
        text = "".join(rng.choices(["a", "ll", "'", "'s", " ", "  ", "\n", "7", "-", "é", "日", "don't", " x"], k=rng.randint(0, 60)))
        assert monoid.encode(text, leaf) == monoid.encoder.plain.encode_ordinary(text), repr(text)


def smallest(links):
    """The smallest id that each end reaches."""
    low = {x: x for ab in links for x in ab}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


@pytest.mark.parametrize("few", [1 << 17, 20, 0])
def test_components_however_many_edges_are_few(spark, few):
    """pipeline: paths, stars, cycles and random edges give the same with minima broadcast or merged."""
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(200, i) for i in range(201, 230)]
    links = path + star + [(5, 4), (4, 5), (7, 7)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    got = common.components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), few=few)
    assert {r["id"]: r["component"] for r in got.collect()} == smallest([x for x in links if x[0] != x[1]])
    assert common.components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_stars_end_after_one_round(spark, monkeypatch):
    """pipeline: on check_h each round is some hundreds of tasks a shuffle, whose records filled the driver; one round more only
    showed that nothing moved, and a round shuffled its edges six times."""
    made, keep = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df: made.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or keep(df))
    links = spark.createDataFrame([(0, i) for i in range(1, 50)], "a long, b long")
    assert common.components(links).where("component = 0").count() == 50
    assert len(made) == 2 and made[1] <= 4
