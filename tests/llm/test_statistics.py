"""The learner's risk and the randomness battery against plain loops."""

import math
import random

import numpy as np
import pytest

from veridag.llm import secrets, toxicity


def plain_risk(positive, unlabelled, w, prior):
    """The two parts of the risk, document by document."""
    score = lambda r: sum(w[f] for f in r) / math.sqrt(max(1, len(r))) + w[-1]
    loss = lambda f: math.log1p(math.exp(-f))
    mean = lambda rows, sign: sum(loss(sign * score(r)) for r in rows) / len(rows)
    return prior * mean(positive, 1), mean(unlabelled, -1) - prior * mean(positive, -1)


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_risk_and_its_gradient(prior):
    """The gradient is that of the risk by small differences; where the bracket is below zero, it climbs the bracket."""
    rng, signs = random.Random(9), set()
    for _ in range(60):
        rows = [[sorted(rng.sample(range(6), rng.randint(0, 4))) for _ in range(rng.randint(1, 7))] for _ in range(2)]
        w = np.array([rng.uniform(-3, 3) for _ in range(7)])
        column = np.arange(6)
        p, u = (toxicity.Rows([np.array(r, np.int64) for r in side], column) for side in rows)
        first, bracket, g = toxicity.risk_gradient(p, u, w, prior)
        assert (first, bracket) == pytest.approx(plain_risk(*rows, w, prior), abs=1e-9)
        value = lambda x, below=bracket < 0: (lambda a, b: -b if below else a + b)(*plain_risk(*rows, x, prior))  # noqa: B023, E731
        for k in range(7):
            e = np.eye(7)[k] * 1e-5
            assert g[k] == pytest.approx((value(w + e) - value(w - e)) / 2e-5, abs=1e-6)
        signs.add(bracket < 0)
    assert signs == ({True, False} if prior > 0.5 else signs)


def normal_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(value):
    """n and p of a run of symbols, test by test."""
    body = value.translate(str.maketrans("-_", "+/")).rstrip("=")
    kinds = (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    abc = next((abc for _, abc in kinds if set(body) <= set(abc)), secrets.ALPHABETS["base64"])
    codes = [abc.index(c) for c in body.replace("=", "")]
    n, wide = len(codes), len(abc)
    if n < 16:
        return None
    cells = [sum(c * 8 // wide == b for c in codes) for b in range(8)]
    chi = sum((o - n / 8) ** 2 for o in cells) * 8 / n
    z_chi = ((chi / 7) ** (1 / 3) - (1 - 2 / 63)) / math.sqrt(2 / 63)
    mean = (wide - 1) / 2
    runs = 1 + sum((a > mean) != (b > mean) for a, b in zip(codes, codes[1:], strict=False))
    z_runs = (runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / ((wide * wide - 1) / 12) / math.sqrt(n - 1)
    return n, min(1.0, 3 * min(normal_tail(z_chi), 2 * normal_tail(abs(z_runs)), 2 * normal_tail(abs(serial))))


def test_randomness_battery(spark):
    """p-values within the error of the tail that the docstring states; words and steps are rejected, drawn symbols are not."""
    rng = random.Random(4)
    drawn = ["".join(rng.choice(abc) for _ in range(rng.randint(10, 90))) for abc in secrets.ALPHABETS.values() for _ in range(40)]
    odd = ["thequickbrownfoxjumpsoverthelazydog", "a" * 40, "ab" * 30, "0123456789abcdef" * 3, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "x=y=z" * 5, "a-b_c" * 8 + "=="]
    rows = [(i, v) for i, v in enumerate(drawn + odd)]
    got = {r["i"]: (r["n"], r["p"]) for r in secrets.randomness(spark.createDataFrame(rows, "i int, value string")).collect()}
    for i, v in rows:
        want = battery(v)
        assert (want is None) == (i not in got)
        if want:
            assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=0.0013), v
    small = {v for i, v in rows if i in got and got[i][1] < 0.01}
    assert {"a" * 40, "ab" * 30, "thequickbrownfoxjumpsoverthelazydog"} <= small and sum(v in small for v in drawn) <= 8


def test_false_discovery_limits(spark):
    """Within each family of lengths the rejected are those of the step-up procedure on p-values cut to steps."""
    rng = random.Random(6)
    rows = [(i, float(rng.choice([20, 30, 50, 70, 200])), rng.choice([rng.random(), rng.random() ** 6, 10 ** -rng.uniform(0, 9)])) for i in range(400)]
    kept = {r["i"] for r in secrets.still_random(spark.createDataFrame(rows, "i int, n double, p double"), 0.05).collect()}
    for family in (20.0, 30.0, 50.0, 70.0, 200.0):
        mine = [(i, min(399, math.floor(-math.log(max(p, 1e-12)) / 0.05))) for i, n, p in rows if n == family]
        by = sorted({s for _, s in mine}, reverse=True)
        fits = [s for s in by if math.exp(-0.05 * s) <= 0.05 * sum(t >= s for _, t in mine) / len(mine)]
        assert kept & {i for i, _ in mine} == {i for i, s in mine if not fits or s < min(fits)}
