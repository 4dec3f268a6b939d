"""Pages with an article are differenced too."""

import random

from veridag.llm import pages

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def page(i, words, extra="", head=None):
    return f"<body><div>Shop</div><h1>{head or f'Headline {i}'}</h1><article><p>Read on in our shop</p><p>{words}</p>{extra}</article><nav>menu</nav>"


def test_articles_are_differenced(spark):
    """Headlines outside an article stay, and lines that a host repeats go, inside the article too and on its first and last page."""
    rows = [(i, f"http://h.com/a/{i}", page(i, f"body of page {i} in some words")) for i in range(1, 6)]
    assert texts(spark, rows) == {i: f"Headline {i} body of page {i} in some words" for i in range(1, 6)}


def test_article_lines_of_one_neighbour_stay(spark):
    """A licence that two pages of a host have stays in both."""
    licence = "<p>Licensed under the terms below</p>"
    rows = [(i, f"http://h.com/a/{i}", page(i, f"body of page {i} in quite some more words", licence if i in (2, 3) else "")) for i in range(1, 6)]
    got = texts(spark, rows)
    assert got[2] == "Headline 2 body of page 2 in quite some more words Licensed under the terms below"
    assert got[3].endswith("Licensed under the terms below") and "Licensed" not in got[1] + got[4]


def test_copies_of_articles_stay(spark):
    """Between copies, what is shared isn't boilerplate; a copy's other neighbour still shows what is."""
    same = "the same article on two addresses of one host"
    rows = [(1, "http://h.com/a/1", page(1, same, head="H")), (2, "http://h.com/a/2", page(2, same, head="H")), (3, "http://h.com/b", page(3, "an article of another kind, long enough"))]
    assert texts(spark, rows) == {1: f"H {same}", 2: f"H {same}", 3: "Headline 3 an article of another kind, long enough"}
    alike = [(i, f"http://h.com/a/{i}", page(i, same, head="H")) for i in range(3)]
    assert set(texts(spark, alike).values()) == {f"Shop H Read on in our shop {same}"}


def test_neighbours(spark):
    """Partner and other neighbour against a sorted list, hosts over partition bounds."""
    rng = random.Random(3)
    keys = [(i, f"h{rng.randrange(9)}", f"/{rng.choice('abc')}/{rng.randrange(10**6)}") for i in range(200)] + [(200, "lone", "/"), (201, "two", "/a"), (202, "two", "/b")]
    got = {r["page_id"]: (r["partner"], r["other"]) for r in pages.partners(spark.createDataFrame(keys, "page_id long, host string, path string")).collect()}
    want = {}
    for host in {k[1] for k in keys}:
        line = sorted((p, i) for i, h, p in keys if h == host)
        for n, (p, i) in enumerate(line):
            near = [(len([1 for k in range(min(len(p), len(q))) if p[: k + 1] == q[: k + 1]]), -m, j) for m, (q, j) in enumerate(line) if abs(m - n) == 1]
            near = [x[2] for x in sorted(near, reverse=True)]
            if len(near) == 1 and len(line) > 2:
                near.append(line[2 if n == 0 else -3][1])
            if near:
                want[i] = (near + [None])[0], (near + [None])[1]
    assert got == want
