"""Pages whose neighbours are copies, empty, or without marked-up main text."""

import html
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dieflow.llm import html_main

SCHEMA = "page_id bigint, url string, html string"


def body(*own):
    return "<body><table><tr><td>Site name</td></tr></table>" + "".join(f"<p>{x}</p>" for x in own) + "<p>All rights reserved</p></body>"


def test_runs_of_equal_pages_are_differenced(spark):
    rows = [(k, f"http://h/a/{k}", body("Alpha")) for k in range(1, 6)] + [(6, "http://h/a/6", ""), (7, "http://h/a/7", body("Beta"))]
    rows += [rows[2], rows[2], (9, "http://alone/a", body("Gamma")), (10, "http://alone/b", body("Gamma"))]
    got = Counter((r.page_id, r.text) for r in html_main.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    alone = "Site name Gamma All rights reserved"
    assert got == Counter({(1, "Alpha"): 1, (2, "Alpha"): 1, (3, "Alpha"): 3, (4, "Alpha"): 1, (5, "Alpha"): 1, (6, ""): 1, (7, "Beta"): 1, (9, alone): 1, (10, alone): 1})


def test_differencing_decides_beside_an_article(spark):
    def teaser(*own):
        return body("<article>Teaser</article>", *own)

    rows = [(1, "http://h/1", teaser("The story itself", "<nav>Links of one</nav>")), (2, "http://h/2", teaser("Another story"))]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "Teaser The story itself", 2: "Teaser Another story"}


def lcs_by_hand(a, b):
    """Which of a's lines one longest common subsequence takes."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def texts_by_hand(rows):
    """{page_id: text} of pages made of (kind, text) lines, by the rule: kinds are p, article and nav."""
    host = lambda u: u.split("://")[1].split("/")[0]
    path = lambda u: "/" + u.split("://")[1].split("/", 1)[1]
    out = {}
    for name in {host(u) for _, u, _ in rows}:
        first = {}
        for i, u, body in rows:
            if host(u) == name:
                first[tuple(body)] = min(first.get(tuple(body), ("~", i)), (path(u), i))
        order = sorted((at, body) for body, at in first.items() if body)
        for k, (_, body) in enumerate(order):
            near = [order[k + o][1] for p in (1, 2, 4) for o in (-p, p) if 0 <= k + o < len(order)]
            votes = Counter(i for other in near for i in lcs_by_hand([t for _, t in body], [t for _, t in other]))
            kept = [t for i, (kind, t) in enumerate(body) if kind != "nav" and not (votes[i] and (votes[i] == len(near) >= 4 if kind == "article" else 2 * votes[i] > len(near)))]
            for i, u, same in rows:
                if host(u) == name and tuple(same) == body:
                    out[i] = " ".join(kept)
    return out


def test_pairing_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        own = [("article" if i % 3 else "p", f"story {i} {k} {rng.random()}") for k in range(rng.randrange(1, 4))]
        quoted = [("article", "a passage that some quote")] * (rng.random() < 0.4)
        inner = [("article", "read also our other stories")]
        advert = [("nav", f"buy {rng.randrange(10**6)}")]
        rows.append((i, f"http://h{i % 2 if i > 20 else 2}/d/{rng.randrange(10**4)}", [("p", "Site"), ("nav", "Links"), *advert, *own, *quoted, *inner, ("p", "All rights reserved")]))
    rows += [(1000 + i, u, body) for i, u, body in rng.sample(rows, 30)]
    tag = {"p": "<p>{}</p>", "article": "<article>{}</article>", "nav": "<nav>{}</nav>"}
    df = spark.createDataFrame([(i, u, "".join(tag[k].format(t) for k, t in body)) for i, u, body in rows], SCHEMA).repartition(3)
    want = texts_by_hand(rows)
    for chunk in (1024, 16):
        monkeypatch.setattr(html_main, "CHUNK", chunk)
        assert {r.page_id: r.text for r in html_main.extract(df).collect()} == want
    # The first and the last page of a host have three neighbours.
    assert sum("quote" in t for t in want.values()) > 40 > 15 > sum("read also" in t for t in want.values()) and not any("Site" in t for t in want.values())
    # Without the neighbours the texts differ.
    monkeypatch.setattr(html_main, "deleted", lambda *a: [])
    assert {r.page_id: r.text for r in html_main.extract(df).collect()} != want


def test_pages_without_article(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = d.withColumn("html", F.regexp_replace("html", r"</?article>", ""))
    pages = {r.page_id: r.html for r in d.collect()}
    got = {r.page_id: r.text for r in html_main.extract(bare).collect()}
    right = 0
    for i, t in pages.items():
        inner = re.search(r"<article>(.*)</article>", t, re.S)[1]
        right += got[i] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(p|br|h1|/h1|/p)>", " ", inner))).split())
    assert right > 0.97 * len(pages)


def test_copies_look_further(spark):
    def page(body, k):
        return f"<body><div>Site name</div><div>{body}</div><p class='share-box'>{k}</p><div>Contact</div></body>"

    rows = [(k, f"http://h/{k:04d}", page("The copied story", k) if k < 30 else page(f"Story {k}", k)) for k in range(80)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == ("The copied story" if k < 30 else f"Story {k}") for k in (0, 5, 15, 29, 35, 79))


def test_names_that_mark():
    for name, off in (("share-buttons", True), ("share-prices", False), ("ad", True), ("article-comments-2", False), ("comments-section", True), ("Sidebar left", True), ("bottom", False), ("main", False)):
        assert html_main._aside("div", f' class="{name}"') is off, name
    assert html_main.main_text("<p>x <math><mi>y</mi></math> <svg><title>t</title><text>z</text></svg>") == "x y z"


def test_cost_of_long_pages():
    began = time.perf_counter()
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 20_000), rng.integers(0, 2, 20_000)
    same = np.zeros(50_000, dtype=np.int64)
    assert html_main.shared_lines(same, np.append(1, same[1:])).sum() == 49_999 and html_main.shared_lines(a, b).sum() > 15_000
    assert len(html_main.lines("<div>" * 40_000 + "x" + "</div>" * 40_000)) == 1
    assert len(html_main.lines("<main>" + "<div>" * 20_000 + "<h2>x</h2>" * 20_000)) == 20_000
    assert time.perf_counter() - began < 20


def test_halving_finds_a_longest_one():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(2) for _ in range(rng.randrange(150, 260))] for _ in range(2))
        places = html_main._common(a, b)
        rest = iter(b)
        assert len(places) == len(lcs_by_hand(a, b)) and all(any(a[i] == y for y in rest) for i in places) and places == sorted(set(places))


def test_many_shared_lines_cost_in_proportion(spark):
    def took(n):
        menu = "".join(f"<p>line {i}</p>" for i in range(n))
        rows = [(k, f"http://h/{k}", f"<body>{menu}<p>Story {k}</p></body>") for k in range(2)]
        df = spark.createDataFrame(rows, SCHEMA)
        began = time.perf_counter()
        assert {r.page_id: r.text for r in html_main.extract(df).collect()} == {0: "Story 0", 1: "Story 1"}
        return time.perf_counter() - began

    took(10)
    assert took(80_000) < 20
