"""Differencing on pages as they are given: what it may take away, and what not."""

import os
import random

import pytest

from fieldmark.llm import pages

SCHEMA = "page_id long, url string, html string"
GIVEN = "/root/testdata/sf0.01/pages.parquet"


def by_tags(page):
    """The text that tags and class names alone give."""
    own = pages.blocks(page or "")
    return [t for t, m in own if m] or [t for t, _ in own]


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="the tables are not here")
def test_given_pages_lose_no_line_of_an_article(spark):
    """Each line that differencing takes from a page is on most pages of its host; no title goes."""
    table = spark.read.parquet(GIVEN)
    rows = {r.page_id: r for r in table.collect()}
    hosts = {r.page_id: r.h for r in table.select("page_id", pages.host(table.url).alias("h")).collect()}
    lines = {k: by_tags(r.html) for k, r in rows.items()}
    removed = []
    for r in pages.extract(table).collect():
        left = r.text.split("\n\n") if r.text else []
        for line in lines[r.page_id]:
            if left and left[0] == line:
                left.pop(0)
            else:
                removed.append((r.page_id, line))
        assert not left
    for k, line in removed:
        on = [hosts[i] == hosts[k] and line in x for i, x in lines.items()]
        assert 2 * sum(on) > sum(h == hosts[k] for h in hosts.values())
    assert not {k for k, _ in removed} & {141, 172, 248}


def test_chance_lines_stay(spark):
    """Neighbours that share a short line, a bold sentence or a title by chance keep it; a line of most pages goes."""
    r = random.Random(3)
    body = lambda k: "".join(f"<p>{' '.join(r.choice('abcdefgh') * r.randrange(1, 5) for _ in range(20))} {k}</p>" for _ in range(3))
    chance = {3: "<p>Yes.</p>", 4: "<p>Yes.</p>", 6: "<p><b>No more</b></p>", 7: "<p><b>No more</b></p>"}
    head = {8: "<h1>Same title</h1>", 9: "<h1>Same title</h1>"}
    made = {k: (head.get(k, f"<h1>Title {k}</h1>"), body(k)) for k in range(10)}
    rows = [(k, f"http://h.example/a/{k}", f"<title>x</title><article>{h}<p>Join our letter</p>{b}{chance.get(k, '')}</article>") for k, (h, b) in made.items()]
    got = {x.page_id: x.text.split("\n\n") for x in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, page in got.items():
        assert page == [x for x in by_tags(rows[k][2]) if x != "Join our letter"], k


def test_one_neighbour_is_no_evidence_in_an_article(spark):
    rows = [(k, f"http://h.example/{k}", f"<article><p>The same line</p><p>story {k} of many words</p></article>") for k in range(2)]
    rows += [(10 + k, f"http://plain.example/{k}", f"<p>The same line</p><p>story {k} of many words</p>") for k in range(2)]
    got = {x.page_id: x.text for x in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: f"The same line\n\nstory {k} of many words" for k in range(2)} | {10 + k: f"story {k} of many words" for k in range(2)}


def test_repeated_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(k % 5, f"http://h.example/{k % 5}", f"<p>Top of all</p><p>story {k % 5} is here</p>") for k in range(10)] + [(None, None, None), (None, None, None), (7, "http://h.example/7", None)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("h", "keep", "doubt", "line", "article", "main", "k1")})
    got = sorted((str(x.page_id), x.text) for x in pages.extract(table).collect())
    assert got == sorted([(str(k % 5), f"story {k % 5} is here") for k in range(10)] + [("None", ""), ("None", ""), ("7", "")])
