"""Main text: the given pages by a plain pattern of their layout, block rules one by one, labels against all neighbours."""

import html
import random
import re

import pytest

from sentrygrid.llm import html_text as H

PROSE = "It was the first day of the year and all of the people in the town had come to the market to see what there was. "


def by_layout(page):
    """The article of the given pages, whose layout is known."""
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(p for p in parts if p)


def test_query_over_its_table(spark):
    from sentrygrid.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/pages.parquet").collect()
    found = {r["page_id"]: r for r in QUERIES["op12_html_text"](spark, d).collect()}
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["page_id"]]["text"] == by_layout(r["html"])
        assert found[r["page_id"]]["url"] == r["url"] and found[r["page_id"]]["n_chars"] == len(by_layout(r["html"]))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>Hello", "Hello"),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>A &lt;b&gt;</h1><p>One<br>two<br><br>three &eacute;t&#233; &am</article>", "A <b>\nOne two\nthree été &am"),
        ("<article><p>a\n\t b&nbsp; c<p>d <b>e</b>f<i> g</i></article>", "a b c\nd ef g"),
        ("<article><p>x < y and 1<2</p><!-- <p>no</p> --><!--> <p>y</p></article>", "x < y and 1<2\ny"),
        ("<script>var t='</p><article>no</article>';</script><article>yes<style>p{}</style><script>no</SCRIPT >!</article>", "yes!"),
        ("<article>a<script>never ends <p>b</p>", "a"),
        ("<article>a<p title='>' data=x>b</p><p c", "a\nb"),
        ("<title>T</title><nav>menu</nav><article>t<aside>side</aside>u<form>f<input></form>v<footer>foot</footer></article><footer>x</footer>", "t\nu\nv"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Text.</p></article>", "Title\nText."),
        ("<article><p>Body.</p><div class='comments'><p>" + PROSE * 3 + "</p></div></article><section id=disqus_thread><p>" + PROSE + "</p></section>", "Body."),
        ("<article><p>a<span class='ad'>b<span>c</span>d</span>e</p><p hidden>f</p><p style='display: none'>g</p></article>", "a\ne"),
        ("<article><p>See <a href=x>this</a> for the rest of it.</p><ul><li><a href=y>Other page</a></ul></article>", "See this for the rest of it."),
        ("<main><p>In main.</p></main><div role=navigation>x</div><div class=cookie-notice><p>" + PROSE + "</p></div>", "In main."),
        (f"<div><a href=1>one</a> <a href=2>two</a></div><div><h2>Head</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div>&copy; 2020</div><div>tail</div>", f"Head\n{PROSE.strip()}\nShort.\n{PROSE.strip()}"),
        (f"<div class='page has-sidebar'><p>{PROSE}</p></div>", PROSE.strip()),
    ],
)
def test_rules(page, text):
    assert H.main_text(page) == text


def test_labels_against_all_neighbours(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(H, "_first_label", lambda b, _: b.text)
    for _ in range(500):
        n = rng.randrange(1, 9)
        blocks = [H.Block(rng.choice(["good", "bad", "short", "middling"]), 0.0, rng.random() < 0.2, rng.randrange(3), "") for _ in range(n)]
        for i, b in enumerate(H.label_blocks(blocks)):
            if b.text in ("good", "bad"):
                assert b.label == b.text
                continue
            sides = [[j for j in range(i) if blocks[j].text in ("good", "bad")][-1:], [j for j in range(i + 1, n) if blocks[j].text in ("good", "bad")][:1]]
            near = [j for s in sides for j in s]
            if not near:
                assert b.label == "good"
            elif b.heading and sides[1]:
                assert b.label == blocks[sides[1][0]].text
            else:
                far = {j: abs(i - j) + 1000 * (blocks[j].container != b.container) for j in near}
                labels = {blocks[j].text for j in near if far[j] == min(far.values())}
                assert b.label == (labels.pop() if len(labels) == 1 else "good" if b.text == "middling" else "bad")


def test_long_and_broken_pages_take_linear_time():
    for page in ("<" * 300_000, "<p " * 100_000, "<a b='" * 60_000, "<!--" * 100_000, "<div>" * 50_000 + "x", "<script>" * 50_000, "&" * 300_000, "<p>w " * 100_000, "</div>" * 100_000, "<span class=ad>" * 20_000 + "</b>" * 20_000):
        H.main_text(page)
    assert H.main_text("<article>" + "<p>w" * 100_000) == "\n".join(["w"] * 100_000)


def test_tables(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>Same", "x"), (1, "u", "<p>Same", "x"), (None, None, "<article>" + PROSE * 2000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract(df).collect()), key=str)
    long = (PROSE * 2000).strip()
    assert got == sorted([(1, "u", "", 0), (1, "u", "Same", 4), (1, "u", "Same", 4), (None, None, long, len(long))], key=str)
    assert [r["label"] for r in H.blocks(df).where("page_id is not null").collect()] == ["good", "good"]
    assert H.extract(df.limit(0)).count() == H.blocks(df.limit(0)).count() == 0
