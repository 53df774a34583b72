"""Main text of pages: the given ones against a reading of their article, made ones of other shapes, odd inputs."""

import html as entities
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import mainpage, queries
from millrace.llm.mainpage import main_text

WORDS = "The quick brown fox jumps over the lazy dog near the old river bank at noon."
PARAGRAPHS = [f"{WORDS} Part {k}, and then some more words follow it." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n".join(PARAGRAPHS)
LINKS = "".join(f'<li><a href="/{k}">Menu entry {k}</a></li>' for k in range(8))


def article(page):
    """Brute force for the given pages: blocks of their one article element."""
    out = []
    for block in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S)[1]):
        out.append(" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", block)).split()))
    return "\n".join(b for b in out if b)


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    want = {r[0]: (r[1], article(r[2])) for r in duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()}
    got = queries.QUERIES["op13_html_extraction"](spark, sf).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><ul>{LINKS}</ul></nav><div id=c>{BODY}</div><footer>(c) {WORDS}</footer>",
        f"<div><ul>{LINKS}</ul></div><div><div>{BODY}</div></div><div><ul>{LINKS}</ul></div>",
        f"<header><h1>Site</h1><p>{WORDS}</p></header><main>{BODY}<aside>{WORDS}</aside></main>",
        f'<div class="cookie-banner">{WORDS}</div><div class="post-body">{BODY}<div class="ad">{WORDS}</div></div><section id="comments"><p>{WORDS}</p><p>{WORDS}</p></section>',
        f'<form action="/all"><article>{BODY}</article></form><div role="dialog">{WORDS}</div>',
        f'<article>{BODY}</article><article class="comment"><p>{WORDS * 9}</p></article>',
        f'<div class="has-sidebar"><div>{BODY}</div><div class="sidebar"><p>{WORDS}</p></div></div>',
        f"<table><tr><td><ul>{LINKS}</ul></td><td>{BODY}</td></tr></table>",
        f"<div><section>{BODY[: BODY.index('</p>') + 4]}</section><section>{BODY[BODY.index('</p>') + 4 :]}</section></div><div><ul>{LINKS}</ul></div>",
        f"<article>{BODY}<script>var x = '<p>{WORDS}</p>';</script><style>p {{}}</style><!-- <p>{WORDS}</p> --></article>",
        f"<article>{BODY}<form><label>Mail</label><input><button>Send</button></form></article>",
        "<article>" + BODY.replace("</p>", ""),
        f'<ARTICLE CLASS=x>{BODY.replace("<p>", "<P  data-x=\"a>b\" >")}</ARTICLE><DIV ID="newsletter">{WORDS}</DIV>',
    ],
)
def test_shapes_of_pages(page):
    assert main_text(f"<!DOCTYPE html><html><head><title>{WORDS}</title></head><body>{page}</body></html>") == TEXT


def test_blocks_and_references():
    assert main_text("<article><h1>A &amp; B</h1><p>x&nbsp;\n y<br>z &#233;&eacute; &amp;lt; &unknown; &am</p><ul><li>1<li>2</ul>tail <b>bo<i>ld</b></i>er</article>") == "A & B\nx y z éé &lt; &unknown; &am\n1\n2\ntail bolder"
    assert main_text("<article><div>a<p>b</p>c<p></p>d</div></article>") == "a\nb\nc\nd"
    assert main_text("<article>kept<div hidden>no</div><nav>no</nav>kept</article>") == "kept\nkept"


def test_odd_pages():
    assert [main_text(h) for h in (None, "", " ", "<nav>x</nav>", "<script>x", "<!-- x")] == [""] * 6
    assert main_text("plain  text <3 & more") == "plain text <3 & more"
    assert main_text("<div>a < b</div></p></x>") == "a < b"


@pytest.mark.parametrize("part", ["<div>", '<a href="x', "<b ", "<p><b>x<br>", "<li><b>x<ul>", "</i>x</table>", "&", "<td><b>", "<![x", "='\""])
def test_time_in_proportion(part):
    began = time.perf_counter()
    main_text(part * 20_000)
    small = time.perf_counter() - began
    began = time.perf_counter()
    main_text(part * 160_000)
    assert time.perf_counter() - began < 24 * small + 1


def test_densities_sum_over_children():
    page = mainpage._Page(f"<div>{BODY}</div><div><a href=x>{WORDS}</a></div>")
    density, total = mainpage.densities(page, [False] * len(page.tag))
    for k in range(len(page.tag)):
        assert total[k] == pytest.approx(sum(density[j] for j in range(len(page.tag)) if page.parent[j] == k))
    first, second = (k for k, t in enumerate(page.tag) if t == "div")
    assert density[first] > 5 * density[second] and total[first] == max(total)


def test_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", f"<article>{BODY}</article>"), (3, "u", "<p>" + "wort " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = mainpage.extract(df).collect()
    assert sorted(str((r["page_id"], r["url"], r["n_chars"])) for r in got) == sorted(str((p, u, n)) for (p, u, _), n in zip(rows, (0, 0, 0, len(TEXT), 999_999), strict=True))
    assert mainpage.extract(df.where("false")).collect() == []
