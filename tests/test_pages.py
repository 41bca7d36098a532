"""Page structure on nested markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import pages

LONG = "The bank raised its rate by a quarter of a point on Tuesday and said that more steps would follow in spring."
HTML = f"""<html><head><title> A  title </title><meta property="og:site_name" content=" The Site "><meta name="author" content="A. Writer">
<script type="application/ld+json">[1]</script><script type="application/ld+json">{{"datePublished": "2024-05-01"}}</script>
<link rel="icon" href="/i.png"><link rel="icon" sizes="32x32" href="//cdn.example.com/32.png"></head>
<body><nav><div class="post-content">{LONG} menu</div></nav><article>Short.</article>
<div class="x post-content"><div><p>{LONG} <b>Bold<p>Next</div> &amp; more <script>var a = "<p>no</p>";</script><aside>{LONG}</aside> https://a.b/c end</div>
<table><tr><th>Date</th><th>Rate<tr><td>Monday<td><table><tr><td>in</td><td>ner</td></tr></table></td></tr></table>
<table><tr><th>Name</th><th>Total Sum</th></tr><tr><td>a</td><td>1</td></tr></table></body></html>"""


def test_selectors_metadata_and_noise():
    title, site, author, published, icon, selector, content, _ = pages.structure("https://www.example.org/a/b?c", HTML)
    assert (title, site, author, published, icon) == ("A title", "The Site", "A. Writer", "2024-05-01", "https://cdn.example.com/32.png")
    assert selector == ".post-content" and content == LONG + " Bold Next  more  end"
    assert "var a" not in content and content.count("quarter") == 1


def test_nested_tables_stay_apart(spark):
    df = spark.createDataFrame([(1, "https://e.org/", HTML), (2, None, None), (3, "nonsense", "<td>a</td></table><tr><table><td>b<tr><td>c")], "id int, url string, html string")
    got = {r.id: r for r in pages.with_structure(df).select("id", "page.*", pages.find_table(F.col("page.tables"), "sum", "NAME").alias("found")).collect()}
    assert got[1].tables == [[["Date", "Rate"], ["Monday", "in ner"]], [["in", "ner"]], [["Name", "Total Sum"], ["a", "1"]]]
    assert got[1].found == [["Name", "Total Sum"], ["a", "1"]] and got[2].found is None
    assert got[2].content is None and got[2].icon == ":///favicon.ico" and got[3].tables == [[["c"]]] and got[3].site == ""


def test_body_stands_in_and_addresses_fill_in():
    _, site, author, published, icon, selector, content, tables = pages.structure("http://www.example.org:8080/x", f"<body>a<header>{LONG}</header><main>b</main><div>c <i>d</i></div>" + "w " * 4000)
    assert (site, author, published, icon, selector, tables) == ("example.org:8080", None, None, "http://www.example.org:8080/favicon.ico", "body", [])
    assert content.startswith("a b c d w w") and len(content) == 5000


def test_dates_and_icons():
    page = '<meta property="article:published_time" content="2024-01-02T03:04:05Z"><link rel="shortcut icon" href="rel.ico"><link rel="apple-touch-icon" href="/touch.png">'
    assert pages.structure("https://e.org/x", page)[3:5] == ("2024-01-02T03:04:05+00:00", "https://e.org/touch.png")
    assert pages.structure("https://e.org/x", '<meta property="article:published_time" content="May 1">')[3] == "May 1"


def test_hostile_pages():
    for html in ("<" * 5000, "<div>" * 5000 + "x", "<table>" * 800 + "<tr><td>x" * 800, "</p>" * 5000, "<!-- " + "x" * 5000, "<![CDATA[x]]>", "&#0;&#xFFFFFFFF;", "<script>" + "x" * 5000, '<a href="' + "y" * 5000, "<title>a<title>b", "<!DOCTYPE" + "[" * 999):
        assert len(pages.structure("http://[bad/", html)) == 8


def test_page_structure_leaves_unclosed_references(spark, tmp_path):
    """A heading cut inside a reference, as pages of the larger tables have: the query's SQL knows closed references alone."""
    import duckdb

    from tidemark.plans import catalogue

    cut = [f"<body><article><h1>a&amp;&quot;b{end}</h1><p>{LONG}</p></article></body>" for end in ("&amp", "&am", "&", "&amp;", "&quot", "&#39", "&ampx", "&amp;amp")]
    rows = [(k, "https://www.example.org/a", html) for k, html in enumerate(cut)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["page_structure"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.ORACLES["page_structure"]).fetchall())
    assert pages.structure("https://e.org/x", f"<article>a&amp b {LONG}</article>")[6].startswith("a b ")  # HTML's own rule, by default
    script = '<script type="application/ld+json">{"datePublished": "a&amp b&c"}</script>'
    assert pages.structure("", script)[3] == pages.structure("", script, closed=True)[3] == "a&amp b&c"
