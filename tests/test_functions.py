"""URL and text functions on literal cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave.functions import text, urls


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize("raw, clean", [
    ("https://example.com/products/item?utm_source=twitter&fbclid=123&page=2#reviews", "https://example.com/products/item?page=2"),
    ("https://example.com/", "https://example.com"), ("", ""), ("   ", ""), (None, ""),
    ("example.com/article?ref=news", "https://example.com/article"), ("HTTP://A.Example.COM/Path//;v=1?B=&UTM_X=1&a=%20", "http://a.example.com/Path?B=&a=+"),
])
def test_sanitize(spark, raw, clean):
    assert one(spark, urls.sanitize, raw) == clean


def test_normalise_and_roots(spark):
    assert one(spark, urls.normalize, "https://www.Example.com/work/") == "example.com/work"
    assert one(spark, urls.domain, "https://u:p@a.b.example:80/x") == "a.b.example"
    assert one(spark, lambda u: urls.domain(u, True), "a.b.example") == "a_b_example"
    assert one(spark, urls.site_root, "a.example/x") == "http://a.example/"
    assert one(spark, urls.target, "A.example/x/?q=1#f") == "https://a.example/x"
    assert one(spark, urls.is_static, "https://a.example/x/y.JPG?v=1") is True
    assert one(spark, urls.path_depth, "https://a.example//x/y/") == 2


@pytest.mark.parametrize("name, generic", [("sitemap.xml", True), ("sitemap_index.xml", True), ("sitemap-2.xml.gz", True), ("index", True), ("urllist.txt", True), ("post-sitemap.xml", False), ("custom.xml", False)])
def test_sitemap_names(spark, name, generic):
    assert one(spark, urls.is_generic_sitemap, name) is generic


def test_text(spark):
    assert one(spark, text.slug, "🛍 Web Services & Goods") == "web-services-goods"
    assert one(spark, text.param_case, "camelCaseTitle") == "camel-case-title"
    assert one(spark, text.slug, None) == "default" and one(spark, text.param_case, "--") == "unnamed"
    assert one(spark, text.is_parked, "Yes, THIS DOMAIN IS FOR SALE now") is True
    assert one(spark, text.is_parked, "normal text") is False
    assert one(spark, text.clean, "a \t b\n\n\n\nc <label>x</label> ") == "a b\n\nc "
    assert one(spark, text.page_title, "Studio | Rotterdam") == "Studio" and one(spark, text.page_title, None) == "Untitled"
    assert one(spark, text.body_of, "# t\n---\nbody\n---\nmore") == "body\n---\nmore"
    assert one(spark, text.cell, "a |\n b") == r"a \| b"
    assert one(spark, lambda t: text.longest_run(t, "A"), "xAAAyAA") == 3
    assert one(spark, text.breadcrumbs, "Home › › Shop") == ["Home", "Shop"]
    assert one(spark, text.markdown_images, "![a](x.png) ![b](data:1) ![c](x.png)") == ["x.png"]
    assert one(spark, text.sitemap_directives, "Sitemap: https://a.example/s.xml\nsitemap:https://b.example/t.xml") == ["https://a.example/s.xml", "https://b.example/t.xml"]
    assert one(spark, lambda t: text.expand_location(t, {"Rotterdam": "Netherlands"}, {"it": "Italy"}), " rotterdam ") == "rotterdam, Netherlands"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ/:?&=#._- ", max_size=20), min_size=1, max_size=20))
def test_idempotence(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    twice = df.select((urls.sanitize(urls.sanitize(v)) == urls.sanitize(v)).alias("a"), (text.slug(text.slug(v)) == text.slug(v)).alias("b"))
    assert all(r.b for r in twice.collect())


def test_more_urls_and_pages(spark):
    assert one(spark, urls.clean_media, "https://a.example/rx/x_10/i.jpg?w=100&h=20") == "https://a.example/i.jpg"
    assert one(spark, urls.style_url, "background: url('/a.png') no-repeat") == "/a.png"
    assert one(spark, urls.style_url, "color: red") is None
    assert one(spark, text.is_unrendered, "x" * 600) is False and one(spark, text.is_unrendered, None) is True
    assert one(spark, text.is_unrendered, "Checking your browser" + "x" * 600) is True
    assert one(spark, text.is_shell, "<app-root></app-root>") is True
    assert one(spark, text.is_untitled, "Untitled page") is True and one(spark, text.is_untitled, "x") is False
    assert one(spark, lambda t, p: text.is_untitled(t, p), "x", "jobs/untitled_2/content.md") is True


def test_enrichment(spark):
    from lodeweave.operators import enrichment as en

    d = spark.createDataFrame([("http://www.a.example/", "https://a.example", "n"), ("https://a.example", "https://b.example", "")], "old string, new string, notes string")
    got = [tuple(r.r) for r in d.select(en.redirected(F.col("old"), F.col("new"), F.col("notes")).alias("r")).collect()]
    assert got == [("http://www.a.example/", "n"), ("https://b.example", "https://a.example")]
    p = spark.createDataFrame([("failed", False), ("completed", True), ("completed", None)], "status string, again boolean")
    assert [r.status for r in en.requeue(p, "status", F.col("again")).collect()] == ["pending", "pending", "completed"]
    assert spark.createDataFrame([("u", None, " ")], "a string, b string, c string").select(en.only_filled("a", ["b", "c"]).alias("x")).first().x is True
