"""The SQL surface against the native functions; multisets of query parts."""

from collections import Counter

from pyspark.sql import functions as F

from lodeweave.functions import sql, text, urls
from lodeweave.plans.catalogue import queries

URLS = [
    "https://www.Example.com/work/", "http://x.example:8080/en/rooms-suites?utm_source=a&q=1#f", "x.example/it/spa/wellness", "https://u:p@x.example/", "", None, "  ", "https://x.example/showroom/a", "https://x.example/de-de/produkte/1", "https://x.example/row/news",
    "https://x.example/folder/abc", "https://x.example/offerte", "https://x.example/hotel", "https://x.example/a;p=1/b;q/", "https://x.example/my_sitemap/x", "ftp://h/Tag/1", "https://x.example/?a=b c&ref=1&d=%zz&e=%C3%A9&f=a+b&g", "//y",
]


def test_sql_functions_equal_the_native_ones(spark):
    sql.register(spark)
    texts = ["A b-c", "camelCaseTitle", "x_y Z9", "", None, "🛍 Web Services & Goods", "--"]
    df = spark.createDataFrame([(u, t) for u in URLS for t in texts], "url string, text string")
    df.createOrReplaceTempView("cases")
    got = spark.sql("SELECT url, text, slugify(text) a, param_case(text) b, normalize_url(url) c, url_host(url) d, url_path(url) e, content_type(url) f FROM cases").collect()
    u, t = F.col("url"), F.col("text")
    want = df.select("url", "text", text.slug(t).alias("a"), text.param_case(t).alias("b"), urls.normalize(u).alias("c"), urls.host(u).alias("d"), urls.path(u).alias("e"), urls.content_type(u).alias("f")).collect()
    assert [r for r, w in zip(got, want, strict=True) if r != w] == []


def test_extracted_links_equal_the_native_ones(spark, sf):
    sql.register(spark)
    texts = [" and ".join(u for u in URLS if u) + ", (https://x.example/work?utm_medium=1). see www.y.example/a! mail a@b.com or site.io/x?a=1&a=1 end.", None, "", "no links"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    df.createOrReplaceTempView("linked")
    got = [tuple(r) for r in spark.sql("SELECT id, pos, raw, clean, stripped, has_stripped FROM linked, LATERAL extract_urls(text) ORDER BY id, pos").collect()]
    native = df.select("id", F.posexplode(urls.extract_analysed(F.col("text"))).alias("pos", "a")).select("id", "pos", "a.raw", "a.clean", "a.stripped", "a.has_stripped").orderBy("id", "pos")
    assert got == [tuple(r) for r in native.collect()] and len(got) > 10
    pages = {tuple(r) for r in queries()["sql_extract_urls"](spark, sf).collect()}
    assert pages == {tuple(r) for r in queries()["extract_urls_analysed"](spark, sf).select("page_id", F.col("pos").cast("int"), "raw", "clean", "stripped", "has_stripped").collect()}


def test_sitemap_entries_by_table_function(spark):
    sql.register(spark)
    xml = "<urlset><url><loc>https://x.example/a&amp;b</loc><lastmod>2024-01-01</lastmod></url><url>\n<loc> https://x.example/c </loc></url><url></url></urlset>"
    spark.createDataFrame([(xml,), (None,), ("<p>",)], "x string").createOrReplaceTempView("maps")
    assert [tuple(r) for r in spark.sql("SELECT loc, lastmod FROM maps, LATERAL sitemap_entries(x) ORDER BY pos").collect()] == [("https://x.example/a&b", "2024-01-01"), ("https://x.example/c", None)]


def test_multiset_difference(spark):
    rows = [(["a", "b", "a", "c", "a"], ["a", "c", "d"]), ([], ["a"]), (["x"], []), (["a", "a"], ["a", "a", "a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", urls.without_counted(F.col("a"), F.col("b")).alias("d"))
    for r in df.collect():
        assert Counter(r.d) == Counter(r.a) - Counter(r.b)
    one = spark.createDataFrame([("https://x.example/?a=1&a=1&utm_x=2", "https://x.example/?a=1")], "raw string, clean string")
    assert one.select(urls.removed_pairs(F.col("raw"), F.col("clean")).alias("r")).first().r == ["a=1", "utm_x=2"]
