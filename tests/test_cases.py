"""Operators on hand-made rows, with the rows they are expected to give."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import canonical

from lodeweave.functions import text as tx
from lodeweave.functions import urls
from lodeweave.operators import enrichment as en
from lodeweave.operators import html as h
from lodeweave.operators import rules, taxonomy
from lodeweave.sources import sitemaps

CASES = {}


def case(want):
    def add(f):
        CASES[f.__name__] = (f, want)
        return f

    return add


@case("SELECT * FROM (VALUES (0, 'Title text link code item'), (1, 'One.' || chr(10) || chr(10) || 'Two.' || chr(10) || chr(10) || 'Three'), (2, '')) v(id, plain)")
def text_plain_from_markdown(spark, sf):
    rows = [(0, "# Title\n\n![x](y.png) text [link](http://a) `code`\n\n- item\n"), (1, "One. Two. **Three**".replace("**", "")), (2, None)]
    return spark.createDataFrame(rows, "id int, md string").select("id", tx.plain_from_markdown(F.col("md")).alias("plain"))


@case("SELECT * FROM (VALUES (1, 'Technology', 4.5::DOUBLE, 'Service', 'db,api,hosting', NULL), (2, 'Design', 3.0::DOUBLE, 'Business', 'fonts,design', 'Design'), (3, 'Street', 3.0::DOUBLE, 'Shop', 'ecommerce', NULL)) v(id, category, score, type, tags, genre)")
def classify_pages(spark, sf):
    rows = [(1, "Cloud API platform", "Developer hosting for a database", "software software database", "https://dev.example/x"), (2, "Brand design studio", "Typography and layout", None, "https://s.example"), (3, "Sneakers boutique", "Denim jeans", "shop shop", "https://w.example/store")]
    f = spark.createDataFrame(rows, "id int, title string, description string, body string, url string").select("id", rules.features(F.col("title"), F.col("description"), F.col("body"), F.col("url")).alias("f"))
    p, b = F.col("f.primary"), F.col("f.body")
    return f.select("id", rules.category(p, b).alias("c"), rules.page_type(p, b)["label"].alias("type"), F.array_join(rules.tags(p, b), ",").alias("tags"), rules.first_label(p).alias("genre")).select("id", F.col("c.label").alias("category"), F.col("c.score").alias("score"), "type", "tags", "genre")


@case("SELECT * FROM (VALUES (1, 'Design', 'Shop', 'consensus', 1.0::DOUBLE), (2, 'Design', 'Utils', 'jev', 1.0::DOUBLE), (3, 'Car', 'Tools', 'embedding', 0.5::DOUBLE), (4, 'Food', 'Tools', 'jev', 0.5::DOUBLE), (5, 'Technology', 'Utils', 'dual_hybrid', 0.5::DOUBLE), (6, 'Home', 'Model', 'embedding', 0.13::DOUBLE)) v(id, category, type, source, confidence)")
def classify_arbitrate(spark, sf):
    rows = [(1, "Design", 1.0, "design", 0.2, "Shop", 1.0, "shop", 0.1), (2, "Design", 3.0, "Car", 0.9, None, None, None, None), (3, "Food", 1.5, "Car", 0.5, "Shop", 1.0, "Tools", 0.4), (4, "Food", 1.5, "Car", 0.3, "Tools", 3.0, "Shop", 0.9), (5, None, None, None, None, None, None, None, None), (6, None, None, "Home", 0.125, None, None, "Model", 0.1)]
    d = spark.createDataFrame(rows, "id int, c string, cs double, n string, ns double, k string, ks double, m string, ms double")
    return d.select("id", rules.arbitrate(*[F.col(x) for x in ("c", "cs", "n", "ns", "k", "ks", "m", "ms")]).alias("a")).select("id", "a.*")


@case("SELECT * FROM (VALUES (1, 'Technology,Design', 'Service'), (2, 'Technology', 'Utils'), (3, 'Yoga', 'Shop')) v(id, roles, type)")
def infer_roles_types(spark, sf):
    d = spark.createDataFrame([(1, "design of software", "api service"), (2, "nothing", "yoga yoga"), (3, "yoga", "shop")], "id int, p string, b string")
    return d.select("id", F.array_join(rules.roles(F.col("p"), F.col("b")), ",").alias("roles"), rules.types_cascade(F.col("p"), F.col("b")).alias("type"))


@case("SELECT * FROM (VALUES (1, 'Org'), (2, 'Solo'), (3, NULL), (4, 'Solo'), (5, 'Org')) v(id, kind)")
def infer_org_solo(spark, sf):
    rows = [(1, "Studio Dumbar agency", "", None), (2, "Anna Maria's portfolio", "studio", None), (3, "Visual Studio Code", "", None), (4, "a lab", "designer", "https://linkedin.com/in/x"), (5, "", "group developer", None)]
    d = spark.createDataFrame(rows, "id int, p string, b string, l string")
    return d.select("id", en.org_or_solo(F.col("p"), F.col("b"), F.col("l")).alias("kind"))


@case("SELECT * FROM (VALUES (1, 'Branding,Web,Digital,Video'), (2, 'Design')) v(id, fields)")
def infer_fields(spark, sf):
    d = spark.createDataFrame([(1, "web and digital branding", "video video print ai fashion"), (2, "", "progettazione design")], "id int, p string, b string")
    return d.select("id", F.array_join(en.fields(F.col("p"), F.col("b")), ",").alias("fields"))


@case("SELECT * FROM (VALUES ('Studio Dumbar | Rotterdam', 'Studio Dumbar', 'Rotterdam', NULL), ('Home - Acme', 'Acme', NULL, NULL), ('acme.com the best tools', 'acme.com', NULL, 'the best tools'), ('A long line of words about things - Anna Rossi', 'Anna Rossi', NULL, 'A long line of words about things'), ('plain', 'plain', NULL, NULL), ('', '', NULL, NULL)) v(raw, name, location, about)")
def parse_names(spark, sf):
    rows = ["Studio Dumbar | Rotterdam", "Home - Acme", "acme.com the best tools", "A long line of words about things - Anna Rossi", "plain", ""]
    d = spark.createDataFrame([(r,) for r in rows], "raw string").select("raw", en.parse_name(F.col("raw"), ("Rotterdam", "Milano")).alias("n"))
    return d.select("raw", "n.name", "n.location", "n.about")


@case("SELECT * FROM (VALUES ('https://x.example/denim-jacket', 'street', 'apparel'), ('https://x.example/hotel-roma', 'traveller', 'hotel'), ('https://x.example/dev/plugin', 'technology', 'plugin'), ('https://x.example/studio', 'design', 'solo'), ('https://x.example/it/notizie', 'writing', 'magazine'), ('https://x.example/item', 'street', 'shop'), ('https://x.example/zzz', NULL, NULL)) v(url, category, type)")
def batch_predict(spark, sf):
    rows = ["denim-jacket", "hotel-roma", "dev/plugin", "studio", "it/notizie", "item", "zzz"]
    d = spark.createDataFrame([(f"https://x.example/{r}",) for r in rows], "url string")
    return d.select("url", en.predict(F.col("url"), F.lit("")).alias("p")).select("url", "p.category", "p.type")


@case("SELECT * FROM (VALUES ('a.jpg 1x, b.jpg 2.5x', 'a.jpg:1000,b.jpg:2500'), ('c.jpg 300w,d.jpg', 'c.jpg:300,d.jpg:0'), ('', '')) v(s, parts)")
def media_srcset(spark, sf):
    d = spark.createDataFrame([("a.jpg 1x, b.jpg 2.5x",), ("c.jpg 300w,d.jpg",), ("",)], "s string")
    return d.select("s", F.array_join(F.transform(urls.srcset(F.col("s")), lambda x: F.concat_ws(":", x["url"], x["size"])), ",").alias("parts"))


@case("SELECT * FROM (VALUES ('https://x.example/p/ABC123-45.html?color=red', 'ABC123,red'), ('https://x.example/relaxed-fit-wool', ''), ('https://x.example/AB-1234?sku=9', 'AB-1234,9')) v(url, skus)")
def url_skus(spark, sf):
    d = spark.createDataFrame([("https://x.example/p/ABC123-45.html?color=red",), ("https://x.example/relaxed-fit-wool",), ("https://x.example/AB-1234?sku=9",)], "url string")
    return d.select("url", F.array_join(urls.skus(F.col("url")), ",").alias("skus"))


@case("SELECT * FROM (VALUES (1, 404, true, NULL), (2, 200, false, NULL), (3, 403, true, '403'), (4, 500, true, 'Closed'), (5, 200, true, 'Closed')) v(id, status, archive, tag)")
def page_states(spark, sf):
    d = spark.createDataFrame([(1, 404, False), (2, 200, False), (3, 403, False), (4, 500, False), (5, 200, True)], "id int, status int, parked boolean")
    return d.select("id", "status", en.page_state(F.col("status"), F.col("parked"), F.lit(False)).alias("s")).select("id", "status", "s.archive", "s.tag")


@case("SELECT * FROM (VALUES ('A.example/x/', 'https://a.example/x', 1, 'already_running'), ('b.example', 'https://b.example', 3, 'restored'), ('c.example', 'https://c.example', NULL, 'started')) v(url, target, job_id, outcome)")
def job_start(spark, sf):
    jobs = spark.createDataFrame([("https://a.example/x", 1, "running"), ("https://A.example/x/?q", 2, "completed"), ("b.example/", 3, "failed")], "url string, job_id int, status string")
    return en.start_jobs(jobs, spark.createDataFrame([("A.example/x/",), ("b.example",), ("c.example",)], "url string"))


CONTACT_PAGE = """<html lang="it"><head><title>Just a moment...</title><meta property="og:title" content="Studio Uno">
<meta name="geo.placename" content="Milano"><link rel="icon" sizes="32x32" href="/a.png"><link rel="apple-touch-icon" href="/t.png"><link rel="mask-icon" href="/m.svg">
<link rel="android-icon" sizes="192x192" href="/n.png"><link rel="alternate" hreflang="en" href="/en/x#a">
<script type="application/ld+json">{"@graph":[{"@type":"Organization","foundingDate":"1999-05-01","description":"We make things.","address":{"addressLocality":"Rome","addressCountry":"Italy"}}]}</script></head>
<body><main><p>Write to us any time, we are glad.</p><a href="mailto:hi@uno.example?subject=x">m</a><a href="tel:+390212345">t</a>
<a href="https://instagram.com/p/1">p</a><a href="https://instagram.com/uno">i</a><a href="https://www.linkedin.com/company/uno">l</a><img src="a_100.jpg" srcset="a_1.jpg 100w, a_2.jpg 900w"></main></body></html>"""


@case("SELECT * FROM (VALUES ('Studio Uno', 'hi@uno.example', '+390212345', 'https://instagram.com/uno', 'https://www.linkedin.com/company/uno', 1999, 'Rome, Italy', 'We make things.', 'https://uno.example/n.png', 'it')) v(title, email, phone, instagram, linkedin, founded, location, about, icon, lang)")
def html_contact(spark, sf):
    d = h.parse_pages(spark.createDataFrame([("https://uno.example/x", CONTACT_PAGE)], "url string, html string"))
    p = F.col("page")
    return d.select(h.title(p).alias("title"), h.email(p).alias("email"), h.phone(p).alias("phone"), h.instagram(p).alias("instagram"), h.linkedin(p).alias("linkedin"), h.founded(p).alias("founded"), h.location(p).alias("location"), h.about(p).alias("about"), h.best_icon(p, F.col("url")).alias("icon"), h.language(p, F.col("url")).alias("lang"))


@case("SELECT * FROM (VALUES (1, 'AB12,RED'), (2, 'X9'), (3, '')) v(id, skus)")
def html_skus(spark, sf):
    rows = [(1, "u", '<meta itemprop="sku" content="ab12_red-xl">'), (2, "u", '<script type="application/ld+json">[{"@type":"Thing","sku":"no"},{"@type":"Product","sku":"x9"}]</script>'), (3, "u", "<p>none</p>")]
    d = h.parse_pages(spark.createDataFrame(rows, "id int, url string, html string"))
    return d.select("id", F.array_join(h.skus(F.col("page")), ",").alias("skus"))


@case("SELECT * FROM (VALUES ('image', 'https://uno.example/a_2.jpg', 'srcset'), ('image', 'https://uno.example/a_100.jpg', 'img')) v(kind, url, source)")
def media_urls(spark, sf):
    d = h.parse_pages(spark.createDataFrame([("https://uno.example/x", CONTACT_PAGE)], "url string, html string"))
    return d.select(F.explode("page.media").alias("m")).select("m.kind", "m.url", "m.source")


_XML = {
    "https://a.example/sitemap_index.xml": "<sitemapindex><sitemap><loc>https://a.example/post-sitemap.xml</loc></sitemap><sitemap><loc>https://b.example/other.xml</loc></sitemap></sitemapindex>",
    "https://a.example/post-sitemap.xml": "<x:urlset xmlns:x='u'><x:url><x:loc> https://a.example/abc?x=1&amp;y=2 </x:loc><x:lastmod>2024-01-02</x:lastmod></x:url><x:url><x:loc>https://a.example/spa/1</x:loc></x:url></x:urlset>",
    "https://c.example/sitemap.xml": "broken <loc>https://c.example/one</loc> <loc>https://c.example/one</loc>",
}


@case("SELECT * FROM (VALUES ('https://a.example/sitemap_index.xml', 'https://a.example/abc?x=1&y=2', '2024-01-02', 'blog'), ('https://a.example/sitemap_index.xml', 'https://a.example/spa/1', NULL, 'wellness'), ('https://c.example/sitemap.xml', 'https://c.example/one', NULL, 'pages')) v(url, loc, lastmod, content_type)")
def sitemap_entries(spark, sf):
    maps = spark.createDataFrame(list(_XML.items()), "url string, content string")
    return sitemaps.expand(maps).select("url", "loc", "lastmod", "content_type")


@case("SELECT * FROM (VALUES ('https://a.example/x', 'https://a.example/my.xml', 4)) v(site, candidate, rank)")
def sitemap_pick(spark, sf):
    sites = spark.createDataFrame([("https://a.example/x", "Sitemap: https://z.example/s.xml\nSitemap: https://a.example/my.xml")], "site string, robots string")
    c = sitemaps.candidates(sites, "robots").withColumn("n_entries", F.when(F.col("candidate").endswith("my.xml") | F.col("candidate").contains("z.example"), 2).otherwise(0))
    return sitemaps.pick(c).select("site", "candidate", F.col("rank").cast("int").alias("rank"))


@case("SELECT * FROM (VALUES (1, 0, 'tech', 'Technology', 3), (1, 2, 'application', 'Application', 2), (1, 3, 'Plug', 'Plugin', 4), (1, 4, 'Desgin', 'Design', 5), (2, 0, 'Design', 'Design', 1)) v(id, ord, label, option, tier)")
def taxonomy_match(spark, sf):
    proposed = spark.createDataFrame([(1, 0, "tech"), (1, 1, "zzzz"), (1, 2, "application"), (1, 3, "Plug"), (1, 4, "Desgin"), (2, 0, " Design "), (2, 1, "design")], "id int, ord int, label string")
    options = spark.createDataFrame([(0, "Technology"), (1, "Application"), (2, "Plugin"), (3, "Design")], "ord int, option string")
    synonyms = spark.createDataFrame([("tech", "technology"), ("developer", "Technology")], "label string, option string")
    return taxonomy.match(proposed, options, synonyms)


_TEXTS = ("See https://a.example.com/x?utm_id=1&b=2. And www.b.org/, or c.io/path;", "https://a.example.com/x/ twice https://a.example.com/x (http://a.example.com/x)", "", "mail me@host.com now")


@case("SELECT k::BIGINT AS text_id, pos::BIGINT AS pos, url FROM (VALUES (0, 0, 'https://a.example.com/x?b=2'), (0, 1, 'https://www.b.org'), (0, 2, 'https://c.io/path'), (1, 0, 'https://a.example.com/x'), (1, 1, 'http://a.example.com/x')) v(k, pos, url)")
def extract_urls(spark, sf):
    rows = spark.createDataFrame(list(enumerate(_TEXTS)), "text_id long, text string")
    return rows.select("text_id", F.posexplode(urls.extract(F.col("text"))).alias("pos", "url")).select("text_id", F.col("pos").cast("long").alias("pos"), "url")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(name, spark, sf):
    made, want = CASES[name]
    df, rows = made(spark, sf), duckdb.sql(want)
    assert sorted(df.columns) == sorted(rows.columns)
    assert canonical(df.collect(), df.columns) == canonical(rows.fetchall(), rows.columns)
