"""Functions that no table query compares: guards, media, Markdown, sheets, state machines, taxonomies."""

import difflib
import random
import re
from urllib.parse import parse_qsl, urlencode

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.functions import urls
from lodeweave.operators import catalogue, enrichment, formulas, html, resolve, rules, taxonomy, vectors
from lodeweave.plans import catalogue as plans
from lodeweave.sources import sitemaps, tables
from lodeweave.streaming import jobs


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_query_parts_are_encoded_as_form_data(spark):
    rnd = random.Random(3)
    pairs = ["".join(rnd.choice("ab +%*~-_.!(é=2C0z") for _ in range(rnd.randint(1, 8))) for _ in range(300)] + ["flag", "a=%20", "a=%zz%41", "=x", "a==b"]
    want = [urlencode(parse_qsl(p, keep_blank_values=True)) for p in pairs]
    assert column(spark, pairs, urls.encoded_pair) == want


def test_analysed_links_keep_the_first_of_each_address(spark):
    text = "https://a.example/x?utm_id=1&b=2, then https://a.example/x?b=2 and c.io/y; https://a.example/x?b=2&fbclid=3"
    (got,) = column(spark, [text], urls.extract_analysed)
    assert [(a.raw, a.clean, a.has_stripped) for a in got] == [("https://a.example/x?utm_id=1&b=2", "https://a.example/x?b=2", True), ("c.io/y", "https://c.io/y", False)]


def test_known_tags_against_python(spark):
    rnd = random.Random(5)
    names = ["SEA", "ide", "data", "other", "fonts", "QR", "maps", "x", "web tools"]
    words = ["sea", "ads", "ide", "editor", "data", "font", "typeface", "qr codes", "mapping", "web tools", "plain", "other"]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3))), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for _ in range(200)]
    d = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(rows)], "i int, p string, b string")
    got = {r.i: r.t for r in d.select("i", rules.known_tags(F.col("p"), F.col("b"), names).alias("t")).collect()}
    for i, (p, b) in enumerate(rows):
        scored = []
        for name in (n.lower() for n in names):
            pattern = rules.KNOWN_TAG_WORDS.get(name, rf"\b{re.escape(name)}\b")
            n = len(re.findall(pattern, b))
            score = 5 if re.search(pattern, p) else 3 if n >= 5 else 2 if n >= 3 else 1 if n else 0
            ok = len(name) > 1 and name != "other"
            ok = ok and (name != "sea" or re.search(r"\b(?:marketing|advertising|sem|ads|adwords)\b", p + " " + b))
            ok = ok and (name != "ide" or re.search(r"\b(?:code|editor|programming|developer|development|compiler)\b", p))
            if ok and (name != "data" or score == 5) and score >= 3:
                scored.append((-score, len(scored), name))
        assert got[i] == [n for _, _, n in sorted(scored)[:4]], (p, b)


@pytest.mark.parametrize("primary, body, want", [
    ("interactive portfolio studio", "", ["Portfolio", "Interactions"]),
    ("an interactive directory", "contents contents skip to content", []),
    ("", "contents contents", ["Contents"]),
    ("our ux agency", "layout layout motion motion motion motion motion", ["UI/UX", "Motion", "Layout"]),
    ("settings in the ui", "", []),
])
def test_creative_tags(spark, primary, body, want):
    d = spark.createDataFrame([(primary, body)], "p string, b string")
    assert d.select(rules.creative_tags(F.col("p"), F.col("b"), ["Motion", "zz", "other"]).alias("t")).first().t == want


def test_untitled_pages_are_visited_again(spark):
    stored = spark.createDataFrame([("a", "2024-01-01", "completed", True), ("b", "2024-01-01", "completed", False), ("c", None, "completed", True)], "url string, lastmod string, status string, again boolean")
    seen = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01")], "url string, lastmod string")
    got = {r.url: (r.status, r.action) for r in catalogue.reconcile(stored, seen, again="again").collect()}
    assert got == {"a": ("pending", "retry"), "b": ("completed", "keep"), "c": ("completed", "keep")}
    d = spark.createDataFrame([("Untitled", "x/a.md", "pending", "t"), ("T", "untitled_2/c.md", "pending", "t"), ("T", "x/a.md", "completed", "h\n---\n \n"), ("T", "x/a.md", "completed", "h\n---\nbody"), (None, "x", "completed", "t"), (None, "x", "pending", "")], "t string, p string, s string, m string")
    assert [r[0] for r in d.select(tx.is_untitled_or_empty(*[F.col(c) for c in "tpsm"])).collect()] == [True, True, True, False, True, False]


TABLE = """<html><body><table id="sitemap"><thead><tr><th>Sitemap</th><th>Modified</th></tr></thead><tbody>
<tr><td><a href="https://a.example/post-sitemap.xml">p</a></td><td>2024-03-01 10:00</td></tr><tr><td><a href="#x">no</a></td></tr></tbody></table></body></html>"""
PAGES = """<table><tr><th>URL</th></tr><tr><td><a href="https://a.example/it/uno">u</a></td><td> 2024-01-02 </td></tr><tr><td><a href='https://a.example/style.css'>c</a></td></tr>
<tr><td><a href="https://a.example/due?a=1&amp;b=2">d</a></td></tr></table>"""


def test_sitemaps_as_html_tables(spark):
    d = spark.createDataFrame([("i", TABLE), ("p", PAGES), ("n", "<p>nothing</p>")], "k string, x string")
    got = {r.k: (r.ix, [tuple(e) for e in r.e]) for r in d.select("k", sitemaps.is_index(F.col("x")).alias("ix"), sitemaps.entries(F.col("x")).alias("e")).collect()}
    assert got["i"] == (True, [("https://a.example/post-sitemap.xml", "2024-03-01 10:00", None)])
    assert got["p"] == (False, [("https://a.example/it/uno", "2024-01-02", "it"), ("https://a.example/due?a=1&b=2", None, None)])
    assert got["n"] == (False, [])


def test_sitemaps_are_written_in_parts(spark):
    rows = spark.createDataFrame([("s", f"https://a.example/{i:03}?a&b", "2024-01-01" if i % 2 else None, "it" if i == 4 else None) for i in range(25)], "k string, loc string, lastmod string, hreflang string")
    made = sitemaps.to_xml(rows, "k", 10).orderBy("part").collect()
    assert [r.part for r in made] == [0, 1, 2]
    assert 'hreflang="it" href="https://a.example/004?a&amp;b"' in made[0].xml
    back = spark.createDataFrame([(r.xml,) for r in made], "x string").select(F.explode(sitemaps.entries(F.col("x"))).alias("e")).select("e.*").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, rows.select("loc", "lastmod", "hreflang").collect()))


def test_taxonomy_tiers(spark):
    options = [(0, "Technology"), (1, "Applications"), (2, "Plugin"), (3, "Design")]
    labels = ["technology", "tech", "Technology and more", "lication", "Desgin", "PLUGNI", "dsg", "new thing", "Pl"]
    proposed = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "id int, ord int, label string")
    opts = spark.createDataFrame(options, "ord int, option string")
    got = {r.label: (r.option, r.tier) for r in taxonomy.match(proposed.withColumn("id", F.col("ord")), opts).collect()}
    names = [o for _, o in options]
    assert got["technology"] == ("Technology", 2) and got["tech"] == ("Technology", 4) and got["lication"] == ("Applications", 4)
    assert got["Desgin"] == (difflib.get_close_matches("Desgin", names, 1, 0.75)[0], 5) and got["PLUGNI"] == ("Plugin", 5)
    assert not set(got) & {"Technology and more", "dsg", "new thing", "Pl"}
    made = {r.label: (r.option, r.tier) for r in taxonomy.match(proposed, opts, auto_create=True).collect()}
    assert made["new thing"] == ("new thing", 6)
    free = taxonomy.match(proposed, opts.limit(0)).collect()
    assert {r.label for r in free} == set(labels) and {r.tier for r in free} == {6}


def test_breadcrumbs_to_labels(spark):
    folders = spark.createDataFrame([(1, "Tech › Plugins › Odd"), (2, "nothing"), (3, "")], "id int, location string")
    known = {"roles": spark.createDataFrame([(0, "Technology")], "ord int, option string"), "tags": spark.createDataFrame([(0, "Plugin")], "ord int, option string")}
    got = {r.id: (r.roles, r.tags) for r in taxonomy.breadcrumb_labels(folders, known, {"roles": "Technology", "tags": "Utils"}, create=("tags",)).collect()}
    assert got == {1: (["Technology"], ["Tech", "Plugin", "Odd"]), 2: (["Technology"], ["nothing"]), 3: (["Technology"], ["Utils"])}


GALLERY = """<html><head><meta property="og:image" content="/og.jpg"></head><body><nav><img src="/nav.jpg"></nav><main>
<picture><source srcset="/w1.webp 400w, /w2.webp 900w"><img src="/p.jpg"></picture><a data-zoom-image="/zoom.jpg"><img src="/small.jpg" srcset="/s.jpg 2x"></a>
<div data-settings='{"background_image": {"url": "/bg.jpg"}}'></div><div data-media-video="&lt;iframe src=&quot;/v.mp4?x=1&quot;&gt;"></div><img src="/logo.png"><img src="/t.550x550_a.jpg">
<script>var a = "https://cdn.example/in-script.mp4?q";</script></main></body></html>"""


def test_media_of_containers(spark):
    d = html.parse_pages(spark.createDataFrame([("https://s.example/x", GALLERY)], "url string, html string"))
    got = {m.url.replace("https://s.example", ""): m.kind for m in d.select(F.explode("page.media").alias("m")).select("m.*").collect()}
    assert {"/w2.webp", "/zoom.jpg", "/v.mp4", "/t.1140x1140_a.jpg", "/og.jpg", "https://cdn.example/in-script.mp4?q"} <= set(got)
    assert not {"/nav.jpg", "/logo.png"} & set(got) and got["/v.mp4"] == "video"
    media = [{"url": "https://x/AB12_1.jpg"}, {"url": "https://x/other.jpg"}]
    d = spark.createDataFrame([(media, ["ab12"]), (media, [])], "m array<struct<url:string>>, s array<string>").select(html.of_article(F.col("m"), F.col("s")).alias("k"))
    assert [len(r.k) for r in d.collect()] == [1, 2]


def test_markdown_is_tidied_and_relinked(spark):
    text = "a\n# Head\nsee https://x.example/y and [l](https://x.example/z)\nAll rights reserved 2024\n![i](a.png)\n![i](a.png) ![i](a.png)\n* one\n1. two\n> q\n\n\n\nend"
    (got,) = column(spark, [text], html.tidied)
    assert got == "a\n\n# Head\nsee  and [l](https://x.example/z)\n![i](a.png)\n\n* one\n\n1. two\n\n> q\n\nend"
    d = spark.createDataFrame([("[a](u) (u) (w)", [("u", "img/1.png"), ("w", "x")])], "t string, p array<struct<src:string,dst:string>>")
    assert d.select(html.relinked(F.col("t"), F.col("p"))).first()[0] == "[a](img/1.png) (img/1.png) (x)"


def test_local_names_and_loading(spark):
    rows = [("p", f"https://x.example/{u}", i) for i, u in enumerate(["a b.jpg?x", "c/a b.jpg", "none", "a_b.jpg"])] + [("q", "https://x.example/a b.jpg", 0)]
    got = {(r.page, r.i): r.name for r in html.local_names(spark.createDataFrame(rows, "page string, url string, i int"), "page", "url", "i").collect()}
    assert got == {("p", 0): "a_b.jpg", ("p", 1): "1_a_b.jpg", ("p", 2): "image_2.jpg", ("p", 3): "3_a_b.jpg", ("q", 0): "a_b.jpg"}
    assert column(spark, ["data:image/png;x", "https://x/favicon.ico", "https://x/icon.png", "https://x/a.jpg", None], html.is_worth_loading) == [False, False, True, True, False]


def test_sheets_texts_and_vectors_come_back(spark, tmp_path):
    page = ("https://x", 'a "title", two\nlines', None, "k", "2024", "now", "job1")
    tables.write_page_sheet(spark.createDataFrame([page], "URL string, Title string, Description string, Keywords string, `Sitemap Last Modified` string, `Scraped At` string, job string"), f"{tmp_path}/p", ["job"])
    got = tables.read_sheet(spark, f"{tmp_path}/p").first()
    assert tuple(got) == ("https://x", 'a "title", two\nlines', "", "k", "2024", "now", "job1")
    tables.write_media_sheet(spark.createDataFrame([("f.jpg", None, "u")], "Filename string, `Alt Text` string, `Original URL` string"), f"{tmp_path}/m")
    assert tuple(tables.read_sheet(spark, f"{tmp_path}/m").first()) == ("f.jpg", "", "u")
    texts = [("a", "# one\n\ntwo\n"), ("b", "<p>é</p>")]
    tables.write_texts(spark.createDataFrame(texts, "page string, md string"), "md", str(tmp_path), ["page"], "md")
    assert sorted((r.page, r.value) for r in tables.read_written_texts(spark, str(tmp_path), "md").collect()) == texts
    tables.write_vectors(spark.createDataFrame([("k", [0.5, -1.0])], "key string, embedding array<double>"), f"{tmp_path}/v")
    assert [tuple(r) for r in tables.read_vectors(spark, f"{tmp_path}/v").collect()] == [("k", [0.5, -1.0])]
    records = spark.createDataFrame([("j", "a@b.c", None, "")], "job string, Email string, Phone string, Instagram string")
    assert [(r.Key, r.Value) for r in tables.contact_rows(records, "job").collect()] == [("Email", "a@b.c")]
    tables.write_partitioned(records, f"{tmp_path}/w", ["job"])
    assert spark.read.parquet(f"{tmp_path}/w").count() == 1


def test_texts_meet_their_taxonomy(spark):
    options = spark.createDataFrame([("Fruit", "apple pear plum"), ("Tools", "hammer saw nail")], "option string, description string")
    made = vectors.taxonomy_vectors(options)
    assert vectors.taxonomy_vectors(options, made).count() == 2 and {len(r.embedding) for r in made.collect()} == {768}
    texts = spark.createDataFrame([(1, "a pear and an apple"), (2, "one saw, one hammer")], "id long, t string")
    assert {r.id: r.option for r in vectors.match_texts(texts, "id", "t", made).collect()} == {1: "Fruit", 2: "Tools"}
    assert vectors.sync(made.select(F.col("option").alias("id")), spark.createDataFrame([("Fruit", "x"), ("New", "y")], "id string, t string"), "id", "t").select("id").distinct().collect()[0].id == "New"


def test_job_states_against_python(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").collect()
    names = ("start", "pause", "resume", "fail", "view")
    want = {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        status, n = want.get(e.user_id, ("pending", 0))
        new = next((to for name, froms, to in jobs.TRANSITIONS if name == names[e.event_id % 5] and status in froms), status)
        want[e.user_id] = new, n + (new != status)
    got = {r.user_id: (r.status, r.n_changes) for r in plans.queries()["job_states"](spark, sf).collect()}
    assert got == want and len(set(s for s, _ in got.values())) > 1


def test_rest(spark):
    assert column(spark, ["  Some  Shop | x", "A – B - c", "R — P", None], tx.shop_name) == ["Some Shop", "A – B", "R", ""]
    d = spark.createDataFrame([("sitemap", 1), ("single", 1)], "m string, w int")
    assert [r[0] for r in d.select(enrichment.route(F.col("m"), F.col("w"), F.lit(9))).collect()] == [9, 1]
    assert column(spark, ["a hotel", "none"], lambda c: rules.first_match(c, rules.TYPE_RULES, "Utils")) == ["Hotel", "Utils"]
    t = spark.createDataFrame([(1, "x", "old"), (2, "y", "keep")], "id int, name string, content_type string")
    assert [r.content_type for r in resolve.relabelled(t, "content_type", "old", F.upper("name")).orderBy("id").collect()] == ["X", "keep"]
    assert formulas.stamped(t.withColumn("at", F.lit(None).cast("string")), "at", F.lit("now")).first().at == "now"
    d = spark.createDataFrame([("7", 7), ("x", 8)], "s string, n int")
    assert catalogue.optional_filter(d, "s", "7").count() == 1 and catalogue.optional_filter(d, "n", "8").count() == 1 and catalogue.optional_filter(d, "n", "all").count() == 2
    dims = [(d.select(F.col("n").alias("k"), "s"), "k", "s", "n", "label")]
    assert [r.label for r in catalogue.enrich(d.select("n"), dims).orderBy("n").collect()] == ["7", "x"]
