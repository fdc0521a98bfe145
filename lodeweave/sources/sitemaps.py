"""Sitemaps: entries from XML, expansion of indexes, candidates, choice, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import urls
from lodeweave.functions.text import let
from lodeweave.operators import ordinals

# Places where sites keep their sitemaps, likeliest first.
COMMON_PATHS = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemapindex.xml", "/wp-sitemap.xml", "/page-sitemap.xml", "/post-sitemap.xml", "/category-sitemap.xml", "/tag-sitemap.xml",
    "/author-sitemap.xml", "/news-sitemap.xml", "/sitemap-pages.xml", "/sitemap-posts.xml", "/sitemap1.xml", "/sitemap-0.xml", "/feeds/sitemap.xml", "/sitemap/sitemap.xml", "/sitemaps/sitemap.xml",
)


# Endings of files that are no pages.
_FILES = r"\.(?:jpg|jpeg|png|gif|webp|svg|mp4|avi|pdf|zip|xml|xsl|css|js)$"
_LOC, _TABLE = r"(?i)<(?:\w+:)?loc\b", r"(?is)<table\b.*?</table>"
_ENTRY = "array<struct<loc:string,lastmod:string,hreflang:string>>"


def _clean(c: Column) -> Column:
    return F.nullif(F.replace(F.trim(c), F.lit("&amp;"), F.lit("&")), F.lit(""))


def _rows(text: Column) -> Column:
    """Rows with a link of a text's tables: array<struct(loc, lastmod, hreflang)>."""
    rows = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_TABLE), F.lit(0)), lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))))
    made = F.transform(rows, lambda r: F.struct(
        _clean(F.regexp_extract(r, r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)""", 1)).alias("loc"),
        F.nullif(F.regexp_extract(r, r"(?is)<td\b[^>]*>\s*(\d{4}-\d{2}-\d{2}[^<]*?)\s*</td>", 1), F.lit("")).alias("lastmod"),
    ))
    kept = F.filter(made, lambda e: e["loc"].isNotNull() & ~e["loc"].rlike("^(?:#|javascript:)"))
    return F.transform(kept, lambda e: F.struct(e["loc"].alias("loc"), e["lastmod"].alias("lastmod"), F.nullif(F.regexp_extract(F.lower(e["loc"]), r"^[a-z]+://[^/]+/([a-z]{2})(?:/|$)", 1), F.lit("")).alias("hreflang")))


def _children(text: Column, rows: Column) -> Column:
    """Rows that lead to sitemaps: all where a column is headed so, else those that end in .xml."""
    headed = F.exists(F.regexp_extract_all(text, F.lit(r"(?is)<th\b[^>]*>(.*?)</th>"), F.lit(1)), lambda h: F.lower(h).contains("sitemap"))
    return F.filter(rows, lambda e: headed | (F.lower(e["loc"]).endswith(".xml") & ~F.lower(e["loc"]).rlike(r"sitemaps\.org|yoa\.st")))


def entries(xml: Column) -> Column:
    """array<struct(loc, lastmod, hreflang)> of a sitemap's or index's text, by tags whatever their prefix; malformed
    XML gives what can be read. A page without loc tags is read by its tables' rows: links to child sitemaps if it has
    any, else links to pages."""
    text = F.coalesce(xml, F.lit(""))
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<(?:\w+:)?(url|sitemap)\b[^>]*>.*?</(?:\w+:)?\1>"), F.lit(0))
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.regexp_extract_all(text, F.lit(r"(?is)<(?:\w+:)?loc\b[^>]*>.*?</(?:\w+:)?loc>"), F.lit(0)))
    made = F.transform(blocks, lambda b: F.struct(
        _clean(F.regexp_extract(b, r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</", 1)).alias("loc"),
        _clean(F.regexp_extract(b, r"(?is)<(?:\w+:)?lastmod\b[^>]*>(.*?)</", 1)).alias("lastmod"),
        _clean(F.regexp_extract(b, r"""(?is)hreflang=["']([^"']+)""", 1)).alias("hreflang"),
    ))
    pages = lambda rows: F.filter(rows, lambda e: ~F.lower(e["loc"]).rlike(r"\.(?:xml|xsl|css|js)$"))
    listed = let(_rows(text), lambda rows: let(_children(text, rows), lambda kids: F.when(F.size(kids) > 0, kids).otherwise(pages(rows))))
    return F.when(text.rlike(_LOC), F.filter(made, lambda e: e["loc"].isNotNull())).when(text.rlike(r"(?i)<table\b"), listed).otherwise(F.array().cast(_ENTRY))


def is_index(xml: Column) -> Column:
    """Whether a text is a sitemap index, or a page whose tables list sitemaps."""
    text = F.coalesce(xml, F.lit(""))
    listed = ~text.rlike(_LOC) & text.rlike(r"(?i)<table\b") & (F.size(_children(text, _rows(text))) > 0)
    return text.rlike(r"(?i)<(?:\w+:)?sitemapindex\b") | listed


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's path) and content of sitemap files, as UTF-8 with bad bytes replaced."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def expand(maps: DataFrame) -> DataFrame:
    """maps(url, content) -> url, loc, lastmod, hreflang, content_type: entries, those of an index replaced by its
    children's on the same host, one level deep. Of entries that repeat a loc the first by (url, place) stays."""
    own = maps.select("url", is_index(F.col("content")).alias("index"), F.posexplode(entries(F.col("content"))).alias("pos", "e"))
    plain = own.where("not index").select("url", "pos", "e")
    linked = own.where("index").select(F.col("url").alias("parent"), F.col("pos").alias("at"), F.col("e.loc").alias("child")).where(urls.bare_domain(F.col("parent")) == urls.bare_domain(F.col("child")))
    children = linked.join(plain.withColumnRenamed("url", "child"), "child").select(F.col("parent").alias("url"), F.struct("at", "pos").alias("pos"), F.col("child").alias("hint"), "e")
    top = plain.join(linked.select(F.col("child").alias("url")).distinct(), "url", "left_anti").select("url", F.struct(F.lit(-1).alias("at"), "pos").alias("pos"), F.col("url").alias("hint"), "e")
    rows = top.unionByName(children).groupBy("url", F.col("e.loc").alias("loc")).agg(F.min_by(F.struct("e", "hint"), "pos").alias("x"))
    return rows.select("url", "loc", F.col("x.e.lastmod").alias("lastmod"), F.col("x.e.hreflang").alias("hreflang"), urls.content_type(F.col("loc"), F.substring_index("x.hint", "/", -1)).alias("content_type"))


def candidates(sites: DataFrame, robots_col: str | None = None) -> DataFrame:
    """sites(site, ...) -> site, candidate, rank: addresses that robots files name, then common places; other hosts last."""
    root = urls.site_root(F.col("site"))
    common = F.transform(F.array(*map(F.lit, COMMON_PATHS)), lambda p: F.concat(F.regexp_replace(root, "/$", ""), p))
    named = F.regexp_extract_all(F.coalesce(F.col(robots_col), F.lit("")), F.lit(r"""(?im)sitemap:\s*(https?://[^\s<"']+)"""), F.lit(1)) if robots_col else F.array().cast("array<string>")
    c = sites.select("site", F.posexplode(F.array_distinct(F.concat(named, common))).alias("pos", "candidate"))
    foreign = (urls.bare_domain(F.col("candidate")) != urls.bare_domain(F.col("site"))).cast("int")
    index = F.when(F.col("candidate").contains("index"), 0).otherwise(1)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(foreign, index, "pos")).cast("long")).drop("pos")


def pick(found: DataFrame) -> DataFrame:
    """found(site, rank, candidate, n_entries) -> each site's first candidate with entries."""
    return found.where("n_entries > 0").groupBy("site").agg(F.min_by("candidate", "rank").alias("candidate"), F.min("rank").alias("rank"))


#: Entries of one sitemap file at most, as the protocol has it.
MOST_ENTRIES = 50_000


def to_xml(rows: DataFrame, key: str, most: int = MOST_ENTRIES) -> DataFrame:
    """rows(key, loc, lastmod and hreflang if there) -> key, part, xml: sitemaps with escaped addresses, in order of loc, as
    many parts as a key's entries fill."""
    safe = F.replace(F.replace(F.replace(F.replace(F.col("loc"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    optional = lambda made: F.coalesce(made, F.lit(""))
    alternate = optional(F.concat(F.lit('<xhtml:link rel="alternate" hreflang="'), F.col("hreflang"), F.lit('" href="'), safe, F.lit('"/>'))) if "hreflang" in rows.columns else F.lit("")
    item = F.concat(F.lit("  <url><loc>"), safe, F.lit("</loc>"), optional(F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>"))), alternate, F.lit("</url>"))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">', "</urlset>"
    placed = ordinals.numbered(rows, [key], ["loc"], "__n")
    parts = placed.withColumn("part", F.floor((F.col("__n") - 1) / most)).withColumn("item", F.struct("loc", item.alias("x")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda i: i["x"]), "\n")
    return parts.groupBy(key, "part").agg(F.concat_ws("\n", F.lit(head), joined, F.lit(tail)).alias("xml"))


def homepage_links(pages: DataFrame, url_col: str = "url", page_col: str = "page") -> DataFrame:
    """url, loc, content_type: where a site has no sitemap, its home page itself and the pages of its own host that it links
    to, fragments, other schemes and files aside."""
    from lodeweave.operators.html import internal_links

    links = internal_links(pages, url_col, page_col).select(F.col(url_col).alias("url"), F.explode(F.concat(F.array(F.col(url_col)), "links")).alias("loc"))
    links = links.select("url", F.substring_index("loc", "#", 1).alias("loc")).where(~F.lower(urls.path(F.col("loc"))).rlike(_FILES)).distinct()
    return links.withColumn("content_type", urls.content_type(F.col("loc")))
