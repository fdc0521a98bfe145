"""URL functions as Spark expressions; every one takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.text import let

# Query keys that only serve tracking. Keys beginning with utm_ count as well.
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader", "utm_referrer", "utm_name",
    "fbclid", "gclid", "gbraid", "wbraid", "msclkid", "dclid", "yclid", "twclid", "ttclid",
    "ref", "ref_src", "ref_url", "source", "feature", "mc_cid", "mc_eid", "igshid", "_hsenc", "_hsmi",
)
# Endings of bare host names that count as links in a text.
BARE_ENDINGS = ("com", "org", "net", "io", "ai", "co", "app", "dev", "edu", "gov", "xyz", "info", "tech", "me")
# First path segments and the content type they stand for; the second table is matched as a substring.
SEGMENT_TYPES = {
    "categories": ("category", "categories", "categoria", "categorie"),
    "tags": ("tag", "tags"),
    "blog": ("blog", "post", "posts", "articoli", "artikel", "actualites", "news", "notizie", "neuigkeiten"),
    "experiences": ("experiences", "esperienze", "erlebnisse", "erlebnis", "activities", "attivita"),
    "events": ("events", "eventi", "evenements", "veranstaltungen"),
    "products": ("products", "prodotti", "produkte", "shop", "negozio", "p", "product", "item", "articolo", "occhiali", "sunglasses", "eyewear", "clothing", "apparel", "shoes", "bags", "accessori", "accessories"),
}
SEGMENT_PARTS = {
    "rooms": ("room", "camera", "camere", "alloggi", "alloggio", "zimmer", "chambre", "suite", "villa", "accommodation"),
    "dining": ("dining", "ristorant", "restaurant", "food", "cuisine"),
    "wellness": ("spa", "wellness", "benessere"),
}
LATE_SEGMENT_TYPES = {
    "hotels": ("hotel", "hotels", "albergo", "alberghi"),
    "offers": ("offers", "offerte", "angebote"),
    "services": ("services", "servizi", "leistungen"),
}
# Path endings that are files, not pages.
STATIC_ENDINGS = ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "pdf", "zip", "mp4", "mp3", "xml")

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def with_scheme(url: Column) -> Column:
    """Trimmed, https:// put before a URL without a scheme; empty for null or blank."""
    t = F.trim(F.coalesce(url, F.lit("")))
    return F.when(t == "", "").when(t.rlike(_SCHEME), t).otherwise(F.concat(F.lit("https://"), t))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(with_scheme(url), _PARTS, group)


def scheme(url: Column) -> Column:
    """Lower-case scheme."""
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Lower-case host with port and user, as written."""
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    """Path as written."""
    return _part(url, 3)


def query_pairs(url: Column) -> Column:
    """key=value parts of the query, in order."""
    return F.filter(F.split(_part(url, 4), "&"), lambda x: x != "")


def is_tracking(pair: Column) -> Column:
    """Whether a query part's key only serves tracking."""
    key = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
    return key.isin(*TRACKING_KEYS) | key.startswith("utm_")


def stripped_pairs(url: Column) -> Column:
    """Query parts that sanitize() drops."""
    return F.filter(query_pairs(url), is_tracking)


def retained_pairs(url: Column) -> Column:
    """Query parts that sanitize() keeps."""
    return F.filter(query_pairs(url), lambda x: ~is_tracking(x))


def _encoded(part: Column) -> Column:
    """A key or value decoded and encoded again as form data: blanks as +, all but letters, digits and _.-~ as %XX."""
    plain = F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def encoded_pair(pair: Column) -> Column:
    """key=value, each encoded anew; a part without = has an empty value."""
    key = F.substring_index(pair, "=", 1)
    return F.concat(_encoded(key), F.lit("="), _encoded(F.substring(pair, F.length(key) + 2, F.length(pair))))


def sanitize(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no ;parameters, no trailing slashes, no tracking keys. Query parts keep
    their order and are encoded anew as form data; empty for null, blank or hostless input."""
    clean_path = F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "/+$", "")
    kept = F.array_join(F.transform(retained_pairs(url), encoded_pair), "&")
    whole = F.concat(scheme(url), F.lit("://"), authority(url), clean_path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(authority(url) == "", "").otherwise(whole)


def _counted(values: Column) -> Column:
    """Each value with how many equal ones stand before it."""
    return F.transform(values, lambda x, i: F.struct(x.alias("value"), F.size(F.filter(F.slice(values, F.lit(1), i), lambda y: y == x)).alias("no")))


def without_counted(values: Column, other: Column) -> Column:
    """The multiset difference of two arrays: of a value that stands n times in the first and m times in the other the last n - m stay."""
    return F.transform(F.filter(_counted(values), lambda v: F.size(F.filter(other, lambda y: y == v["value"])) <= v["no"]), lambda v: v["value"])


def removed_pairs(raw: Column, clean: Column) -> Column:
    """Query parts that one address has more often than the other."""
    return without_counted(query_pairs(raw), query_pairs(clean))


def analysis(url: Column) -> Column:
    """struct(raw, clean, stripped, retained, has_stripped)."""
    return F.struct(url.alias("raw"), sanitize(url).alias("clean"), stripped_pairs(url).alias("stripped"), retained_pairs(url).alias("retained"), (F.size(stripped_pairs(url)) > 0).alias("has_stripped"))


def normalize(url: Column) -> Column:
    """Lower-case, without scheme, www. and trailing slashes."""
    t = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^https?://", ""), r"^www\.", ""), "/+$", "")


def target(url: Column) -> Column:
    """Scheme and host in lower case, path without trailing slashes, no query and fragment."""
    return F.when(authority(url) == "", "").otherwise(F.concat(scheme(url), F.lit("://"), authority(url), F.regexp_replace(path(url), "/+$", "")))


def host(url: Column) -> Column:
    """Host name without user and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), "^[^@]*@", ""), ":[0-9]*$", "")


def domain(url: Column, replace_dots: bool = False) -> Column:
    """Host name, dots as underscores if wished."""
    return F.translate(host(url), ".", "_") if replace_dots else host(url)


def bare_domain(url: Column) -> Column:
    """Host name without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def site_root(url: Column) -> Column:
    """scheme://host/; http where the URL has no scheme."""
    own = F.when(F.trim(url).rlike(_SCHEME), scheme(url)).otherwise(F.lit("http"))
    return F.when(authority(url) == "", "").otherwise(F.concat(own, F.lit("://"), authority(url), F.lit("/")))


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def path_depth(url: Column) -> Column:
    """Number of non-empty path segments."""
    return F.size(segments(url)).cast("long")


def without_query(url: Column) -> Column:
    """The URL up to ? or #."""
    return F.regexp_replace(url, "[?#].*$", "")


def path_language(url: Column) -> Column:
    """Two-letter first segment, else empty."""
    return F.regexp_extract(F.lower(path(url)), "^/([a-z]{2})(?:-[a-z]{2})?(?:/|$)", 1)


def is_static(url: Column) -> Column:
    """Whether the path ends like a file."""
    return F.lower(path(url)).rlike(r"\.(" + "|".join(STATIC_ENDINGS) + ")$")


def fallback_icon(url: Column, service: str = "https://icons.invalid/?domain=") -> Column:
    """Address of an icon service for the URL's host."""
    return F.concat(F.lit(service), host(url))


def clean_media(url: Column) -> Column:
    """Without resize path parts and size parameters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "/rx/[^/]+/", "/"), "[?&](?:w|width|h|height|resize)=[0-9]+", ""), "[?]+$", "")


def skus(url: Column) -> Column:
    """Article numbers of a product address: the last segment's leading part, unless it is a plain word slug, then the
    colour, variant and sku parameters, each once."""
    last = F.regexp_replace(F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit("")), r"\.(?:html?|php)$", "")
    wordy = (last == F.lower(last)) & last.contains("-") & ~last.rlike("[0-9]")
    lead = F.regexp_extract(last, "^[a-zA-Z0-9]+", 0)
    own = F.when((F.length(last) > 4) & ~last.isin("product", "search", "category") & ~wordy, F.when(F.length(lead) >= 4, lead).otherwise(last))


    def named(key: str) -> Column:
        values = F.filter(query_pairs(url), lambda x: x.startswith(f"{key}=") & (x != f"{key}="))
        return F.substring_index(F.get(values, F.lit(0)), "=", -1)

    return F.array_distinct(F.array_compact(F.array(own, named("color"), named("variant"), named("sku"))))


def srcset(value: Column) -> Column:
    """array<struct(url, size)> of a srcset: widths as they are, densities times 1000, else 0."""
    entry = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    size = lambda x: F.coalesce(F.regexp_extract(x, r"(?i)\s([0-9]+)w$", 1).try_cast("long"), (F.regexp_extract(x, r"(?i)\s([0-9.]+)x$", 1).try_cast("double") * 1000).cast("long"), F.lit(0).cast("long"))
    return F.transform(entry, lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)).alias("url"), size(x).alias("size")))


def style_url(style: Column) -> Column:
    """Address of a CSS background, null for none."""
    return F.nullif(F.regexp_extract(style, r"""url\(\s*['"]?([^'")]+)""", 1), F.lit(""))


def media_in_text(text: Column, endings: tuple[str, ...]) -> Column:
    """Absolute and root-relative addresses with one of these endings, in order."""
    pattern = r"""(?i)((?:https?://|/)[^\s"'<>\\,]+\.(?:""" + "|".join(endings) + r""")(?:[^\s"'<>\\,]*))"""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def is_generic_sitemap(name: Column) -> Column:
    """Whether a sitemap's name says nothing of its content."""
    return F.lower(F.trim(name)).rlike(r"^(sitemap[-_]?(index|[0-9]+)?|index|urllist|sitemap)(\.xml|\.txt)?(\.gz)?$")


def content_type(url: Column, hint: Column | None = None) -> Column:
    """Kind of page from the first segment after language prefixes, else from the sitemap's name, else the directory."""
    rest = F.regexp_replace(F.concat(F.lower(path(url)), F.lit("/")), "^/*((?:[a-z]{2}(?:-[a-z]{2})?|row|global|intl)/+)*", "")
    parts = F.filter(F.split(rest, "/"), lambda x: x != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    out = F.when(first == "", "pages")
    for kind, names in SEGMENT_TYPES.items():
        out = out.when(first.isin(*names), kind)
    for kind, names in SEGMENT_PARTS.items():
        out = out.when(first.rlike("|".join(names)), kind)
    for kind, names in LATE_SEGMENT_TYPES.items():
        out = out.when(first.isin(*names), kind)
    if hint is not None:
        h = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
        told = (h != "") & ~is_generic_sitemap(h) & (h != "sitemap_index.xml")
        own = F.regexp_replace(F.regexp_replace(h, r"^sitemap[-_]?|[-_]sitemap([0-9]+)?(\.xml(\.gz)?)?$|\.xml(\.gz)?$", ""), "^[-_]+|[-_]+$", "")
        own = F.regexp_replace(own, "[^a-z0-9_-]", "")
        out = out.when(told & h.rlike("categor"), "categories").when(told & h.contains("tag"), "tags").when(told & h.contains("page"), "pages").when(told & h.contains("post"), "blog")
        out = out.when(told & (own != "") & ~own.contains("sitemap"), own)
    folder = F.regexp_replace(first, "[^a-z0-9_-]", "")
    return out.when((F.size(parts) > 1) & (folder != "") & ~folder.contains("sitemap"), folder).otherwise("pages")


def _found(text: Column) -> Column:
    """Links and bare domains of a text as they stand there, closing marks aside."""
    pattern = r"""(?i)https?://[^\s<>",;()]+|(?:www\.)[^\s<>",;()]+|(?<![@\w])(?:[a-zA-Z0-9-]+\.)+(?:""" + "|".join(BARE_ENDINGS) + r""")(?:/[^\s<>",;()]*)?"""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"""[.,;:!?'"]+$""", ""))


def extract(text: Column) -> Column:
    """Sanitised links of a text, each once, in order."""
    return F.array_distinct(F.filter(F.transform(_found(text), sanitize), lambda x: x != ""))


def extract_analysed(text: Column) -> Column:
    """analysis() of the links of a text, of those with one clean address the first."""
    return let(F.transform(_found(text), analysis), lambda all_: F.filter(all_, lambda a, i: (a["clean"] != "") & (F.array_position(F.transform(all_, lambda x: x["clean"]), a["clean"]) == i + 1)))
