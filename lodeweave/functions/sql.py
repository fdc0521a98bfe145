"""The library's functions for Spark SQL: SQL functions, which Catalyst puts into the query as expressions, and table functions.

register(spark) makes them known to the session. SQL functions: slugify, param_case, normalize_url, url_host, url_path,
content_type. Table functions, for LATERAL: extract_urls(text) and sitemap_entries(xml).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import quote_plus, unquote_plus

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from lodeweave.functions import urls


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(map(_text, names))


_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-'), '^-+|-+$', '')"
#: Whole addresses: scheme, host, path; those without a scheme count as https.
_PARTS = r"regexp_extract(CASE WHEN trim(coalesce(url, '')) RLIKE '^[a-zA-Z][a-zA-Z0-9+.-]*://' THEN trim(url) ELSE concat('https://', trim(coalesce(url, ''))) END, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)', {})"


def _content_type() -> str:
    parts = r"filter(split(regexp_replace(concat(lower(" + _PARTS.format(2) + r"), '/'), '^/*((?:[a-z]{2}(?:-[a-z]{2})?|row|global|intl)/+)*', ''), '/'), x -> x <> '')"
    first = "coalesce(get(p, 0), '')"
    cases = [f"WHEN {first} = '' THEN 'pages'"]
    cases += [f"WHEN {first} IN ({_listed(names)}) THEN {_text(kind)}" for kind, names in urls.SEGMENT_TYPES.items()]
    cases += [f"WHEN {first} RLIKE {_text('|'.join(names))} THEN {_text(kind)}" for kind, names in urls.SEGMENT_PARTS.items()]
    cases += [f"WHEN {first} IN ({_listed(names)}) THEN {_text(kind)}" for kind, names in urls.LATE_SEGMENT_TYPES.items()]
    folder = f"regexp_replace({first}, '[^a-z0-9_-]', '')"
    cases.append(f"WHEN size(p) > 1 AND {folder} <> '' AND NOT contains({folder}, 'sitemap') THEN {folder}")
    return f"get(transform(array({parts}), p -> CASE {' '.join(cases)} ELSE 'pages' END), 0)"


#: name -> (parameter, expression).
FUNCTIONS = {
    "slugify": ("text", f"coalesce(nullif({_SLUG.format('coalesce(text, ' + _text('') + ')')}, ''), 'default')"),
    "param_case": ("text", "coalesce(nullif(" + _SLUG.format(r"regexp_replace(replace(coalesce(text, ''), '_', ' '), '([a-z0-9])([A-Z])', '$1 $2')") + ", ''), 'unnamed')"),
    "normalize_url": ("url", r"regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '^https?://', ''), '^www[.]', ''), '/+$', '')"),
    "url_host": ("url", r"regexp_replace(regexp_replace(lower(" + _PARTS.format(1) + r"), '^[^@]*@', ''), ':[0-9]*$', '')"),
    "url_path": ("url", _PARTS.format(2)),
    "content_type": ("url", _content_type()),
}

_FOUND = re.compile(r"""https?://[^\s<>",;()]+|(?:www\.)[^\s<>",;()]+|(?<![@\w])(?:[a-zA-Z0-9-]+\.)+(?:""" + "|".join(urls.BARE_ENDINGS) + r""")(?:/[^\s<>",;()]*)?""", re.IGNORECASE | re.ASCII)


def clean_url(url: str) -> tuple[str, list[str]]:
    """(the address as urls.sanitize() gives it, its tracking parts); an empty address without a host."""
    whole = url.strip()
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", whole):
        whole = "https://" + whole
    scheme, rest = whole.split("://", 1)
    host = re.match(r"[^/?#]*", rest)[0]
    if not host:
        return "", []
    tail = rest[len(host) :].split("#", 1)[0]
    path, _, query = tail.partition("?")
    tracking = lambda x: x.split("=", 1)[0].lower() in urls.TRACKING_KEYS or x.lower().startswith("utm_")
    pairs = [x for x in query.split("&") if x]
    form = lambda x: quote_plus(unquote_plus(x), safe="")
    kept = [f"{form(k)}={form(v)}" for k, _, v in (x.partition("=") for x in pairs if not tracking(x))]
    path = re.sub(r"/+$", "", re.sub(r";[^/]*$", "", path))
    return f"{scheme.lower()}://{host.lower()}{path}" + ("?" + "&".join(kept) if kept else ""), [x for x in pairs if tracking(x)]


class ExtractUrls:
    """The links of a text with a clean address each, of those with one clean address the first."""

    def eval(self, text: str) -> Iterator[tuple]:
        seen: set[str] = set()
        for m in _FOUND.finditer(text or ""):
            raw = re.sub(r"""[.,;:!?'"]+$""", "", m[0])
            clean, stripped = clean_url(raw)
            if clean and clean not in seen:
                seen.add(clean)
                yield len(seen) - 1, raw, clean, stripped, bool(stripped)


class SitemapEntries:
    """loc and lastmod of each entry of a sitemap, in order; of anything else none."""

    def eval(self, xml: str) -> Iterator[tuple]:
        for i, m in enumerate(re.finditer(r"<(url|sitemap)\b[^>]*>(.*?)</\1>", xml or "", re.DOTALL | re.IGNORECASE)):
            loc, mod = (re.search(rf"<{t}\b[^>]*>\s*(.*?)\s*</{t}>", m[2], re.DOTALL | re.IGNORECASE) for t in ("loc", "lastmod"))
            if loc and loc[1]:
                yield i, unescape(loc[1]), mod[1] if mod else None


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for name, (parameter, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter} STRING) RETURNS STRING RETURN {body}")
    text = T.StringType()
    links = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("raw", text), T.StructField("clean", text), T.StructField("stripped", T.ArrayType(text)), T.StructField("has_stripped", T.BooleanType())])
    entries = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("loc", text), T.StructField("lastmod", text)])
    spark.udtf.register("extract_urls", udtf(ExtractUrls, returnType=links))
    spark.udtf.register("sitemap_entries", udtf(SitemapEntries, returnType=entries))
