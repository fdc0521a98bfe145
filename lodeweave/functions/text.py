"""Text functions as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of parked or spam domains.
PARKED_PHRASES = (
    "domain has been purchased and parked", "parked at loopia", "this domain is parked", "registered at namecheap", "this site is parked", "godaddy parking",
    "this domain is for sale", "domain is registered and parked", "domain parking", "buy this domain", "acquista questo dominio", "questo dominio potrebbe essere in vendita",
    "seo.domains", "loopiawhois", "get this domain name before someone else does", "live casino action", "real money games", "premium slots", "fast payouts",
    "online casino", "sports betting", "slot deposit", "situs judi", "judi online",
)
# Phrases of navigation and footers.
CHROME_PHRASES = ("cookie policy", "privacy policy", "terms of service", "all rights reserved", "copyright", "menu", "navigation", "search", "login", "sign in", "register")
# Marks of an application shell without content.
SHELL_MARKS = ("<app-root", "ng-version", "_nghost", "data-reactroot")
# Marks of challenge pages.
CHALLENGE_MARKS = ("robot-suspicion", "checking the site connection security", "checking your browser", "<title>just a moment", "confirm you are human", "sg-captcha")
# Country codes.
COUNTRIES = {
    "it": "Italy", "es": "Spain", "uk": "United Kingdom", "us": "United States", "de": "Germany", "fr": "France", "pt": "Portugal", "ch": "Switzerland", "jp": "Japan", "nl": "Netherlands",
    "be": "Belgium", "se": "Sweden", "dk": "Denmark", "no": "Norway", "at": "Austria", "au": "Australia", "ca": "Canada", "br": "Brazil", "global": "Global",
}


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: within a lambda the optimizer cannot paste it into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """Blanks folded, at most one empty line, trimmed, form residue removed; empty for null."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, "[\t ]+", " "), "\n{3,}", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+", ""), r"\s+$", "")
    return F.regexp_replace(F.regexp_replace(t, "input type=.*?>", ""), "<label.*?label>", "")


def file_name(text: Column) -> Column:
    """Letters, digits and -_.() kept, blanks as underscores, 100 characters."""
    return F.left(F.replace(F.regexp_replace(text, "[^-_.() A-Za-z0-9]", ""), F.lit(" "), F.lit("_")), F.lit(100))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens; `default` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "default").otherwise(s)


def param_case(text: Column) -> Column:
    """slug() that also parts camelCase; `unnamed` if nothing is left."""
    t = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unnamed").otherwise(s)


def page_title(title: Column) -> Column:
    """What stands before the first spaced bar or dash; `Untitled` for none."""
    t = F.trim(F.get(F.split(F.coalesce(title, F.lit("")), r"\s+[|–—-]\s+|\s*\|\s*"), F.lit(0)))
    return F.when(t == "", "Untitled").otherwise(t)


def cell(text: Column) -> Column:
    """For a Markdown table: white space folded, bars escaped."""
    return F.replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit(r"\|"))


def is_parked(text: Column) -> Column:
    """Whether a text holds a phrase of parked domains."""
    return _any(F.lower(F.coalesce(text, F.lit(""))), PARKED_PHRASES)


def is_meaningful(text: Column, least: int = 50) -> Column:
    """Long enough, not a short piece of page furniture, and not mostly links."""
    t = clean(text)
    links = F.regexp_count(t, F.lit("http")) / (F.length(t) + 1)
    return (F.length(t) >= least) & ~(_any(F.lower(t), CHROME_PHRASES) & (F.length(t) < 200)) & (links <= 0.1)


def is_shell(html: Column) -> Column:
    """Whether a page is an application shell."""
    return _any(html, SHELL_MARKS)


def is_untitled(title: Column, path: Column | None = None) -> Column:
    """Whether a title says that there is none, or the Markdown file's name or folder does."""
    t = F.lower(F.trim(F.coalesce(title, F.lit("")))).isin("untitled", "untitled page")
    if path is None:
        return t
    return t | F.lower(F.coalesce(path, F.lit(""))).rlike(r"(?:^|/)untitled\.md$|(?:^|/)untitled(?:_[^/]*)?/[^/]*$")


def is_untitled_or_empty(title: Column, path: Column, status: Column, markdown: Column) -> Column:
    """Whether a page is to be fetched again: untitled, or completed without a title or without a body below its head."""
    t, body = F.trim(F.coalesce(title, F.lit(""))), F.regexp_replace(body_of(F.coalesce(markdown, F.lit(""))), r"^\s+|\s+$", "")
    return is_untitled(title, path) | (F.coalesce(status == "completed", F.lit(False)) & ((t == "") | (body == "")))


def shop_name(raw: Column) -> Column:
    """A shop's name: what stands before the first |, dash between blanks or em dash; blanks folded."""
    first = F.get(F.split(F.coalesce(raw, F.lit("")), r"\s*[|\u2014]\s*|\s+-\s+", 2), F.lit(0))
    return F.trim(F.regexp_replace(first, r"\s+", " "))


def is_unrendered(html: Column) -> Column:
    """Whether raw HTML is missing, very short or a challenge; blank and untitled pages need the parsed page."""
    h = F.coalesce(html, F.lit(""))
    return (F.length(F.trim(h)) < 500) | _any(F.lower(h), CHALLENGE_MARKS)


def body_of(markdown: Column) -> Column:
    """What follows the first line of ---, or all of it."""
    parts = F.split(markdown, "\n---\n", 2)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(markdown)


def plain_from_markdown(md: Column) -> Column:
    """Markdown without its marks; sentences parted by an empty line."""
    t = F.coalesce(md, F.lit(""))
    for pattern, to in (
        (r"!\[.*?\]\(.*?\)", ""), (r"\[(.*?)\]\(.*?\)", "$1"), (r"(?m)#{1,6}\s+(.*?)$", "$1"), (r"(?m)>\s+(.*?)$", "$1"),
        (r"(?s)```.*?```", ""), (r"`(.*?)`", "$1"), (r"<.*?>", ""), (r"\|.*?\|", ""), (r"\|[\s-]*\|", ""),
        (r"(?m)^\s*[*+-]\s+(.*?)$", "$1"), (r"(?m)^\s*\d+\.\s+(.*?)$", "$1"), (r"(?m)^\s*[*_-]{3,}\s*$", ""),
        (r"\s+", " "), (r"(\. )([A-Z])", ".\n\n$2"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "\n"))


def longest_run(text: Column, char: str) -> Column:
    """Length of the longest run of a character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"{char}+"), F.lit(0)), F.length)), F.lit(0)).cast("long")


def breadcrumbs(place: Column, mark: str = "›") -> Column:
    """Parts of a breadcrumb trail."""
    return F.filter(F.transform(F.split(place, mark), lambda x: F.trim(x)), lambda x: x != "")


def sitemap_directives(robots: Column) -> Column:
    """Sitemap addresses that a robots file names."""
    return F.regexp_extract_all(robots, F.lit(r"""(?im)sitemap:\s*(https?://[^\s<"']+)"""), F.lit(1))


def document(title: Column, rows: Column, body: Column) -> Column:
    """Markdown page: title, table of (name, value) structs, line, body."""
    table = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), cell(r["name"]), F.lit(" | "), cell(r["value"]), F.lit(" |"))), "\n")
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), F.lit("| Field | Value |"), F.lit("|---|---|"), table, F.lit(""), F.lit("---"), F.lit(""), body)


def markdown_images(md: Column) -> Column:
    """Addresses of a Markdown text's images, each once, without data: ones."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)), lambda x: ~x.startswith("data:")))


def expand_location(place: Column, cities: dict[str, str], countries: dict[str, str] = COUNTRIES) -> Column:
    """A known country code as its name, a known city with its country, anything with a comma and all else as it is."""
    key = F.lower(F.trim(place))
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k.lower(), v)]) if d else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    city = F.try_element_at(table(cities), key)
    return F.when(place.contains(","), place).otherwise(F.coalesce(F.try_element_at(table(countries), key), F.concat(F.trim(place), F.lit(", "), city), F.trim(place)))
