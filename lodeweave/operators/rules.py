"""Rule-based classification: keyword tables scored over a primary text and a body, as native expressions.

A rule table is a list of (pattern, label); earlier rules win ties. Patterns are matched on lower-case text with
Unicode word borders. A text is cut into words once for all tables that are asked for: the patterns' alternatives that are one word,
or the start of one, are looked up in hash sets, which leaves the few words that any rule knows, and rules count among those.
Alternatives of several words are looked for only where a word stands that one of them begins with; only if one is found, its rule
is matched as a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.text import let

# Category rules in order.
CATEGORY_RULES = (
    (r"\btech\b|\bdevelop\b|\bdeveloper\b|\bcode\b|\bcoding\b|\bapi\b|\bapis\b|\bprogramming\b|\bsoftware\b|\bcloud\b|\bdatabase\b|\bpostgres\b|\bsaas\b|\bpython\b|\bjavascript\b|\btypescript\b", "Technology"),
    (r"\bdesign\b|\bdesigner\b|\bui\b|\bux\b|\bgraphics\b|\btypography\b|\btypeface\b|\bbranding\b|\blayout\b", "Design"),
    (r"\bstreet\w*|\bfashion\b|\bapparel\b|\bclothing\b|\bjeans\b|\bdenim\b|\bsneakers?\b|\bwear\b|\bfootwear\b|\boutfit\b|\bboutique\b|\baccessories\b|\bsunglasses\b|\bocchiali\b", "Street"),
    (r"\bcycling\b|\bbike\b|\bbikes\b|\bbicycle\b", "Cycling"),
    (r"\bsnowboard\w*|\bski\b|\bskiing\b", "Snowboarding"),
    (r"\bhik\w+|\btrek\w+|\boutdoor\w+|\bcamp\w+", "Hiking"),
    (r"\byoga\b|\bpilates\b", "Yoga"),
    (r"\bfurniture\b|\bhome\b|\bkitchen\b|\bbathroom\b|\blighting\b|\bdecor\b|\binterior\b", "Home"),
    (r"\bcar\b|\bcars\b|\bauto\b|\bautomotive\b|\bvehicle\b|\bwheels?\b|\btyres?\b", "Car"),
    (r"\bfood\b|\brestaurant\b|\bbakery\b|\bgourmet\b|\bsnacks?\b", "Food"),
    (r"\bbeverage\b|\bcoffee\b|\btea\b|\bwine\b|\bbeer\b|\bdrinks?\b", "Beverage"),
    (r"\bwellness\b|\bhealth\b|\bspa\b|\bskincare\b|\bcosmetic\w*|\bfitness\b", "Wellness"),
    (r"\boffice\b|\bstationary\b|\bdesk\b|\bpens?\b|\bnotebooks?\b", "Office"),
    (r"\bcreativ\w+|\bstudio\b|\bagency\b|\bportfolio\b|\bvisuals?\b|\bconsultancy\b", "Creativity"),
    (r"\bfinance\b|\bfinancial\b|\binvest\w+|\bbanking\b|\bcrypto\w*|\bfintech\b|\baccounting\b|\bloans?\b|\bwealth\b", "Financial"),
    (r"\bmanagement\b|\badmin\b|\benterprise\b|\boperations\b|\bbusiness\b|\bexecutive\b|\bconsulting\b", "Management"),
    (r"\bmarketing\b|\bseo\b|\bads?\b|\badvertising\b|\bcampaign\b|\bsem\b|\bpublic relations\b|\bpr\b", "Marketing"),
    (r"\bwrite\b|\bwriting\b|\bcontent\b|\bcopywriting\b|\bjournal\b|\bmagazine\b|\bblog\b|\beditorial\b|\bessays?\b", "Writing"),
    (r"\bart\b|\bartist\b|\bartists\b|\bmusic\b|\bvideo\b|\bfilm\b|\billustrat\w+|\banimat\w+|\bpainting\b", "Artists"),
    (r"\btravel\b|\btour\w*|\bhotel\b|\bbooking\b|\bflight\b|\bdestination\b|\bresort\b|\bvacation\b|\bguest house\b", "Traveller"),
    (r"\bassistant\b|\bai\b|\bcopilot\b|\bchatbot\b|\bgpt\b|\bllm\b|\bvirtual assistant\b", "Assistant"),
    (r"\bbuilder\b|\bgenerator\b|\bno-code\b|\blow-code\b|\bscaffold\b|\bsite builder\b|\bpage builder\b", "Builder"),
    (r"\bcreator\b|\bpodcast\b|\byoutube\b|\bstreaming\b|\bmedia\b|\binfluencer\b", "Content Creation"),
    (r"\beconomics?\b|\bmacroeconomic\b|\bmarket analysis\b|\beconomy\b", "Economics"),
    (r"\blegal\b|\blaw\b|\blawyer\b|\battorney\b|\bcompliance\b|\bgdpr\b|\bregulatory\b", "Legal"),
    (r"\butil\b|\butility\b|\bhelper\b|\bconverter\b|\bcalculator\b", "Joker"),
)
# Type rules in order.
TYPE_RULES = (
    (r"\bservice\b|\bsmtp\b|\bcdn\b|\bhosting\b|\bplatform\b|\bapi\b|\bcloud backend\b|\binfrastructure\b", "Service"),
    (r"\bplugin\b|\bextension\b|\baddon\b|\badd-on\b|\bchrome extension\b|\bfirefox addon\b", "Plugin"),
    (r"\bmodel\b|\bdiffusion\b|\bgpt\b|\bllm\b|\bweights\b|\bneural network\b", "Model"),
    (r"\bshop\b|\becommerce\b|\bstore\b|\bcheckout\b|\bcart\b|\bboutique\b|\bretail\b", "Shop"),
    (r"\bapp\b|\bapplication\b|\bide\b|\bdashboard\b|\bsaas\b|\bweb app\b|\bdesktop app\b", "Application"),
    (r"\btools?\b|\bconverter\b|\bcalculator\b|\bgenerator\b|\bchecker\b|\bvalidator\b|\binspector\b", "Tools"),
    (r"\butil\b|\butils\b|\bhelper\b|\bscript\b", "Utils"),
    (r"\bstudio\b|\bagency\b|\bconsultancy\b|\bfirm\b", "Business"),
    (r"\bhotel\b|\bresort\b|\blodging\b", "Hotel"),
    (r"\bguest house\b|\bbed and breakfast\b|\bb&b\b", "Guest"),
    (r"\bmagazine\b|\bjournal\b|\bperiodical\b", "Magazine"),
    (r"\bportfolio\b|\bworks\b|\bshowcase\b", "Solo"),
    (r"\bartist\b|\bpainter\b|\bmusician\b|\billustrator\b", "Artist"),
)
# Tag rules in order.
TAG_RULES = (
    (r"\b(?:icons?|iconics?|iconography|favicons?)\b", "iconics"), (r"\b(?:archives?|archiving|archived|wayback)\b", "archive"), (r"\b(?:calc|calculat(?:or|ors|ion|ions))\b", "calc"),
    (r"\b(?:convert|convert(?:er|ers|ion|ing))\b", "convert"), (r"\b(?:fonts?|typefaces?|typography)\b", "fonts"), (r"\b(?:db|databases?|sql|nosql|postgres|mysql|sqlite)\b", "db"),
    (r"\b(?:domains?|whois|tld|registrars?)\b", "domains"), (r"\b(?:flights?|airfare|airline)\b", "flights"), (r"\b(?:maps?|mapping|geolocat\w+|coordinates)\b", "maps"),
    (r"\b(?:tables?|spreadsheets?|csv|tsv)\b", "tables"), (r"\b(?:trips?|travel|tourism)\b", "trips"), (r"\b(?:cron|crontabs?|cronjobs?|scheduled\s*tasks?)\b", "cronjob"),
    (r"\b(?:free\s*stock|stock\s*(?:photos?|images?|vectors?|videos?))\b", "free stock"), (r"\bqr(?:\s*codes?)?\b", "qr"), (r"\b(?:grammar|spell(?:ing)?\s*check(?:er)?)\b", "grammar"),
    (r"\b(?:inspect|inspector|inspection)\b", "inspection"), (r"\b(?:case\s*convert(?:er)?|camelcase|snake_case|kebab-case|title\s*case)\b", "case"), (r"\b(?:weather|forecast|meteorolog\w+)\b", "weather"),
    (r"\b(?:crypto|cryptocurrency|bitcoin|ethereum|blockchain)\b", "crypto"), (r"\b(?:currency|currencies|exchange\s*rate|forex)\b", "currency"), (r"\b(?:emails?|newsletter|inbox|smtp|mail)\b", "email"),
    (r"\b(?:privacy|gdpr|cookie\s*consent)\b", "privacy"), (r"\b(?:api|rest\s*api|graphql|endpoints?)\b", "api"), (r"\b(?:hosting|deploy|deployment|vps|serverless)\b", "hosting"),
    (r"\b(?:ai|artificial intelligence|llm|gpt|machine learning)\b", "ai"), (r"\b(?:design|ui|ux|branding|visual)\b", "design"), (r"\b(?:ecommerce|store|shop|online store)\b", "ecommerce"),
)
# Genre rules in order.
GENRE_RULES = (
    (r"\bai\b|\bartificial intelligence\b|\bmachine learning\b|\bllm\b", "AI"), (r"\b3d\b|\bthreejs\b|\bblender\b|\bcgi\b", "3D"), (r"\bdesign\b|\bui\b|\bux\b", "Design"), (r"\btypography\b|\btype\b|\bfont\b", "Typography"),
    (r"\bbranding\b|\bidentity\b", "Branding"), (r"\badv\b|\badvertising\b", "Adv"), (r"\bagency\b|\bstudio\b", "Agency"), (r"\banimation\b|\bmotion\b", "Animation"), (r"\barchitecture\b|\binterior\b", "Architecture"),
    (r"\bart\b|\bcreative\b", "Art"), (r"\bbackend\b|\bserver\b", "Backend"), (r"\bfrontend\b|\bweb development\b", "Frontend"), (r"\bdigital\b", "Digital"), (r"\bfashion\b|\bapparel\b", "Fashion"),
    (r"\bphotography\b|\bphoto\b", "Photography"), (r"\bproduct\b|\bindustrial\b", "Product"), (r"\bhotellerie\b|\bhotel\b", "Hotellerie"), (r"\bvideo\b|\bfilm\b", "Video"), (r"\bweb\b", "Web"),
)

# Words that stand for a known tag.
KNOWN_TAG_WORDS = {
    "iconics": r"\b(?:icons?|iconics?|iconography|favicons?)\b", "archive": r"\b(?:archives?|archiving|archived|wayback)\b", "calc": r"\b(?:calc|calculat(?:or|ors|ion|ions))\b", "convert": r"\b(?:convert|convert(?:er|ers|ion|ing))\b",
    "fonts": r"\b(?:fonts?|typefaces?)\b", "db": r"\b(?:db|databases?|sql|nosql)\b", "domains": r"\b(?:domains?|whois|tld|registrars?)\b", "flights": r"\b(?:flights?|airfare|airline)\b",
    "maps": r"\b(?:maps?|mapping|geolocat\w+|coordinates)\b", "tables": r"\b(?:tables?|spreadsheets?|csv|tsv)\b", "trips": r"\b(?:trips?|travel|tourism)\b", "strs": r"\b(?:strings?|strs?)\b",
    "cronjob": r"\b(?:cron|crontabs?|cronjobs?|scheduled\s*tasks?)\b", "free stock": r"\b(?:free\s*stock|stock\s*(?:photos?|images?|vectors?|videos?))\b", "qr": r"\bqr(?:\s*codes?)?\b", "grammar": r"\b(?:grammar|spell(?:ing)?\s*check(?:er)?)\b",
    "inspection": r"\b(?:inspect|inspector|inspection)\b", "case": r"\b(?:case\s*convert(?:er)?|camelcase|snake_case|kebab-case|title\s*case|uppercase|lowercase)\b", "weather": r"\b(?:weather|forecast|meteorolog\w+)\b",
    "crypto": r"\b(?:crypto|cryptocurrency|bitcoin|ethereum|blockchain)\b", "currency": r"\b(?:currency|currencies|exchange\s*rate|forex)\b", "email": r"\b(?:emails?|newsletter|inbox|smtp|mail)\b", "privacy": r"\b(?:privacy|gdpr|cookie\s*consent)\b",
    "sea": r"\b(?:search engine advertising|sea)\b", "ide": r"\b(?:ide|integrated development environment)\b",
}
# Tags that say nothing, and tags that count in the primary text only.
EMPTY_TAGS, PRIMARY_TAGS = ("other", "utils", "application", "model"), ("data", "css", "audio", "search", "text", "design", "media")
# Tags of creatives in order, and dynamic tags that say nothing, and short ones that do.
CREATIVE_TAGS = (
    (r"\bportfolio\b", "Portfolio"), (r"\banimation\b", "Animation"), (r"\b(?:interactive|interaction|interactions)\b", "Interactions"), (r"\bcontents?\b", "Contents"), (r"\blayout\b", "Layout"),
    (r"\btypography\b", "Typography"), (r"\b(?:collaborate|collaboration)\b", "Collaboration"), (r"\b(?:ui|ux)\b", "UI/UX"), (r"\b(?:hotel marketing|marketing alberghiero)\b", "Hotel Marketing"),
)
EMPTY_DYNAMIC, SHORT_DYNAMIC = ("other", "changed", "closed", "not loading", "403", "503"), ("AI", "3D", "UI", "UX")

Rules = tuple[tuple[str, str], ...]


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _hit(low: Column, pattern: str) -> Column:
    return low.rlike("(?U)" + pattern)


def _plain(low: Column) -> Column:
    """Whether a text is ASCII, where patterns mean the same without Unicode's classes and are matched faster."""
    return F.octet_length(low) == F.char_length(low)


def words_of(low: Column) -> Column:
    """A text's words in order."""
    words = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    return F.when(_plain(low), words(r"\w+")).otherwise(words(r"(?U)\w+"))


def _times(low: Column, pattern: str) -> Column:
    return F.regexp_count(low, F.lit("(?U)" + pattern))


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, groups and optional characters written out; repeats stay as they are."""
    found, at = [""], 0
    while at < len(pattern):
        if pattern[at] == "|":
            return found + _alternatives(pattern[at + 1 :])
        if pattern.startswith("(?:", at):
            depth, end = 1, at + 3
            while depth:
                depth += (pattern[end] == "(") - (pattern[end] == ")")
                end += 1
            parts = _alternatives(pattern[at + 3 : end - 1])
        else:
            end = at + (2 if pattern[at] == "\\" else 1)
            parts = [pattern[at:end]]
        if pattern[end : end + 1] == "?":
            parts, end = ["", *parts], end + 1
        elif pattern[end : end + 1] in ("*", "+"):
            parts, end = [x + pattern[end] for x in parts], end + 1
        found, at = [f + x for f in found for x in parts], end
    return found


@lru_cache(512)
def _terms(pattern: str) -> tuple[frozenset[str], frozenset[tuple[str, int]], str]:
    """A pattern's whole words, its starts of words (with the least length of the word), and the rest as a pattern."""
    words, starts, rest = set(), set(), []
    for a in dict.fromkeys(_alternatives(pattern)):
        if m := re.fullmatch(r"\\b(\w+)\\b", a):
            words.add(m[1])
        elif m := re.fullmatch(r"\\b(\w+)\\w([*+])(?:\\b)?", a):
            starts.add((m[1], len(m[1]) + (m[2] == "+")))
        else:
            rest.append(a)
    return frozenset(words), frozenset(starts), "|".join(rest)


@lru_cache(512)
def _leads(rest: str) -> tuple[frozenset[str], frozenset[tuple[str, int]]] | None:
    """The words, and starts of words, of which a text that any alternative of `rest` matches holds one: what the alternatives
    begin with. None if one does not begin with the start of a word."""
    words, starts = set(), set()
    for a in rest.split("|") if rest else ():
        m = re.match(r"\\b(\w+)", a)
        start, after = (m[1], a[m.end() :]) if m else ("", "")
        if after[:1] in ("*", "+", "?", "{"):  # the last character may be missing
            start, after = start[:-1], ""
        if not start:
            return None
        if re.match(r"[ &-](?![*?{])", after):
            words.add(start)
        else:
            starts.add((start, len(start)))
    return frozenset(words), frozenset(starts)


def _known(words: frozenset[str], starts: frozenset[tuple[str, int]]) -> Callable[[Column], Column]:
    """Whether a word is one of these or starts as one of those."""
    by_length: dict[tuple[int, int], list[str]] = {}
    for start, least in sorted(starts):
        by_length.setdefault((len(start), least), []).append(start)
    shortest = min((n for n, _ in by_length), default=0)

    def test(w: Column) -> Column:
        out = F.lit(False)
        for (n, least), some in by_length.items():
            hit = F.substring(w, 1, n).isin(*some)
            out = out | (hit & (F.length(w) >= least) if least > n else hit)
        if len(by_length) > 1:  # most words differ from all starts early
            out = F.substring(w, 1, shortest).isin(*sorted({start[:shortest] for start, _ in starts})) & out
        return w.isin(*sorted(words)) | out if words else out

    return test


def _looked_up_each(low: Column, tables: Sequence[tuple[str, ...]]) -> Column:
    """A struct with a field t0, t1, ... for each table of patterns: struct(text, its words that any of the patterns knows, whether
    it may hold alternatives of several words)."""
    none = frozenset()
    asked = []
    for patterns in tables:
        terms = [_terms(p) for p in patterns]
        rest = "|".join(t[2] for t in terms if t[2])
        asked.append((none.union(*(t[0] for t in terms)), none.union(*(t[1] for t in terms)), rest, _leads(rest)))
    every = [none.union(*(a[i] for a in asked), *(a[3][i] for a in asked if a[3])) for i in (0, 1)]

    def wide(kept: Column, rest: str, leads: tuple | None) -> Column:
        found = F.when(_plain(low), low.rlike(rest)).otherwise(_hit(low, rest)) if rest else F.lit(False)
        return F.when(F.exists(kept, _known(*leads)), found).otherwise(False) if rest and leads else found

    def each(kept: Column) -> Column:
        return F.struct(*[F.struct(low.alias("low"), F.filter(kept, _known(words, starts)).alias("words"), wide(kept, rest, leads).alias("wide")).alias(f"t{i}") for i, (words, starts, rest, leads) in enumerate(asked)])

    return let(F.filter(words_of(low), _known(*every)), each)


def _looked_up(low: Column, patterns: tuple[str, ...]) -> Column:
    """struct(text, its words that any of the patterns knows, whether it may hold alternatives of several words)."""
    return _looked_up_each(low, [patterns])["t0"]


def _found_times(t: Column, pattern: str) -> Column:
    """How often a pattern matches a looked-up text."""
    words, starts, rest = _terms(pattern)
    n = F.size(F.filter(t["words"], _known(words, starts))) if words or starts else F.lit(0)
    return F.when(t["wide"], _times(t["low"], pattern)).otherwise(n) if rest else n


def _found(t: Column, pattern: str) -> Column:
    """Whether a pattern matches a looked-up text."""
    words, starts, rest = _terms(pattern)
    hit = F.exists(t["words"], _known(words, starts)) if words or starts else F.lit(False)
    return F.when(t["wide"], _hit(t["low"], pattern)).otherwise(hit) if rest else hit


def _patterns(rules: Rules) -> tuple[str, ...]:
    return tuple(p for p, _ in rules)


def _with_tables(primary: Column, body: Column, tables: Sequence[Rules], make: Callable[[list[tuple[Column, Column]]], Column]) -> Column:
    """make((primary text, body) of each table), both looked up once for all rules of all tables."""
    patterns = [_patterns(rules) for rules in tables]
    texts = F.struct(_low(primary).alias("p"), _low(body).alias("b"))
    found = lambda t: F.struct(_looked_up_each(t["p"], patterns).alias("p"), _looked_up_each(t["b"], patterns).alias("b"))
    return let(texts, lambda t: let(found(t), lambda x: make([(x["p"][f"t{i}"], x["b"][f"t{i}"]) for i in range(len(tables))])))


def _with_words(primary: Column, body: Column, rules: Rules, make: Callable[[Column, Column], Column]) -> Column:
    """make(primary text, body), both looked up once for all rules."""
    return _with_tables(primary, body, [rules], lambda texts: make(*texts[0]))


def _with_texts(primary: Column, body: Column, make: Callable[[Column, Column], Column]) -> Column:
    """make(lower-case primary text, lower-case body), both worked out once."""
    return let(F.struct(_low(primary).alias("p"), _low(body).alias("b")), lambda t: make(t["p"], t["b"]))


def _counted(primary: Column, body: Column, rules: Rules) -> Column:
    """Array of (place, label, hit in the primary text, n hits in the body) of looked-up texts."""
    return F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), _found(primary, p).alias("hit"), _found_times(body, p).alias("n")) for i, (p, label) in enumerate(rules)])


def _best(scores: Column) -> Column:
    """struct(score, label) of the highest score above 0 among (score, -place, label), of equals the first; null for none."""
    return let(F.array_max(F.filter(scores, lambda r: r["score"] > 0)), lambda top: F.when(top.isNotNull(), F.struct(top["score"].alias("score"), top["label"].alias("label"))))


def _category(p: Column, b: Column, rules: Rules) -> Column:
    def score(r: Column) -> Column:
        points = F.when(r["hit"], 3.0).otherwise(0.0) + F.when(r["n"] >= 2, F.least(F.lit(2.0), r["n"] * 0.5)).otherwise(0.0)
        return F.struct(points.alias("score"), (-r["place"]).alias("place"), r["label"].alias("label"))

    return _best(F.transform(_counted(p, b, rules), score))


def _page_type(p: Column, b: Column, rules: Rules) -> Column:
    points = [F.when(_found(p, x), 3.0).when(_found(b, x), 1.0).otherwise(0.0) for x, _ in rules]
    return _best(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label")) for i, (s, (_, label)) in enumerate(zip(points, rules, strict=True))]))


def _tags(p: Column, b: Column, rules: Rules, most: int = 5) -> Column:
    found = F.array(*[F.when(_found(p, x) | (_found_times(b, x) >= 2), label) for x, label in rules])
    return F.slice(F.array_distinct(F.array_compact(found)), 1, most)


def _first(t: Column, rules: Rules) -> Column:
    return F.coalesce(*[F.when(_found(t, p), label) for p, label in rules])


def category(primary: Column, body: Column, rules: Rules = CATEGORY_RULES) -> Column:
    """3 for a hit in the primary text, and from two in the body half a point each, at most 2."""
    return _with_words(primary, body, rules, lambda p, b: _category(p, b, rules))


def page_type(primary: Column, body: Column, rules: Rules = TYPE_RULES) -> Column:
    """3 for a hit in the primary text, else 1 for one in the body."""
    return _with_words(primary, body, rules, lambda p, b: _page_type(p, b, rules))


def tags(primary: Column, body: Column, rules: Rules = TAG_RULES, most: int = 5) -> Column:
    """Labels with a hit in the primary text or two in the body, in table order."""
    return _with_words(primary, body, rules, lambda p, b: _tags(p, b, rules, most))


def labels(primary: Column, body: Column, of_category: Rules = CATEGORY_RULES, of_type: Rules = TYPE_RULES, of_tags: Rules = TAG_RULES, of_genre: Rules = GENRE_RULES) -> Column:
    """struct(category, type, tags, genre): what category(), page_type(), tags() and first_label() find, with the texts looked up once."""

    def made(texts: list[tuple[Column, Column]]) -> Column:
        c, k, t, g = texts
        return F.struct(_category(*c, of_category).alias("category"), _page_type(*k, of_type).alias("type"), _tags(*t, of_tags).alias("tags"), _first(g[0], of_genre).alias("genre"))

    return _with_tables(primary, body, [of_category, of_type, of_tags, of_genre], made)


def scored_tags(primary: Column, body: Column, rules: Rules = TAG_RULES, exclude: tuple[str, ...] = (), least: int = 3, most: int = 4) -> Column:
    """Labels by 5 points for the primary text, else 3, 2 or 1 for five, three or one hits in the body; best first."""

    def score(r: Column) -> Column:
        points = F.when(r["hit"], 5).when(r["n"] >= 5, 3).when(r["n"] >= 3, 2).when(r["n"] >= 1, 1).otherwise(0)
        return F.struct((-points).alias("s"), r["place"].alias("place"), r["label"].alias("label"))

    kept = tuple(r for r in rules if r[1] not in exclude)
    ranked = lambda p, b: F.array_sort(F.filter(F.transform(_counted(p, b, kept), score), lambda r: r["s"] <= -least))
    return _with_words(primary, body, kept, lambda p, b: F.transform(F.slice(ranked(p, b), 1, most), lambda r: r["label"]))


def _word(name: str) -> str:
    return r"\b\Q" + name + r"\E\b"


def _best_first(rows: list[Column], least: int, most: int) -> Column:
    """Labels of structs (-score, place, label) that reach `least`, best first."""
    if not rows:
        return F.array().cast("array<string>")
    return F.transform(F.slice(F.array_sort(F.filter(F.array(*rows), lambda r: r["s"] <= -least)), 1, most), lambda r: r["label"])


def _points(p: Column, b: Column, pattern: str, primary: int, steps: tuple[tuple[int, int], ...]) -> Column:
    """Points for a hit in the primary text, else by (least hits in the body, points)."""
    def body(n: Column) -> Column:
        out = F.lit(0)
        for least, points in reversed(steps):
            out = F.when(n >= least, points).otherwise(out)
        return out

    return F.when(_hit(p, pattern), primary).otherwise(let(_times(b, pattern), body))


_STEPS = ((5, 3), (3, 2), (1, 1))


def known_tags(primary: Column, body: Column, names: list[str], most: int = 4) -> Column:
    """Of the known tags' names (lower-case in the result) those that the texts speak of, by their own words where they have
    some: 5 points for the primary text, else 3, 2 or 1 for five, three or one hits in the body; at least 3 points, best
    first, of equals the first listed. Two ambiguous tags need a word of their trade beside them, generic ones the primary text."""

    def made(p: Column, b: Column) -> Column:
        rows = []
        for i, name in enumerate(dict.fromkeys(n.lower().strip() for n in names)):
            if name in EMPTY_TAGS or len(name) < 2:
                continue
            pattern = KNOWN_TAG_WORDS.get(name, _word(name))
            points = _points(p, b, pattern, 5, _STEPS)
            if name == "sea":
                points = F.when(_hit(F.concat(p, F.lit(" "), b), r"\b(?:marketing|advertising|sem|ads|adwords)\b"), points).otherwise(0)
            elif name == "ide":
                points = F.when(_hit(p, r"\b(?:code|editor|programming|developer|development|compiler)\b"), points).otherwise(0)
            elif name in PRIMARY_TAGS:
                points = F.when(_hit(p, pattern), 5).otherwise(0)
            rows.append(F.struct((-points).alias("s"), F.lit(i).alias("place"), F.lit(name).alias("label")))
        return _best_first(rows, 3, most)

    return _with_texts(primary, body, made)


def creative_tags(primary: Column, body: Column, names: list[str] = (), most: int = 3) -> Column:
    """Tags of a creative's page: 3 points for the primary text, else 2 or 1 for two or one hits in the body, at least 2;
    three ambiguous tags need their trade's words. Then names as dynamic tags, which need 3 points. Best first, of equals
    fixed ones first."""

    def made(p: Column, b: Column) -> Column:
        both = F.concat(p, F.lit(" "), b)
        trade = _hit(p, r"\b(?:design|portfolio|studio|agency)\b")
        guards = {
            "Interactions": _hit(both, r"\b(?:interaction\s+design|interactive\s+experiences?|interactive\s+installations?|creative\s+technolog(?:y|ist))\b") | (_hit(p, r"\b(?:interactive|interaction)\b") & _hit(p, r"\b(?:design|creative|art|portfolio|studio|agency)\b")),
            "Contents": ~_hit(both, r"\b(?:skip to content|table of contents|file contents?|read the content)\b") | _hit(both, r"\b(?:content creation|content strategy|editorial|media|copy)\b"),
            "UI/UX": _hit(both, r"\b(?:ui/ux|ux/ui|ui\s+designer|ux\s+designer|product\s+design|user\s+experience)\b") | (_hit(p, r"\b(?:ui|ux)\b") & trade),
        }
        fixed = {label: _points(p, b, x, 3, ((2, 2), (1, 1))) for x, label in CREATIVE_TAGS}
        for label, guard in guards.items():
            fixed[label] = F.when(guard, fixed[label]).otherwise(0)
        fixed = {label: F.when(points >= 2, points).otherwise(0) for label, points in fixed.items()}
        for name in names:
            if (len(name) >= 3 or name.upper() in SHORT_DYNAMIC) and name.lower().strip() not in EMPTY_DYNAMIC:
                points = _points(p, b, _word(name.lower()), 3, _STEPS)
                points = F.when(points >= 3, points).otherwise(0)
                fixed[name] = F.greatest(fixed[name], points) if name in fixed else points
        rows = [F.struct((-points).alias("s"), F.lit(i).alias("place"), F.lit(label).alias("label")) for i, (label, points) in enumerate(fixed.items())]
        return _best_first(rows, 2, most)

    return _with_texts(primary, body, made)


def first_label(primary: Column, rules: Rules = GENRE_RULES) -> Column:
    """Label of the first rule that hits the primary text; null for none."""
    return let(_low(primary), lambda p: let(_looked_up(p, _patterns(rules)), lambda x: _first(x, rules)))


def roles(primary: Column, body: Column, rules: Rules = CATEGORY_RULES, least: float = 2.0, most: int = 2, default: str = "Technology") -> Column:
    """Up to two labels: 3 for the primary text, else 1 for two hits in the body; below `least` none, then the default."""

    def score(r: Column) -> Column:
        return F.struct(F.when(r["hit"], 3.0).when(r["n"] >= 2, 1.0).otherwise(0.0).alias("score"), (-r["place"]).alias("place"), r["label"].alias("label"))

    ranked = lambda p, b: F.reverse(F.array_sort(F.filter(F.transform(_counted(p, b, rules), score), lambda r: r["score"] >= least)))
    kept = _with_words(primary, body, rules, lambda p, b: F.transform(F.slice(ranked(p, b), 1, most), lambda r: r["label"]))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit(default))))


def types_cascade(primary: Column, body: Column, rules: Rules = TYPE_RULES, default: str = "Utils") -> Column:
    """First rule that hits the primary text, else the first that hits the body, else the default."""
    return F.coalesce(first_label(primary, rules), first_label(body, rules), F.lit(default))


def first_match(text: Column, rules: Rules, default: str) -> Column:
    """Label of the first matching rule, else the default."""
    return F.coalesce(first_label(text, rules), F.lit(default))


def features(title: Column, description: Column, body: Column, url: Column) -> Column:
    """struct(primary, body, semantic): title, description and URL words; the body's first 2500 characters; all of it."""
    t, d, b = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, description, body))
    hint = F.translate(F.concat_ws(" ", F.regexp_extract(url, "://([^/?#]*)", 1), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)), "/-_", "   ")
    preview = F.left(b, F.lit(2500))
    whole = F.concat(F.lit("Title: "), t, F.lit("\nDescription: "), d, F.lit("\nURL: "), F.coalesce(url, F.lit("")), F.lit("\n\n"), preview)
    return F.struct(F.trim(F.concat_ws(" ", t, d, F.coalesce(hint, F.lit("")))).alias("primary"), preview.alias("body"), F.trim(whole).alias("semantic"))


def half_even(x: Column, digits: int = 2) -> Column:
    """A double rounded as its exact value says, of two equally near decimals the even one (as Python's round does; F.round goes by
    the shortest decimal text and away from zero). Exact for up to `digits` 15 and values below 2 ** 53 / 10 ** digits."""
    scale = 10.0**digits
    # product and its error, exactly: Dekker's splitting of the factor into halves
    product, factor = x * scale, 134217729.0
    big = x * factor
    high = big - (big - x)
    low = x - high
    scale_big = scale * factor
    scale_high = scale_big - (scale_big - scale)
    scale_low = scale - scale_high
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    floor = F.floor(product).cast("double")
    rest = product - floor  # exact
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(floor, F.lit(2.0)) == 1.0))))
    # an error below 0 may put a whole product under its floor
    nearest = F.when(up, floor + 1.0).otherwise(floor)
    return F.when(F.isnan(x) | (F.abs(product) >= 2.0**52) | x.isNull(), x).otherwise(nearest / scale)


# Fixed values in arbitrate(): its labels, least scores and similarities.
def arbitrate(cat: Column, cat_score: Column, near_cat: Column, near_sim: Column, kind: Column, kind_score: Column, near_kind: Column, near_kind_sim: Column) -> Column:
    """struct(category, type, source, confidence) from the rules' and the nearest vectors' answers."""
    score, sim = F.coalesce(cat_score, F.lit(0.0)), F.coalesce(near_sim, F.lit(0.0))
    agree = F.coalesce(F.lower(cat) == F.lower(near_cat), F.lit(False))
    strong = cat.isNotNull() & (score >= 3)
    near = near_cat.isNotNull() & (cat.isNull() | (sim >= 0.45))
    source = F.when(agree, "consensus").when(strong, "jev").when(near, "embedding").when(cat.isNotNull(), "jev").otherwise("dual_hybrid")
    chosen = F.when(agree | strong, cat).when(near, near_cat).when(cat.isNotNull(), cat).otherwise("Technology")
    confidence = F.when(agree | strong, 1.0).when(near, half_even(sim)).when(cat.isNotNull(), half_even(F.least(F.lit(1.0), score / 3))).otherwise(0.5)
    kscore, ksim = F.coalesce(kind_score, F.lit(0.0)), F.coalesce(near_kind_sim, F.lit(0.0))
    same = F.coalesce(F.lower(kind) == F.lower(near_kind), F.lit(False))
    own = same | (kind.isNotNull() & (kscore >= 3))
    chosen_kind = F.when(own, kind).when(near_kind.isNotNull() & (ksim >= 0.40), near_kind).otherwise(F.coalesce(kind, near_kind, F.lit("Utils")))
    return F.struct(chosen.alias("category"), chosen_kind.alias("type"), source.alias("source"), confidence.alias("confidence"))


def union_labels(first: Column, second: Column, most: int) -> Column:
    """Labels of both lists in order, letters' case aside each once, at most `most`."""
    both = F.concat(first, second)
    kept = F.filter(both, lambda x, i: F.array_position(F.transform(both, F.lower), F.lower(x)) == i + 1)
    return F.slice(kept, 1, most)
