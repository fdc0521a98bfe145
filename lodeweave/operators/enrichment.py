"""Record enrichment: names, kinds of creators, fields, write-if-empty payloads, dead pages, redirects, batch prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import urls
from lodeweave.functions.text import let
from lodeweave.operators.rules import Rules, _counted, _with_words, words_of

# Words of organisations and of single people.
ORG_WORDS = ("studio", "agency", "group", "collective", "lab", "factory", "bureau", "atelier", "partners", "associates", "consulenza", "agenzia", "società")
SOLO_WORDS = ("designer", "photographer", "developer", "freelance", "personal", "portfolio", "artist", "illustrator", "consultant", "coder", "consulente")
# Products whose names hold "studio".
STUDIO_PRODUCTS = r"(?i)\b(?:google\s+ai\s+studio|visual\s+studio(?:\s+code)?|android\s+studio|obs\s+studio|roblox\s+studio|apple\s+studio|sound\s+studio|game\s+studio|fl\s+studio)\b"
# Field rules in order.
FIELD_RULES: Rules = (
    (r"\b(?:design|progettazione)\b", "Design"), (r"\bbranding\b", "Branding"), (r"\b(?:agency|agenzia)\b", "Agency"), (r"\bweb\b", "Web"), (r"\bdigital\b", "Digital"), (r"\b(?:photography|fotografia)\b", "Photography"),
    (r"\b(?:illustration|illustrazione)\b", "Illustration"), (r"\b(?:typography|tipografia)\b", "Typography"), (r"\b(?:ui/ux|ux/ui|ui\s+design|ux\s+design)\b", "UI/UX"), (r"\bfrontend\b", "Frontend"),
    (r"\b(?:development|sviluppo)\b", "Development"), (r"\b(?:creative|creativo)\b", "Creative"), (r"\bvideo\b", "Video"), (r"\b(?:fashion|moda)\b", "Fashion"), (r"\b(?:print|stampa)\b", "Print"),
    (r"\b(?:ai|intelligenza artificiale|artificial intelligence)\b", "AI"), (r"\bstudio\b", "Studio"), (r"\b(?:marketing|promozione)\b", "Marketing"), (r"\bcopywriter\b", "Copywriter"), (r"\b(?:3d|three.?d)\b", "3D"),
    (r"\b(?:architecture|architettura)\b", "Architecture"), (r"\b(?:product|prodotto)\b", "Product"), (r"\bbackend\b", "Backend"), (r"\b(?:hotellerie|hotel|alberghiera|hospitality)\b", "Hotellerie"),
    (r"\b(?:information|informazione)\b", "Information"), (r"\b(?:data|dati)\b", "Data"),
)
# Families of addresses in order of precedence, and content types that stand for a family.
URL_FAMILIES = (
    (r"\b(jeans|denim|occhiali|sunglasses|eyewear|trousers|pants|chino|chinos|apparel|clothing|shoes|sneakers|dress|skirt|jacket|coat|sweater|velvet|gabardine|cotton|pleats|accessories|boutique|cucinelli|prada|aspesi|ikea|usm|haller|fur|leather|scarf|hat|bag|bags)\b", "street"),
    (r"\b(hotel\w*|resort\w*|suites?|camera|camere|allogg\w+|relais|spa|wellness|travel|traveller|booking|bed and breakfast|b&b)\b", "traveller"),
    (r"\b(tech|develop\w*|code|coding|api|apis|software|saas|python|javascript|typescript|app|application|plugin|tools?|github|dev)\b", "technology"),
    (r"\b(design|designer|branding|graphics?|typography|identity|visuals?|portfolio|studio|agency|pentagram)\b", "design"),
    (r"\b(article|articles|blog|posts?|magazine|journal|editorial|writing|news|notizie)\b", "writing"),
)
FAMILY_TYPES = {
    "street": ((r"\b(occhiali|sunglasses|eyewear|accessories|scarf|belt|wallet)\b", "accessories"), (r"\b(jeans|denim|trousers|pants|chino|apparel|clothing|cotton|velvet|pleats|jacket|coat|dress|skirt)\b", "apparel"), (r"\b(shop|store|boutique)\b", "shop")),
    "traveller": (("", "hotel"),),
    "technology": ((r"\b(plugin|extension)\b", "plugin"), (r"\b(tools?|utils?)\b", "tools"), ("", "application")),
    "design": (("", "solo"),),
    "writing": (("", "magazine"),),
}
CONTENT_FAMILIES = {"products": ("street", "shop"), "hotels": ("traveller", "hotel"), "rooms": ("traveller", "hotel"), "dining": ("traveller", "hotel"), "experiences": ("traveller", "hotel"), "blog": ("writing", "magazine"), "news": ("writing", "magazine")}
# Separators of names in order, generic names, small words, endings of bare domains.
NAME_SEPARATORS = (" | ", " – ", " — ", " - ", " : ", ": ", " · ", " • ", " // ")
GENERIC_NAMES = ("portfolio", "home", "website", "welcome", "official", "site", "page", "index")
SMALL_WORDS = "a an the and or but in on at to for of with by from as is was are were y e di da de del la le il et und en".split()
DOMAIN = r"[a-zA-Z0-9][-a-zA-Z0-9]*\.(?:org|com|net|io|ai|app|dev|co|edu|gov|it|de|fr|uk|cc|me|fm|so|is|tv)"


def _points(word: str, primary: Column, body: Column) -> Column:
    """4 for a word among those of the primary text, else 2 for two or 1 for one in the body."""
    n = F.size(F.filter(body, lambda w: w == word))
    return F.when(F.array_contains(primary, F.lit(word)), 4).when(n >= 2, 2).when(n == 1, 1).otherwise(0)


def org_or_solo(primary: Column, body: Column, linkedin: Column) -> Column:
    """Org, Solo or null: words weigh 4 in the primary text, else 2 or 1 in the body; a personal LinkedIn page and a
    person's name with 's weigh 3 each for Solo and decide ties."""
    raw = F.coalesce(primary, F.lit(""))
    # products are looked for only where the word stands that all of them hold
    less = lambda c: let(c, lambda t: let(F.lower(t), lambda low: F.when(F.contains(low, F.lit("studio")), F.lower(F.regexp_replace(t, STUDIO_PRODUCTS, " "))).otherwise(low)))
    p, b = (less(F.coalesce(c, F.lit(""))) for c in (primary, body))
    person = F.coalesce(linkedin.rlike(r"(?i)linkedin\.com/in/[a-z0-9_-]+"), F.lit(False))
    named = raw.rlike(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+'s\b")
    own = lambda t: F.filter(words_of(t), lambda w: w.isin(*ORG_WORDS, *SOLO_WORDS))
    texts = F.struct(own(p).alias("p"), own(b).alias("b"), F.when(person, 3).otherwise(0).alias("x"), F.when(named, 3).otherwise(0).alias("y"))

    def sums(t: Column) -> Column:
        org, solo = (sum((_points(w, t["p"], t["b"]) for w in words), F.lit(0)) for words in (ORG_WORDS, SOLO_WORDS))
        return F.struct(org.alias("org"), (solo + t["x"] + t["y"]).alias("solo"), (t["x"] + t["y"] > 0).alias("person"))

    kind = lambda s: F.when((s["org"] == 0) & (s["solo"] == 0), None).when(s["solo"] > s["org"], "Solo").when(s["org"] > s["solo"], "Org").when(s["person"], "Solo").otherwise("Org")
    return let(let(texts, sums), kind)


def fields(primary: Column, body: Column, rules: Rules = FIELD_RULES, least: int = 2, most: int = 4) -> Column:
    """Labels by 3 points for the primary text, else 2 for two hits in the body, else 1; best first, of equals in order."""

    def score(r: Column) -> Column:
        points = F.when(r["hit"], 3).when(r["n"] >= 2, 2).when(r["n"] == 1, 1).otherwise(0)
        return F.struct((-points).alias("s"), r["place"].alias("i"), r["label"].alias("label"))

    ranked = lambda p, b: F.array_sort(F.filter(F.transform(_counted(p, b, rules), score), lambda r: r["s"] <= -least))
    return _with_words(primary, body, rules, lambda p, b: F.transform(F.slice(ranked(p, b), 1, most), lambda r: r["label"]))


def predict(url: Column, text: Column) -> Column:
    """struct(category, type) of an address: families of words, else its content type; null where nothing matches."""
    whole = F.lower(F.concat_ws(" ", url, text))
    kind = urls.content_type(url)
    cat, typ = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for pattern, family in URL_FAMILIES:
        hit = whole.rlike(pattern)
        cat = cat.when(hit, family)
        own = F.coalesce(*[F.when(whole.rlike(p) if p else F.lit(True), t) for p, t in FAMILY_TYPES[family]])
        typ = typ.when(hit, own)
    for name, (family, t) in CONTENT_FAMILIES.items():
        cat, typ = cat.when(kind == name, family), typ.when(kind == name, t)
    return F.struct(cat.alias("category"), typ.alias("type"))


def _parsed(raw: Column, places: Sequence[str] = ()) -> Column:
    """struct(name, location, about) of a page's name: parted after a leading domain, else at the first separator in
    order of preference; a place, a generic word or a domain tells which side is the name, else the shorter side if it
    looks like a proper name, else the left."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    lead = "(?i)^(" + DOMAIN + r")\s+(.+)$"
    left, right = F.when(t.rlike(lead), F.regexp_extract(t, lead, 1)), F.when(t.rlike(lead), F.regexp_extract(t, lead, 2))
    for sep in NAME_SEPARATORS:
        here = t.contains(sep)
        left, right = left.when(here, F.trim(F.substring_index(t, sep, 1))), right.when(here, F.trim(F.substring(t, F.instr(t, sep) + len(sep), F.length(t))))
    known = [p.lower() for p in places]
    place = lambda s: F.lower(F.trim(F.split_part(s, F.lit(","), F.lit(1)))).isin(*known) if known else F.lit(False)
    generic = lambda s: F.lower(s).isin(*GENERIC_NAMES)
    site = lambda s: s.rlike(r"(?i)\b" + DOMAIN + r"\b")

    def proper(s: Column) -> Column:
        words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
        real = F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS))
        capital = F.filter(real, lambda w: F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))
        return (F.size(words).between(1, 4)) & (F.size(real) > 0) & ~F.exists(words, lambda w: F.lower(w).isin(*GENERIC_NAMES)) & (F.size(capital) * 2 > F.size(real))

    short_right = F.length(right) <= F.length(left)
    use_right = F.when(place(right), False).when(place(left), True).when(generic(left), True).when(generic(right), False).when(site(left) & ~site(right), False).when(site(right) & ~site(left), True).otherwise(short_right & proper(right))
    parted = left.isNotNull()
    located = place(right) | place(left)
    told = ~located & ~generic(left) & ~generic(right)
    other = F.when(use_right, left).otherwise(right)
    return F.struct(F.when(parted, F.when(use_right, right).otherwise(left)).otherwise(t).alias("name"), F.when(parted & located, other).alias("location"), F.when(parted & told, other).alias("about"))


def parse_name(raw: Column, places: Sequence[str] = ()) -> Column:
    """_parsed() with its input worked out once."""
    return let(raw, lambda t: _parsed(t, places))


def fill(df: DataFrame, scraped: DataFrame, key: str, columns: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """df with each empty column filled from `scraped`; columns in `always` are overwritten where something was found."""
    s = scraped.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in (*columns, *always)])
    j = df.join(s, F.col(key) == F.col("__k"), "left")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    made = {c: F.coalesce(some(F.col(c)), F.col(f"__{c}")) for c in columns} | {c: F.coalesce(some(F.col(f"__{c}")), F.col(c)) for c in always}
    return j.withColumns(made).select(*df.columns)


def page_state(status: Column, parked: Column, blank: Column) -> Column:
    """struct(archive, tag): dead, parked and blank pages go to the archive; closed unless simply not found, else by code."""
    gone = (status >= 400) | parked | blank
    return F.struct(F.coalesce(gone, F.lit(False)).alias("archive"), F.when(status.isin(403, 503), status.cast("string")).when(gone & (status != 404), "Closed").alias("tag"))


def redirected(old: Column, new: Column, notes: Column) -> Column:
    """struct(url, notes): a new address that differs by more than its spelling; the old one is kept in the notes."""
    moved = new.isNotNull() & (urls.normalize(old) != urls.normalize(new))
    return F.struct(F.when(moved, new).otherwise(old).alias("url"), F.when(moved, F.concat_ws("\n", F.nullif(notes, F.lit("")), old)).otherwise(notes).alias("notes"))


def only_filled(filled: str, others: Sequence[str]) -> Column:
    """Whether one column is filled and all others are null or empty."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    out = ~empty(filled)
    for c in others:
        out = out & empty(c)
    return out


def requeue(pages: DataFrame, status: str, again: Column) -> DataFrame:
    """pages with status pending where it is failed or `again` holds."""
    return pages.withColumn(status, F.when((F.col(status) == "failed") | F.coalesce(again, F.lit(False)), "pending").otherwise(F.col(status)))


def start_jobs(jobs: DataFrame, wanted: DataFrame, url: str = "url") -> DataFrame:
    """wanted(url) -> url, target, job_id, outcome: already_running, restored or started, by normalised address."""
    j = jobs.select(urls.target(F.col(url)).alias("target"), "job_id", "status").groupBy("target").agg(F.min_by("job_id", F.struct((F.col("status") != "running").alias("r"), "job_id")).alias("job_id"), F.max((F.col("status") == "running").cast("int")).alias("running"))
    w = wanted.select(F.col(url), urls.target(F.col(url)).alias("target"))
    return w.join(j, "target", "left").select(url, "target", "job_id", F.when(F.col("running") == 1, "already_running").when(F.col("job_id").isNotNull(), "restored").otherwise("started").alias("outcome"))


def route(mode: Column, workspace: Column, full_site: Column) -> Column:
    """Workspace of a job: whole-site jobs go to their own."""
    return F.when(mode == "sitemap", full_site).otherwise(workspace)
