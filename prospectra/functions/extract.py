"""Column functions that draw fields out of free text, JSON and notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, normalize_domain

# fixed values: names that tell nothing, hosts that are no employer's
VAGUE_NAMES = ["confidential", "stealth", "various", "multiple", "unknown", "developer", "engineer", "specialist", "manager", "director", "consultant", "coordinator", "weworkremotely", "we work remotely"]
BOARD_HOSTS = [
    "larajobs", "himalayas", "workingnomads", "arc.dev", "jsremotely", "jobspresso", "dribbble", "greenhouse", "lever.co", "workable", "ashbyhq", "remotive", "arbeitnow", "jobicy", "remoteok",
    "linkedin", "twitter", "github", "weworkremotely",
]
TITLES = ["Founder", "Co-Founder", "CEO", "Owner", "President", "Managing Director", "CTO", "VP of Engineering", "Head of E-Commerce"]
# fixed values: kinds of growth signals by their patterns
GROWTH = {
    "client_scale": r"(?i)\b([0-9]+k?|[0-9]+\+?)\s*(clients|customers|projects delivered|case studies)\b",
    "company_age": r"(?i)\b(founded in\s*(?:19|20)[0-9]{2}|est\.?\s*(?:19|20)[0-9]{2}|established\s*(?:19|20)[0-9]{2})\b",
    "funding_round": r"(?i)\b(series [a-d]|seed round|venture backed|funded by|raised \$[0-9]+[mk]?)\b",
    "industry_award": r"(?i)\b(inc\.?\s*5000|clutch top|fastest growing|award winning)\b",
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern finds first, null for nothing."""
    return F.nullif(F.regexp_extract(_text(text), pattern, group), F.lit(""))


def sanitize_search_term(term: Column) -> Column:
    """A term for search engines: ``&`` as a word, no other signs but commas and hyphens, single spaces."""
    plain = F.regexp_replace(F.replace(F.replace(_text(term), F.lit("&"), F.lit("and")), F.lit("+"), F.lit(" ")), r"[^A-Za-z0-9_\s,\-]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def infer_employer_domain(company: Column, description: Column) -> Column:
    """Domain of an employer: the first host in the text that is no job board, else the name as a ``.com``; null for vague or long names."""
    name = F.lower(F.trim(_text(company)))
    n_words = F.size(F.split(name, r"\s+"))
    hosts = F.regexp_extract_all(_text(description), F.lit(r"https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z]{2,})"), F.lit(1))
    own = F.get(F.filter(hosts, lambda h: ~contains_any(F.lower(h), BOARD_HOSTS)), F.lit(0))
    slug = F.regexp_replace(name, "[^a-z0-9]", "")
    guess = F.when(F.length(slug).between(3, 25) & (n_words <= 3), F.concat(slug, F.lit(".com")))
    return F.when((name != "") & (n_words <= 4) & ~contains_any(name, VAGUE_NAMES), F.coalesce(F.nullif(normalize_domain(own), F.lit("")), guess))


def extract_client_spend(text: Column) -> Column:
    return F.coalesce(_found(text, r"(?i)(\$[0-9,]+[km]?\+?\s*spent)"), F.lit("$0 spent / New Client"))


def infer_state(domain: Column, states: list[str]) -> Column:
    """State whose code the first label of a domain ends with, in capitals."""
    label = F.regexp_extract(F.lower(_text(domain)), r"^([^.]*)", 1)
    code = F.substring(label, -2, 2)
    return F.when((F.length(label) > 2) & code.isin(states), F.upper(code))


def parse_stack(raw: Column) -> Column:
    """Stack as an array from JSON text, a comma list or a single name; empty for null and blank."""
    text = F.trim(_text(raw))
    listed = F.from_json(text, "array<string>")
    plain = F.transform(F.split(text, r"\s*,\s*"), lambda x: F.trim(x))
    return F.array_compact(F.when(text == "", F.array().cast("array<string>")).when(text.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(plain))


def parse_json_detail(raw: Column) -> Column:
    """A JSON object as a map of texts; empty for anything else."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(F.trim(_text(raw)).startswith("{"), F.from_json(raw, "map<string,string>")), empty)


def extract_name_title(snippet: Column) -> Column:
    """Struct (full_name, first_name, last_name, title) of an executive named in a text; null for none."""
    # fixed values: the pattern of an executive's name and title
    name = _found(snippet, r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\s*[-–—:|]\s*(?:Co-Founder|Founder|CEO|Owner|President|Managing Director|CTO|Principal)")
    parts = F.split(F.trim(name), r"\s+")
    title = F.coalesce(*(F.when(snippet.rlike(rf"(?i)\b{t}\b"), F.lit(t)) for t in TITLES), F.lit("Founder / Executive"))
    return F.when(name.isNotNull(), F.struct(F.trim(name).alias("full_name"), F.get(parts, F.lit(0)).alias("first_name"), F.get(parts, F.size(parts) - 1).alias("last_name"), title.alias("title")))


def bounce_recipient(report: Column, body: Column, to: Column, own: Column) -> Column:
    """Address that bounced: of the delivery report, else of the body, else of the To header; never one's own."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"^[<>.,;]+|[<>.,;]+$", "")
    other = lambda c: F.when(bare(c) != F.lower(_text(own)), bare(c))
    # fixed values: patterns of delivery notices
    named = _found(report, r"(?i)(?:Final-Recipient|Original-Recipient):\s*(?:rfc822;?)?\s*(\S+@\S+)")
    patterns = [r"(?i)(?:delivery to|message to|sent to|recipient)[:\s]*<?(\S+@\S+\.[A-Za-z0-9_]+)>?", r"<(\S+@\S+\.[A-Za-z0-9_]+)>", r"(?i)(\S+@\S+\.[A-Za-z0-9_]+)\s+(?:failed|rejected|undeliverable)"]
    header = F.coalesce(_found(to, r"<([^<>\s]+@[^<>\s]+)>"), _found(to, r"([^<>\s]+@[^<>\s]+)"))
    return F.coalesce(F.regexp_replace(F.lower(named), "^[<>]+|[<>]+$", ""), *(other(_found(body, p)) for p in patterns), other(header))


def dsn_code(report: Column, body: Column) -> Column:
    """Status code of a delivery report, else the first one in the body."""
    return F.coalesce(_found(report, r"(?i)Status:\s*([0-9]\.[0-9]+\.[0-9]+)"), _found(body, r"([0-9]\.[0-9]+\.[0-9]+)"))


def growth_samples(text: Column) -> dict[str, Column]:
    """First passage of each kind of growth signal in a text."""
    return {kind: _found(text, p, 0) for kind, p in GROWTH.items()}
