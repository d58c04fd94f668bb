"""Column functions on names, domains, titles, phones and other short texts. None of them runs Python on executors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: legal suffix words
LEGAL_SUFFIX = r"\b(llc|inc|corp|corporation|co|ltd|pllc|pc|dds|dmd|group)\b"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_domain(url: Column) -> Column:
    """Host of a URL or domain: lower case, without scheme, path, query, fragment, port and leading ``www.``; null gives ''."""
    host = F.regexp_replace(F.lower(F.trim(_text(url))), "^https?://", "")
    host = F.regexp_extract(host, "^([^/?#]*)", 1)
    host = F.regexp_replace(host, ":.*$", "")
    return F.trim(F.regexp_replace(host, r"^www\.", ""))


def slugify(text: Column) -> Column:
    """Lower case with every run of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_company_name(name: Column) -> Column:
    """Slug of a company name without legal suffix words; null gives ''."""
    return slugify(F.regexp_replace(F.lower(F.trim(_text(name))), LEGAL_SUFFIX, ""))


def name_city_key(name: Column, city: Column) -> Column:
    """Key for de-duplication: the name's slug, with the city's if there is one."""
    slug, place = normalize_company_name(name), slugify(city)
    return F.when(place == "", slug).otherwise(F.concat_ws(":", slug, place))


def synthetic_domain(name: Column, city: Column) -> Column:
    """Stand-in domain of a business without a website."""
    return F.concat(F.concat_ws("-", slugify(name), F.when(slugify(city) != "", slugify(city))), F.lit(".local"))


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """First of the keywords, in their order, that a text contains, else null."""
    return F.get(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k)), F.lit(0))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether a text contains any of the keywords; a longer list is one pattern, which keeps the generated code small."""
    if len(keywords) <= 4:
        return reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in keywords))
    return text.rlike("|".join(map(re.escape, keywords)))


def parse_employee_bounds(text: Column) -> Column:
    """Struct (lo, hi) of ``a-b``, ``a to b``, ``a+`` (hi twice a) or ``a``; null if there is no number."""
    clean = F.replace(F.lower(_text(text)), F.lit(","), F.lit(""))
    number = lambda pattern, group: F.nullif(F.regexp_extract(clean, pattern, group), F.lit("")).cast("long")
    span, plus, one = r"([0-9]+)\s*(?:-|to)\s*([0-9]+)", r"([0-9]+)\s*\+", r"([0-9]+)"
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    return (
        F.when(number(span, 1).isNotNull(), pair(number(span, 1), number(span, 2)))
        .when(number(plus, 1).isNotNull(), pair(number(plus, 1), number(plus, 1) * 2))
        .when(number(one, 1).isNotNull(), pair(number(one, 1), number(one, 1)))
    )


def normalize_confidence(raw: Column) -> Column:
    """Confidence between 0 and 1 from 0..1 or 0..100; null or junk counts as 1."""
    value = raw.cast("string").try_cast("double")
    return F.when(value.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(value > 1, value / 100).otherwise(value))))


def normalize_phone(raw: Column) -> Column:
    """Struct (e164, national, dashed, digits, dotted, compact, area_code) of a ten-digit North American number, null for anything else."""
    digits = F.regexp_replace(_text(raw), "[^0-9]", "")
    ten = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when(F.length(digits) == 10, digits)
    a, b, c = F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)
    return F.when(
        ten.isNotNull(),
        F.struct(F.concat(F.lit("+1"), ten).alias("e164"), F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c).alias("national"), F.concat_ws("-", a, b, c).alias("dashed"), ten.alias("digits"), F.concat_ws(".", a, b, c).alias("dotted"), F.concat_ws(" ", a, b, c).alias("compact"), a.alias("area_code")),
    )


def split_job_title(raw: Column) -> Column:
    """Struct (company, role) of ``A: B``, ``B at A``, ``A is hiring B`` or ``A - B``, where the shorter side is the company."""
    t = F.trim(_text(raw))
    part = lambda mark, i: F.trim(F.get(F.split(t, mark, 2), F.lit(i)))
    pair = lambda company, role: F.struct(company.alias("company"), role.alias("role"))
    a, b = part(" - ", 0), part(" - ", 1)
    return (
        F.when(F.contains(t, F.lit(": ")), pair(part(": ", 0), part(": ", 1)))
        .when(F.contains(t, F.lit(" at ")), pair(part(" at ", 1), part(" at ", 0)))
        .when(F.contains(t, F.lit(" is hiring ")), pair(part(" is hiring ", 0), part(" is hiring ", 1)))
        .when(F.contains(t, F.lit(" - ")), pair(F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)))
        .otherwise(pair(F.lit(""), t))
    )


def extract_budget(text: Column, default: str = "Not specified") -> Column:
    """First amount in dollars that a text names."""
    found = F.regexp_extract(_text(text), r"(\$[0-9][0-9,]*(?:\.[0-9]+)?[kK]?)", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def redirect_target(url: Column, parameter: str = "url") -> Column:
    """Decoded target that a redirect URL carries in a query parameter, else null."""
    found = F.regexp_extract(_text(url), rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(found != "", F.url_decode(found))


def extract_emails(text: Column) -> Column:
    """All distinct e-mail addresses of a text, in order, lower case, without asset file names."""
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit(r"([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})"), F.lit(1))
    clean = F.transform(found, lambda e: F.regexp_replace(e, r"^[.]+|[.]+$", ""))
    return F.array_distinct(F.filter(clean, lambda e: ~e.rlike(r"\.(png|jpg|jpeg|gif|svg|webp|css|js)$")))


def clean_generated_text(raw: Column) -> Column:
    """Struct (subject, body) of generated text: think-blocks and fences go, the subject line is split off."""
    t = F.regexp_replace(F.regexp_replace(_text(raw), r"(?s)<think>.*?</think>", ""), "```[a-z]*", "")
    subject = F.trim(F.replace(F.regexp_extract(t, r"(?i)subject:\s*([^\n]*)", 1), F.lit("**"), F.lit("")))
    body = F.trim(F.regexp_replace(t, r"(?i)[* ]*subject:[^\n]*\n?", ""))
    return F.struct(subject.alias("subject"), body.alias("body"))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, white space as single spaces."""
    t = F.regexp_replace(_text(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))
