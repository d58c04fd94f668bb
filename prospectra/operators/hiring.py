"""Hiring signals of pages: boards, career links and skills, as rows with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.functions.text import visible_text

from .page_parts import sources_of

# fixed values: hosts of hiring boards by name, words of career links, patterns of skills in order, and the confidence of each kind of signal
BOARDS = {"greenhouse": r"greenhouse\.io", "lever": r"lever\.co", "workable": r"workable\.com", "breezy": r"breezy\.hr", "ashbyhq": r"ashbyhq\.com"}
CAREER_LINK = "(careers|jobs|join-us|we-are-hiring|work-with-us|openings)"
SKILLS = {
    "laravel": r"\b(laravel|php developer|backend engineer|php engineer)\b",
    "angular": r"\b(angular|angularjs|frontend engineer|frontend developer)\b",
    "react": r"\b(react|reactjs|next\.js|frontend engineer)\b",
    "wordpress": r"\b(wordpress|wp developer|theme developer|plugin developer)\b",
    "devops": r"\b(devops|aws|cloud engineer|site reliability|kubernetes|docker)\b",
    "fullstack": r"\b(full[\s-]?stack|software engineer|lead developer)\b",
}
CONFIDENCE = {"hiring_ats_detected": 0.95, "career_page_detected": 0.90, "hiring_skill_match": 0.85}
CAREER_LINKS = 3

DETAIL = "struct<ats_platforms: array<string>, career_links: array<struct<text: string, href: string>>, matched_skills: array<struct<skill: string, count: int, sample: string>>>"


def hiring_signals(pages: DataFrame) -> DataFrame:
    """Up to three rows a page, ``page_id, url, type, confidence, detail``: boards that it embeds or links, its first career links, and the skills of its text.

    A skill has the number of its matches and the first one as it stands. A page without a sign, or a null one, has no row.
    """
    sources = pages.select("page_id", "html").lateralJoin(sources_of(F.col("html").outer()))
    board = F.filter(F.array(*(F.when(F.col("source").rlike(f"(?i){p}"), F.lit(n)) for n, p in BOARDS.items())), lambda x: x.isNotNull())
    career = (F.col("kind") == "anchor") & (F.col("source").rlike(f"(?i){CAREER_LINK}") | F.col("text").rlike(f"(?i){CAREER_LINK}"))
    link = F.when(career, F.struct("position", "text", F.col("source").alias("href")))
    found = sources.groupBy("page_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(board)))).alias("ats"), F.slice(F.array_sort(F.collect_list(link)), 1, CAREER_LINKS).alias("links"))
    text = visible_text(F.col("html"))
    hits = lambda p: F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1))
    skills = F.filter(F.array(*(F.struct(F.lit(n).alias("skill"), F.size(hits(p)).alias("count"), F.get(hits(p), F.lit(0)).alias("sample")) for n, p in SKILLS.items())), lambda s: s["count"] > 0)
    rows = pages.select("page_id", "url", skills.alias("skills")).join(found, "page_id", "left")
    links = F.transform("links", lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href")))
    nothing = F.lit(None)
    details = {"hiring_ats_detected": ("ats", nothing, nothing), "career_page_detected": (nothing, links, nothing), "hiring_skill_match": (nothing, nothing, "skills")}
    held = {"hiring_ats_detected": "ats", "career_page_detected": "links", "hiring_skill_match": "skills"}
    names = ("ats_platforms", "career_links", "matched_skills")
    as_column = lambda v: F.col(v) if isinstance(v, str) else v
    signals = F.array(
        *(
            F.when(F.size(held[k]) > 0, F.struct(F.lit(k).alias("type"), F.lit(CONFIDENCE[k]).alias("confidence"), F.struct(*(as_column(v).alias(n) for v, n in zip(values, names, strict=True))).cast(DETAIL).alias("detail")))
            for k, values in details.items()
        )
    )
    return rows.select("page_id", "url", F.explode(F.array_compact(signals)).alias("s")).select("page_id", "url", "s.*")


def hiring_skills(signals: DataFrame) -> DataFrame:
    """Skills of the pages of each company, ``company_id, skill, count, sample``: the input of pain and buying rules."""
    rows = signals.where(F.col("type") == "hiring_skill_match").select("company_id", "page_id", F.explode("detail.matched_skills").alias("m"))
    return rows.groupBy("company_id", F.col("m.skill").alias("skill")).agg(F.sum("m.count").alias("count"), F.min_by("m.sample", "page_id").alias("sample"))
