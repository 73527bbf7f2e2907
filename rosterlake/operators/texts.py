"""Text templates of profiles and their aspects, and a hashed bag-of-words embedding of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Templates of a profile's text; {name} stands for a field.
TEMPLATES = {
    "full": "Name: {name} Title: {current_title} Company: {current_company} Location: {location} Education: {education} Experience: {experience} Skills: {skills}",
    "professional": "{current_title} at {current_company} Location: {location} Skills: {skills} Background: {experience}",
    "compact": "{current_title} at {current_company}, {location} Skills: {skills}",
    "career_focused": "Career: {current_title} at {current_company} Previous roles: {experience} Specializations: {skills} Education: {education} Location: {location}",
}
#: What stands for a missing field.
MISSING = {"name": "", "current_title": "Unknown Title", "current_company": "Unknown Company", "location": "Unknown Location", "education": "Education not specified", "experience": "Experience not specified", "skills": "Skills not specified"}


def _held(df: DataFrame, c: str) -> Column:
    """The trimmed text of a column; null where it is blank or `df` has no such column."""
    return F.when(F.trim(c) != "", F.trim(c)) if c in df.columns else F.lit(None).cast("string")


def profile_text(df: DataFrame, template: str = "professional") -> Column:
    """One line on a person by a template: studies, up to three of `experience` (array of structs with title and company),
    up to ten of `skill_list`. Fields that are null, blank or no columns of `df` are named as missing."""
    study = F.concat_ws(" ", _held(df, "degree"), _held(df, "major"), F.col("graduation_year").cast("string") if "graduation_year" in df.columns else F.lit(None).cast("string"))
    past = F.lit(None).cast("string")
    if "experience" in df.columns:
        jobs = F.transform(F.slice("experience", 1, 3), lambda x: F.concat(F.coalesce(x["title"], F.lit("")), F.lit(" at "), F.coalesce(x["company"], F.lit(""))))
        past = F.array_join(F.filter(jobs, lambda x: F.trim(x) != "at"), "; ")
    known = F.array_join(F.slice("skill_list", 1, 10), ", ") if "skill_list" in df.columns else F.lit(None).cast("string")
    value = {"education": study, "experience": past, "skills": known} | {c: _held(df, c) for c in ("name", "current_title", "current_company", "location")}
    parts: list[Column] = []
    for piece in TEMPLATES[template].replace("{", "\0{").replace("}", "\0").split("\0"):
        if piece.startswith("{"):
            v = value[piece[1:]]
            parts.append(F.coalesce(F.when(v != "", v), F.lit(MISSING[piece[1:]])))
        elif piece:
            parts.append(F.lit(piece))
    return F.trim(F.regexp_replace(F.concat(*parts), r"\s+", " "))


def aspect_texts(df: DataFrame, key: str = "person_id") -> DataFrame:
    """(key, aspect, text): current role, up to five of `experience`, up to fifteen of `skill_list` and education of each
    person who has them. Descriptions of jobs are cut at 200 letters, as a feature of the text."""
    after = lambda word, c: F.concat(F.lit(word), c)
    role = F.concat_ws(" ", _held(df, "current_title"), after("at ", _held(df, "current_company")), after("in ", _held(df, "location")))
    year = F.concat(F.lit("("), F.col("graduation_year").cast("string"), F.lit(")")) if "graduation_year" in df.columns else F.lit(None).cast("string")
    study = F.concat_ws(" ", _held(df, "degree"), after("in ", _held(df, "major")), after("from ", _held(df, "education_school")), year)
    past = F.lit(None).cast("string")
    if "experience" in df.columns:
        fields = [f.name for f in df.schema["experience"].dataType.elementType.fields]
        told = lambda x: F.when(F.length(x["description"]) > 200, F.concat(F.substring(x["description"], 1, 200), F.lit("..."))).otherwise(x["description"]) if "description" in fields else F.lit(None).cast("string")
        jobs = F.transform(F.slice("experience", 1, 5), lambda x: F.concat_ws(" ", x["title"], after("at ", x["company"]), told(x)))
        past = F.array_join(F.filter(jobs, lambda x: x != ""), ". ")
    skills = after("Skills and expertise: ", F.array_join(F.slice("skill_list", 1, 15), ", ")) if "skill_list" in df.columns else F.lit(None).cast("string")
    if "skill_list" in df.columns:
        skills = F.when(F.size("skill_list") > 0, skills)
    items = F.array(*(F.struct(F.lit(a).alias("aspect"), t.alias("text")) for a, t in (("current_role", role), ("experience", past), ("skills", skills), ("education", study))))
    return df.select(key, F.explode(items).alias("x")).select(key, "x.*").where("text is not null and text <> ''")


def profile_summary(df: DataFrame, matched: str = "matched") -> Column:
    """Up to three parts on a person from the texts `current_role`, `skills`, `experience` and the array of matched aspects:
    in the order matched, the current role first if it is not among them. Skills are cut at 100 letters, experience at its
    first sentence; an aspect without text gives no part."""
    role, skills, past = (F.col(c) for c in ("current_role", "skills", "experience"))
    short = F.when(F.length(skills) > 100, F.concat(F.substring(skills, 1, 100), F.lit("..."))).otherwise(skills)
    first = F.concat(F.lit("Experience: "), F.when(past.contains("."), F.split(past, r"\.")[0]).otherwise(F.substring(past, 1, 100)), F.lit("..."))
    said = F.transform(matched, lambda a: F.when(a == "current_role", F.concat(F.lit("Current: "), role)).when(a == "skills", short).when(a == "experience", first))
    lead = F.when(F.array_contains(matched, "current_role"), F.array().cast("array<string>")).otherwise(F.array(role))
    return F.array_join(F.slice(F.filter(F.concat(lead, said), lambda x: x.isNotNull()), 1, 3), " | ")


def hashed_embedding(c: Column, dim: int = 64) -> Column:
    """Counts of words by hash bucket at unit length: the default embedding where no model is at hand."""
    words = F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    # each word adds one to its bucket
    counts = F.aggregate(slots, F.array_repeat(F.lit(0.0), dim), lambda held, s: F.concat(F.slice(held, F.lit(1), s), F.array(F.element_at(held, s + 1) + 1.0), F.slice(held, s + 2, F.lit(dim))))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm))
