"""Quality report and frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.entities import title_tokens
from rosterlake.functions import normalize


def report(people: DataFrame, skills: DataFrame) -> DataFrame:
    """One row: rows, rows without company, title or year, people with skills. Blank counts as missing; one pass each."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    a = people.agg(F.count("*").alias("total"), F.count_if(blank("current_company")).alias("missing_company"), F.count_if(blank("current_title")).alias("missing_title"), F.count_if(F.col("graduation_year").isNull()).alias("missing_year"))
    b = skills.agg(F.countDistinct("person_id").alias("people_with_skills"))
    return a.crossJoin(b)


def top(people: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n): the k most frequent non-blank values, ties by value."""
    return people.where(F.trim(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def token_frequency(people: DataFrame, column: str) -> DataFrame:
    """(token, n): how many rows' titles hold each word, every occurrence counted once a row."""
    return people.where(F.trim(column) != "").select(F.explode(F.array_distinct(title_tokens(normalize.title(F.col(column))))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
