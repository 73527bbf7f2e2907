"""Colleague relationships and career statistics from employment intervals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.text import any_of


#: Days of a bucket in which intervals of one company are joined.
BUCKET_DAYS = 365


def overlaps(stints: DataFrame, as_of: date, least_months: float = 1.0, of: list | None = None) -> DataFrame:
    """(person1, person2, company, overlap_start, overlap_end, months, years_ago): pairs at one company at one time.

    An open interval ends at `as_of`. Pairs come once, the smaller id first; overlaps below `least_months` or of no
    length are left out. Rows without company or start are no employment. `of` asks for the pairs of some people only,
    before any pair is made. Intervals are joined by company and bucket of time, in the first bucket both reach, so that
    a company of very many people is no single key.
    """
    day = lambda c: F.datediff(c, F.lit(date(1900, 1, 1)))
    held = stints.select("person_id", "company", "start_date", F.coalesce("end_date", F.lit(as_of)).alias("end_date")).where("company is not null and end_date > start_date")
    first, last = F.floor(day(F.col("start_date")) / BUCKET_DAYS), F.floor(day(F.col("end_date")) / BUCKET_DAYS)
    held = held.select("*", F.explode(F.sequence(first, last)).alias("bucket"))
    a = held.select(F.col("person_id").alias("person1"), "company", "bucket", F.col("start_date").alias("s1"), F.col("end_date").alias("e1"))
    b = held.select(F.col("person_id").alias("person2"), "company", "bucket", F.col("start_date").alias("s2"), F.col("end_date").alias("e2"))
    near = (F.col("s1") <= F.col("e2")) & (F.col("e1") >= F.col("s2")) & (F.col("bucket") == F.floor(day(F.greatest("s1", "s2")) / BUCKET_DAYS))
    if of is None:
        met = a.join(b, ["company", "bucket"]).where(near & (F.col("person1") < F.col("person2")))
    else:  # the asked ones on one side, all others on the other
        one = a.where(F.col("person1").isin(of)).join(b, ["company", "bucket"]).where(near & (F.col("person1") != F.col("person2")) & (~F.col("person2").isin(of) | (F.col("person1") < F.col("person2"))))
        swap = F.col("person1") > F.col("person2")
        met = one.select("company", *(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("person1", "person2"), ("person2", "person1"), ("s1", "s2"), ("s2", "s1"), ("e1", "e2"), ("e2", "e1"))))
    met = met.select("person1", "person2", "company", F.greatest("s1", "s2").alias("overlap_start"), F.least("e1", "e2").alias("overlap_end"))
    met = met.withColumn("months", F.datediff("overlap_end", "overlap_start") / 30.44).withColumn("years_ago", F.greatest(F.lit(0.0), F.datediff(F.lit(as_of), "overlap_end") / 365.25))
    return met.where((F.col("overlap_end") > F.col("overlap_start")) & (F.col("months") >= least_months))


def strength(met: DataFrame) -> DataFrame:
    """base_score, duration_factor, recency_factor, company_factor and final_score (0 to 1) of each overlap."""
    m = F.col("months")
    duration = F.when(m < 3, 0.3).when(m < 6, 0.6).when(m >= 12, 1.2).otherwise(1.0)
    df = met.withColumn("base_score", F.least(m / 12, F.lit(1.0))).withColumn("duration_factor", duration).withColumn("recency_factor", F.exp(-F.col("years_ago") / 5.0)).withColumn("company_factor", F.when(any_of(F.lower("company"), rules.TIER1), 1.2).otherwise(1.0))
    product = F.col("base_score") * F.col("duration_factor") * F.col("recency_factor") * F.col("company_factor")
    return df.withColumn("final_score", F.greatest(F.lit(0.0), F.least(product, F.lit(1.0))))


def symmetric(edges: DataFrame) -> DataFrame:
    """(person, other, final_score, years_ago): both directions, the strongest edge of a pair over all companies."""
    best = edges.groupBy("person1", "person2").agg(F.max(F.struct("final_score", F.negative("years_ago").alias("y"))).alias("m")).select("person1", "person2", F.col("m.final_score").alias("final_score"), F.negative("m.y").alias("years_ago"))
    return best.select(F.col("person1").alias("person"), F.col("person2").alias("other"), "final_score", "years_ago").unionByName(best.select(F.col("person2").alias("person"), F.col("person1").alias("other"), "final_score", "years_ago"))


def connections(edges: DataFrame, person, least: float = 0.3) -> DataFrame:
    """Colleagues of one person with at least the given score."""
    return symmetric(edges).where((F.col("person") == person) & (F.col("final_score") >= least))


def connectors(edges: DataFrame, a, b) -> DataFrame:
    """(connector, score, years_ago): people tied to both, by the mean of both scores."""
    s = symmetric(edges)
    x = s.where(F.col("person") == a).select(F.col("other").alias("connector"), F.col("final_score").alias("sa"), F.col("years_ago").alias("ya"))
    y = s.where(F.col("person") == b).select(F.col("other").alias("connector"), F.col("final_score").alias("sb"), F.col("years_ago").alias("yb"))
    return x.join(y, "connector").select("connector", ((F.col("sa") + F.col("sb")) / 2).alias("score"), ((F.col("ya") + F.col("yb")) / 2).alias("years_ago"))


def next_steps(stints: DataFrame) -> DataFrame:
    """(person_id, position, company, title, next_company, next_title): each stint that has ended, and the one after it.

    Stints are numbered by start, then company; the filter on the end comes after the numbering.
    """
    order = Window.partitionBy("person_id").orderBy("start_date", "company")
    df = stints.where("start_date is not null").select("person_id", F.row_number().over(order).alias("position"), "company", "title", "end_date", F.lead("company").over(order).alias("next_company"), F.lead("title").over(order).alias("next_title"))
    return df.where("end_date is not null and next_company is not null").drop("end_date")


def transitions(steps: DataFrame, source: str, target: str) -> DataFrame:
    """(from_state, to_state, n, p): counts of steps and their share of all steps from the state."""
    n = steps.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("from_state"), F.col(target).alias("to_state")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))
