"""Views that map the order tables onto the profile model; each text runs unchanged on both SQL engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.session import table

VIEWS = {
    "stints": """SELECT CAST(o.o_custkey AS BIGINT) AS person_id, s.s_name AS company, MIN(CONCAT(LOWER(p.p_type),' ',p.p_name)) AS title, CAST(MIN(l.l_shipdate) AS DATE) AS start_date,
 CAST(MAX(l.l_shipdate) AS DATE) AS end_date, COUNT(*) AS n_items FROM orders o JOIN lineitem l ON o.o_orderkey=l.l_orderkey JOIN supplier s ON l.l_suppkey=s.s_suppkey
 JOIN part p ON l.l_partkey=p.p_partkey GROUP BY o.o_custkey, s.s_name""",
    "person_skills": """SELECT DISTINCT o.o_custkey AS person_id, LOWER(p.p_brand) AS skill FROM orders o JOIN lineitem l ON o.o_orderkey=l.l_orderkey JOIN part p ON l.l_partkey=p.p_partkey WHERE l.l_quantity >= 45""",
    "profiles": """SELECT c.c_custkey AS person_id, c.c_name AS name, j.title AS current_title, j.company AS current_company, c.c_mktsegment AS industry, CONCAT(n.n_name, ', ', r.r_name) AS location,
 r.r_name AS metro_area, y.graduation_year FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey
 LEFT JOIN (SELECT * FROM (SELECT person_id, company, title, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY end_date DESC, company) AS rn FROM stints) q WHERE rn=1) j ON j.person_id=c.c_custkey
 LEFT JOIN (SELECT o_custkey, CAST(YEAR(MIN(o_orderdate)) AS INT) AS graduation_year FROM orders GROUP BY o_custkey) y ON y.o_custkey=c.c_custkey""",
    "doc_terms": """SELECT person_id, CONCAT('industry:',LOWER(industry)) AS term FROM profiles UNION SELECT person_id, CONCAT('location:',LOWER(metro_area)) FROM profiles
 UNION SELECT person_id, CONCAT('company:',LOWER(current_company)) FROM profiles WHERE current_company IS NOT NULL UNION SELECT person_id, CONCAT('skill:',skill) FROM person_skills
 UNION SELECT person_id, CONCAT('title:',SUBSTRING(current_title,1,INSTR(current_title,' ')-1)) FROM profiles WHERE current_title IS NOT NULL""",
}
_NEEDS = {"stints": ["orders", "lineitem", "supplier", "part"], "person_skills": ["orders", "lineitem", "part"], "profiles": ["customer", "nation", "region", "orders", "stints"], "doc_terms": ["profiles", "person_skills"]}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The fixture view `name`, or the table of that name, over the tables in `d`."""
    if name not in VIEWS:
        return table(spark, d, name)
    if name == "doc_terms":  # the same rows as its text, in one pass over the profiles
        p, skills = view(spark, d, "profiles"), view(spark, d, "person_skills")
        word = F.expr("substring(current_title, 1, instr(current_title, ' ') - 1)")
        parts = {"industry": F.col("industry"), "location": F.col("metro_area"), "company": F.col("current_company")}
        terms = F.array(*(F.concat(F.lit(f"{k}:"), F.lower(c)) for k, c in parts.items()), F.concat(F.lit("title:"), word))
        mine = p.select("person_id", F.explode(F.array_distinct(F.filter(terms, lambda t: t.isNotNull()))).alias("term"))
        return mine.unionByName(skills.select("person_id", F.concat(F.lit("skill:"), "skill").alias("term")))
    return frame(spark, VIEWS[name], {n: view(spark, d, n) for n in _NEEDS[name]})


def frame(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A SQL text over named DataFrames, as one lazy plan. The names are bound to the text alone: no view of the session
    is made or hidden."""
    for n in tables:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **tables)


def with_views(*names: str) -> str:
    """A WITH clause that defines the views (and those they need) for the other engine."""
    out: dict[str, None] = {}

    def need(n: str) -> None:
        if n in VIEWS and n not in out:
            for m in _NEEDS[n]:
                need(m)
            out[n] = None

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in out)
